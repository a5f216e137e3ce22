"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.llm import pieces
from strataquill.plans.registry import Registry
from strataquill.session import scratch, table, text_table

R = Registry()

LENGTHS = r"""
WITH rows AS (
  SELECT DISTINCT document_id, section_id, source_start AS a, source_end AS z FROM section_nodes WHERE source_start >= 0),
following AS (
  SELECT document_id, a, lead(a) OVER (PARTITION BY document_id ORDER BY a) AS b FROM (SELECT DISTINCT document_id, a FROM rows)),
spans AS (SELECT r.document_id, r.section_id, r.a, least(f.b, r.z) AS b FROM rows r JOIN following f USING (document_id, a)),
texts AS (
  SELECT s.section_id, list_filter(list_slice(string_split(d.markdown, chr(10)), s.a + 1, coalesce(s.b, 2147483647)), lambda x: NOT regexp_full_match(x, '[ \t]*<!-- PDF page \d+ -->[ \t\r]*')) AS parts
  FROM spans s JOIN document_md d USING (document_id) WHERE d.markdown IS NOT NULL)
"""


def _tables(spark, sf_dir):
    return text_table(spark, sf_dir, "document_md"), table(spark, sf_dir, "section_nodes")


@R.query("p1_found", LENGTHS + "SELECT section_id FROM texts WHERE length(array_to_string(parts, chr(10))) > 3000")
def p1_found(spark, sf_dir):
    return pieces.oversized(*_tables(spark, sf_dir)).select("section_id").distinct()


@R.query("p1_pieces")
def p1_pieces(spark, sf_dir):
    return pieces.pieces(*_tables(spark, sf_dir))


REBUILT = LENGTHS + "SELECT section_id, length(array_to_string(parts, chr(10)))::INT AS n_chars, md5(array_to_string(parts, chr(10))) AS digest FROM texts WHERE length(array_to_string(parts, chr(10))) > 3000"


def _rebuilt(found):
    part = F.struct("piece_no", F.expr("substring(content, overlap + 1)").alias("own"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["own"]), "")
    return found.groupBy("section_id").agg(whole.alias("text")).select("section_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@R.query("p1_rebuilt", REBUILT)
def p1_rebuilt(spark, sf_dir):
    """What the pieces of each section make up without their overlaps: the section's own text."""
    return _rebuilt(p1_pieces(spark, sf_dir))


@R.query("p1_byte_ranges", REBUILT)
def p1_byte_ranges(spark, sf_dir):
    """The same from files of many texts each, read in byte ranges at their offsets."""
    documents, sections = _tables(spark, sf_dir)
    spans = pieces.Files.packed(documents, scratch(spark, "files"))
    return _rebuilt(pieces.pieces(pieces.Files(spans), sections))


@R.query("p1_faults", "SELECT '' AS section_id, CAST(0 AS INT) AS piece_no, '' AS fault WHERE false")
def p1_faults(spark, sf_dir):
    """Pieces above the limit, with too long an overlap, with one that isn't the end of the piece before, or out of order; none is expected."""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id", "section_id").orderBy("piece_no")
    rows = p1_pieces(spark, sf_dir).withColumn("before", F.lag("content").over(order)).withColumn("end", F.lag("end_pos").over(order)).withColumn("n", F.row_number().over(order) - 1)
    tests = {
        "limit": F.length("content") > 3_000,
        "overlap": (F.col("overlap") > 200) | (F.col("piece_no") > 0) & (F.col("overlap") < 1),
        "tail": (F.col("piece_no") > 0) & ~F.endswith("before", F.substring(F.col("content"), F.lit(1), F.col("overlap"))),
        "order": (F.col("n") != F.col("piece_no")) | (F.col("start_pos") < F.col("end")),
    }
    return rows.select("section_id", "piece_no", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in tests.items())))).alias("fault"))


@R.query("p1_counts")
def p1_counts(spark, sf_dir):
    """How many oversized sections came out in how many pieces."""
    return p1_pieces(spark, sf_dir).groupBy("section_id").agg(F.count("*").alias("pieces")).groupBy("pieces").agg(F.count("*").alias("sections"))
