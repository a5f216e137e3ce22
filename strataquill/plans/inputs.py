"""Sources, sinks and streams: what is written to the shared folder is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.operators import graph, markdown
from strataquill.plans.registry import Registry
from strataquill.session import scratch, table
from strataquill.sources import documents as formats
from strataquill.sources import files, sinks
from strataquill.streaming import ingest

R = Registry()
t = table


def q(name, sql=None, **types):
    return R.query(name, sql, **types)


@q("src01", "SELECT document_id, markdown AS content FROM document_md WHERE markdown IS NOT NULL")
def src01(s, d):
    root = scratch(s, "corpus")
    sinks.write_canonical(t(s, d, "document_md"), root)
    return files.canonical_corpus(s, root).select("document_id", "content")


@q("src02", "SELECT count(*) AS n FROM document_md WHERE markdown IS NOT NULL")
def src02(s, d):
    """Folders that begin with a dot hold no documents."""
    root = scratch(s, "corpus")
    sinks.write_canonical(t(s, d, "document_md"), root)
    sinks.write_canonical(s.createDataFrame([("one", "# failed")], "document_id string, markdown string"), f"{root}/.failed")
    return files.canonical_corpus(s, root).agg(F.count("*").alias("n"))


@q("src03", "SELECT 'deep/' || document_id || '/document.md' AS relative_path, length(markdown) AS n FROM document_md WHERE markdown IS NOT NULL", n="INT")
def src03(s, d):
    root = scratch(s, "tree")
    sinks.write_canonical(t(s, d, "document_md"), f"{root}/deep")
    return files.recursive_markdown(s, root).select("relative_path", F.length("value").alias("n"))


@q("src04", "SELECT id, lower(sha256) AS sha256, title FROM manifest")
def src04(s, d):
    root = scratch(s, "manifest")
    t(s, d, "manifest").write.option("header", True).option("escape", '"').csv(root)
    return files.manifest_csv(s, root).select("id", "sha256", "title")


@q("src05", "SELECT document_id, source, source_sha256 FROM quality_reports")
def src05(s, d):
    root = scratch(s, "sidecars")
    sinks.export_json(t(s, d, "quality_reports"), root)
    return files.sidecars(s, root)


@q("src06", "SELECT query_id, array_to_string(list_filter([query, reference_answer], lambda x: trim(x) <> ''), ' ') AS text FROM eval_items")
def src06(s, d):
    return t(s, d, "eval_items").select("query_id", files.joined_text(F.array("query", "reference_answer")).alias("text"))


@q("src07", "SELECT query_id, array_to_string(list_filter(section_path || [query], lambda x: trim(x) <> ''), ' ') AS text FROM eval_items")
def src07(s, d):
    return t(s, d, "eval_items").select("query_id", files.joined_text(F.col("section_path"), F.array("query")).alias("text"))


@q("src09", "SELECT length(markdown) AS n, count(*) AS texts FROM document_md WHERE markdown IS NOT NULL GROUP BY 1", n="INT")
def src09(s, d):
    root = scratch(s, "texts")
    sinks.write_canonical(t(s, d, "document_md"), root)
    return files.plain_texts(s, f"{root}/*/document.md").groupBy(F.length("value").alias("n")).agg(F.count("*").alias("texts"))


@q("src15", "SELECT document_id, coalesce(source, 'unknown') AS source, coalesce(status, 'none') AS status, coalesce(page_count, 0) AS page_count FROM quality_reports")
def src15(s, d):
    return t(s, d, "quality_reports").select("document_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("status", F.lit("none")).alias("status"), F.coalesce("page_count", F.lit(0)).alias("page_count"))


@q("src16", "SELECT path, 'markdown' AS format FROM document_md")
def src16(s, d):
    return files.formats(t(s, d, "document_md").select("path", F.encode(F.substring("markdown", 1, 256), "UTF-8").alias("head")), "path", "head")


@q("src18", "SELECT c_custkey, 1 AS row, c::INT AS col, [c_custkey::VARCHAR, c_name, c_mktsegment][c + 1] AS text, false AS is_header FROM customer, range(0, 3) AS r(c)")
def src18(s, d):
    text = F.concat(F.lit("key;name;segment\n"), F.col("c_custkey").cast("string"), F.lit(";"), "c_name", F.lit(";"), "c_mktsegment", F.lit("\n"))
    return files.csv_grid(t(s, d, "customer").select("c_custkey", text.alias("csv")), "c_custkey", "csv").where("not is_header")


def pages(s, d):
    cell = F.concat(F.lit("<td>"), F.col("c_custkey").cast("string"), F.lit("</td><td>"), "c_mktsegment", F.lit("</td>"))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><h1>"), "c_name", F.lit("</h1><script>var a=1;</script><p>From &lt;nation&gt; "), F.col("c_nationkey").cast("string"), F.lit("<p>open<ul><li>one<li>two</ul><table><tr><th colspan=2>head</th></tr><tr>"), cell, F.lit("</tr></table></body></html>"))
    return t(s, d, "customer").select("c_custkey", page.alias("html"))


@q("src19", "SELECT c_custkey, 0 AS block_no, 'heading' AS kind, 1 AS level, c_name AS text FROM customer UNION ALL SELECT c_custkey, 1, 'paragraph', 0, 'From <nation> ' || c_nationkey FROM customer UNION ALL SELECT c_custkey, 2, 'paragraph', 0, 'open' FROM customer UNION ALL SELECT c_custkey, 3, 'list_item', 1, 'one' FROM customer UNION ALL SELECT c_custkey, 4, 'list_item', 1, 'two' FROM customer")
def src19(s, d):
    return formats.as_blocks(pages(s, d), "c_custkey", "html", formats.html_blocks)


@q("src20", "SELECT c_custkey, 0 AS block_no, 'th' AS kind, 0 AS level, '0:1,0:2 head' AS text FROM customer UNION ALL SELECT c_custkey, 1, 'td', 0, '1:2,0:1 ' || c_custkey FROM customer UNION ALL SELECT c_custkey, 2, 'td', 0, '1:2,1:2 ' || c_mktsegment FROM customer")
def src20(s, d):
    return formats.as_blocks(pages(s, d), "c_custkey", "html", lambda x: [("th" if h else "td", i, f"{a}:{b},{c}:{e} {v}") for i, a, b, c, e, h, v in formats.html_cells(x)])


@q("src21")
def src21(s, d):
    return markdown.section_blocks(t(s, d, "document_md"))


@q("src22", """WITH RECURSIVE c AS (SELECT DISTINCT l_suppkey AS sheet, l_quantity::INT AS r, (l_partkey % 40)::INT AS k FROM lineitem),
reach AS (SELECT sheet, r, k, r AS r2, k AS k2 FROM c UNION SELECT x.sheet, x.r, x.k, c.r, c.k FROM reach x JOIN c ON c.sheet = x.sheet AND abs(c.r - x.r2) + abs(c.k - x.k2) = 1),
regions AS (SELECT sheet, r, k, min(r2 * 100 + k2) AS id FROM reach GROUP BY 1, 2, 3)
SELECT sheet, min(r) AS top, min(k) AS "left", max(r) AS bottom, max(k) AS "right", count(*) AS cells FROM regions GROUP BY sheet, id""")
def src22(s, d):
    """The rectangles of regions of touching cells."""
    cells = t(s, d, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.col("l_quantity").cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col"))
    return graph.flood_regions(cells, "sheet")


@q("src26", "SELECT source_ref, document_id, page_no, bbox.l AS l FROM source_cells")
def src26(s, d):
    """A row as JSON and back."""
    rows = t(s, d, "source_cells")
    back = rows.select(F.from_json(F.to_json(F.struct(*rows.columns)), rows.schema).alias("x"))
    return back.select("x.source_ref", "x.document_id", "x.page_no", F.col("x.bbox.l").alias("l"))


@q("src29", "SELECT source_ref FROM source_cells WHERE page_no BETWEEN 2 AND 4")
def src29(s, d):
    return files.page_range(t(s, d, "source_cells"), "page_no", 2, 9, 3).select("source_ref")


@q("src30", "SELECT * FROM (VALUES (0, 'heading', 1, 'A'), (1, 'paragraph', 0, 'b c')) AS v(block_no, kind, level, text)")
def src30(s, d):
    rows = s.createDataFrame([(1, "<h1>A</h1><p>b\nc</p>")], "key int, html string")
    return formats.as_blocks(rows, "key", "html", formats.html_blocks).drop("key")


@q("snk01", "SELECT document_id, length(markdown) AS n FROM document_md", n="INT")
def snk01(s, d):
    """Published twice; a run that is too small in between isn't seen."""
    root = scratch(s, "published")
    rows = t(s, d, "document_md").select("document_id", F.length("markdown").alias("n"))
    sinks.publish(rows.limit(1), root)
    try:
        sinks.publish(rows.where("false"), root)
    except ValueError:
        pass
    sinks.publish(rows, root)
    return sinks.published(s, root)


@q("snk02", "SELECT vec_id, label FROM embeddings")
def snk02(s, d):
    """A collection written, dropped and written again."""
    root = scratch(s, "collection")
    rows = t(s, d, "embeddings").select("vec_id", "label")
    rows.where("false").write.parquet(root)
    rows.write.mode("overwrite").parquet(root)
    return s.read.parquet(root)


@q("snk03", "SELECT count(*) AS n FROM embeddings")
def snk03(s, d):
    root = scratch(s, "batches")
    t(s, d, "embeddings").write.option("maxRecordsPerFile", 100).parquet(root)
    return s.read.parquet(root).agg(F.count("*").alias("n"))


@q("snk04", "SELECT doc_id FROM documents")
def snk04(s, d):
    root = scratch(s, "appended")
    rows = t(s, d, "documents").select("doc_id")
    sinks.append_new(rows.where("doc_id % 2 = 0"), root, "doc_id")
    sinks.append_new(rows.unionByName(rows), root, "doc_id")
    return sinks.stored(s, root)


@q("snk05", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def snk05(s, d):
    root = scratch(s, "index")
    sinks.publish(t(s, d, "embeddings"), root)
    return sinks.published(s, root).groupBy("label").agg(F.count("*").alias("n"))


@q("snk06", "SELECT count(*) AS rows, count(DISTINCT document_id) AS keys FROM source_cells")
def snk06(s, d):
    return sinks.statistics(t(s, d, "source_cells"), "document_id")


@q("snk07", "SELECT doc_id, lang, source FROM documents")
def snk07(s, d):
    root = scratch(s, "metadata")
    sinks.export_json(t(s, d, "documents").select("doc_id", "lang", "source"), root)
    return s.read.schema("doc_id bigint, lang string, source string").json(root)


@q("snk08", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def snk08(s, d):
    root = scratch(s, "by_label")
    sinks.export_json(t(s, d, "embeddings").select("label", "vec_id"), root, "label")
    return s.read.schema("vec_id bigint, label int").json(root).groupBy("label").agg(F.count("*").alias("n"))


@q("snk09", """WITH c AS (SELECT DISTINCT document_id, page_no, ordinal, source_ref, text FROM source_cells WHERE document_id IS NOT NULL AND page_no IS NOT NULL AND trim(text) <> ''),
p AS (SELECT document_id, page_no, '<!-- PDF page ' || page_no || ' -->' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY ordinal NULLS FIRST, source_ref) AS x FROM c GROUP BY 1, 2)
SELECT document_id, string_agg(x, chr(10) || chr(10) ORDER BY page_no) AS markdown FROM p GROUP BY 1""")
def snk09(s, d):
    return sinks.page_markdown(t(s, d, "source_cells"))


@q("snk10", "SELECT count(*) AS files FROM document_md WHERE markdown IS NOT NULL")
def snk10(s, d):
    return s.createDataFrame([(sinks.write_canonical(t(s, d, "document_md"), scratch(s, "export")),)], "files bigint")


@q("snk11", "SELECT DISTINCT query FROM eval_items UNION SELECT 'How many orders are there?'")
def snk11(s, d):
    root = scratch(s, "examples")
    sinks.append_new(t(s, d, "eval_items").select("query"), root, "query")
    sinks.append_new(s.createDataFrame([("How many orders are there?",)], "query string"), root, "query")
    return sinks.stored(s, root)


@q("stm01")
def stm01(s, d):
    """Documents as an arriving stream, their leaves as a table."""
    source, target = scratch(s, "arriving"), scratch(s, "leaves")
    docs = t(s, d, "document_md").select("document_id", "markdown")
    docs.write.parquet(source)
    ingest.arriving_leaves(s, source, target, scratch(s, "offsets"), "document_id string, markdown string")
    return s.read.parquet(target).select("document_id", "chunk_index", "chunk_id")


@q("stm02")
def stm02(s, d):
    """The same arriving twice: nothing is stored twice."""
    source, target = scratch(s, "arriving"), scratch(s, "leaves")
    docs = t(s, d, "document_md").select("document_id", "markdown")
    docs.write.parquet(source)
    for _ in range(2):
        ingest.arriving_leaves(s, source, target, scratch(s, "offsets"), "document_id string, markdown string")
    return s.read.parquet(target).groupBy("document_id").agg(F.count("*").alias("leaves"))


@q("stm03", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stm03(s, d):
    """Windowed counts, the batch form of the streaming operator."""
    rows = ingest.windowed_counts(t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
