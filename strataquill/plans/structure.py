"""Structure parsing, chunking and hierarchy over document_md and section_nodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataquill.functions import tokens
from strataquill.operators import chunking, hierarchy, markdown
from strataquill.plans.registry import Registry
from strataquill.session import table, text_table

R = Registry()

LINES = """
WITH docs AS (SELECT document_id, string_split(markdown, chr(10)) AS parts FROM document_md WHERE markdown IS NOT NULL),
lined AS (SELECT document_id, CAST(i - 1 AS INT) AS line_no, parts[i] AS line FROM docs, unnest(range(1, len(parts) + 1)) AS r(i)),
paged AS (SELECT *, TRY_CAST(nullif(regexp_extract(line, '^\\s*<!-- PDF page ([1-9][0-9]*) -->\\s*$', 1), '') AS INT) AS own FROM lined)
"""
ACTIVE = LINES + """,
active AS (SELECT document_id, line_no, line, own,
    last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active,
    first_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_page
  FROM paged)
"""
HEADS = """
heads AS (SELECT DISTINCT document_id, section_id, heading_level AS level, heading, source_start AS start, source_end AS "end"
  FROM section_nodes WHERE kind = 'heading' AND section_id IS NOT NULL AND heading_level BETWEEN 1 AND 6 AND source_start >= 0)
"""
PARENTS = f"""
WITH {HEADS},
parents AS (
  SELECT h.document_id, h.section_id, h.level, h.start, arg_max(p.section_id, (p.start, p.section_id)) AS parent_id
  FROM heads h LEFT JOIN heads p ON p.document_id = h.document_id AND (p.start, p.section_id) < (h.start, h.section_id) AND p.level < h.level
  GROUP BY ALL)
"""


def md(spark, sf_dir):
    return text_table(spark, sf_dir, "document_md")


def heads(spark, sf_dir):
    return hierarchy.heading_rows(table(spark, sf_dir, "section_nodes"))


def spans(spark, sf_dir):
    n = md(spark, sf_dir).where("markdown is not null").select("document_id", F.size(F.split("markdown", "\n", -1)).alias("n_lines"))
    return heads(spark, sf_dir).join(n, "document_id").select("document_id", "section_id", F.col("start").alias("first"), F.least("end", "n_lines").alias("last")).where("first < last")


SPANS = f"{HEADS}, spans AS (SELECT h.document_id, h.section_id, h.start AS first, least(h.\"end\", len(d.parts)) AS last FROM heads h JOIN docs d USING (document_id) WHERE h.start < least(h.\"end\", len(d.parts)))"


@R.query("str01", LINES + "SELECT document_id, line_no, line FROM lined")
def str01(spark, sf_dir):
    return markdown.lines(md(spark, sf_dir))


@R.query("str02", LINES + "SELECT document_id, line_no, own AS page FROM paged WHERE own IS NOT NULL")
def str02(spark, sf_dir):
    return markdown.markers(md(spark, sf_dir))


PLANTED = """WITH base AS (SELECT document_id, markdown FROM document_md WHERE markdown IS NOT NULL),
planted AS (SELECT document_id, markdown FROM base UNION ALL SELECT document_id || '#1', replace(markdown, '<!-- PDF page 1 -->', '<!-- PDF page one -->') FROM base UNION ALL SELECT document_id || '#2', '<!-- PDF page 9 -->' || chr(10) || markdown FROM base
  UNION ALL SELECT document_id || '#3', 'early' || chr(10) || markdown FROM base UNION ALL SELECT document_id || '#4', replace(markdown, '<!-- PDF', '<!-- pdf') FROM base),
docs AS (SELECT document_id, string_split(markdown, chr(10)) AS parts FROM planted),"""


@R.query("str03", PLANTED + LINES.split("\n", 2)[2] + """,
seen AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM paged)
SELECT document_id, line_no, 'malformed' AS fault FROM seen WHERE own IS NULL AND contains(line, '<!-- PDF page')
UNION ALL SELECT document_id, line_no, 'backwards' FROM seen WHERE own < prior
UNION ALL SELECT document_id, min(line_no), 'early text' FROM seen WHERE prior IS NULL AND own IS NULL AND regexp_matches(line, '\\S') GROUP BY 1
UNION ALL SELECT document_id, NULL, 'none' FROM seen GROUP BY 1 HAVING count(own) = 0""")
def str03(spark, sf_dir):
    """Marker faults of the documents, and of copies into which each fault is planted."""
    base = md(spark, sf_dir).where("markdown is not null").select("document_id", "markdown")
    copy = lambda n, c: base.select(F.concat("document_id", F.lit(f"#{n}")).alias("document_id"), c.alias("markdown"))
    text = F.col("markdown")
    planted = base.unionByName(copy(1, F.replace(text, F.lit("<!-- PDF page 1 -->"), F.lit("<!-- PDF page one -->")))).unionByName(copy(2, F.concat(F.lit("<!-- PDF page 9 -->\n"), text)))
    planted = planted.unionByName(copy(3, F.concat(F.lit("early\n"), text))).unionByName(copy(4, F.replace(text, F.lit("<!-- PDF"), F.lit("<!-- pdf"))))
    return markdown.marker_faults(planted)


@R.query("str04", ACTIVE + "SELECT document_id, line_no, active AS page FROM active")
def str04(spark, sf_dir):
    return markdown.line_pages(md(spark, sf_dir)).select("document_id", "line_no", F.col("active").alias("page"))


@R.query("joi14", ACTIVE + "SELECT document_id, active AS page, count(*) AS n FROM active GROUP BY ALL")
def joi14(spark, sf_dir):
    return markdown.line_pages(md(spark, sf_dir)).groupBy("document_id", F.col("active").alias("page")).agg(F.count("*").alias("n"))


@R.query("str05", ACTIVE + f""", {SPANS}
SELECT s.document_id, s.section_id, s.first, s.last, coalesce(a.active, a.first_page) AS page_start, coalesce(b.active, b.first_page) AS page_end
FROM spans s JOIN active a ON a.document_id = s.document_id AND a.line_no = s.first JOIN active b ON b.document_id = s.document_id AND b.line_no = s.last - 1""", last="INT")
def str05(spark, sf_dir):
    return markdown.span_pages(md(spark, sf_dir), spans(spark, sf_dir))


TEXTS = f", {SPANS} SELECT document_id, section_id, array_to_string(list_filter(list_slice(parts, first + 1, last), lambda x: NOT regexp_matches(x, '^\\s*<!-- PDF page ([1-9][0-9]*) -->\\s*$')), chr(10)) AS text FROM spans JOIN docs USING (document_id)"


@R.query("hie06", LINES + TEXTS)
def hie06(spark, sf_dir):
    return markdown.span_text(md(spark, sf_dir), spans(spark, sf_dir))


@R.query("str06", LINES + ", kept AS (SELECT document_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM paged WHERE own IS NULL GROUP BY 1) SELECT document_id, text FROM kept")
def str06(spark, sf_dir):
    part = F.filter(F.split("markdown", "\n", -1), lambda x: ~x.rlike(markdown.MARKER))
    return md(spark, sf_dir).where("markdown is not null").select("document_id", part.alias("p")).where("size(p) > 0").select("document_id", F.array_join("p", "\n").alias("text"))


@R.query("str07", f"WITH {HEADS} SELECT h.document_id, h.level, h.start AS start_line FROM heads h JOIN document_md d USING (document_id) WHERE d.markdown IS NOT NULL")
def str07(spark, sf_dir):
    """Level and place of every parsed heading; section_nodes holds the same, but for odd characters in its texts."""
    return markdown.headings(md(spark, sf_dir)).select("document_id", "level", "start_line")


@R.query("str08")
def str08(spark, sf_dir):
    return markdown.tables(md(spark, sf_dir))


ENDS = LINES + f""", {HEADS}
SELECT h.document_id, h.section_id, h.level, h.start, coalesce(min(n.start), any_value(len(d.parts))) AS section_end, arg_min(n.heading, (n.start, n.section_id)) AS next_heading
FROM heads h JOIN docs d USING (document_id) LEFT JOIN heads n ON n.document_id = h.document_id AND (n.start, n.section_id) > (h.start, h.section_id) AND n.level <= h.level GROUP BY ALL"""


def _ends(spark, sf_dir):
    n = md(spark, sf_dir).where("markdown is not null").select("document_id", F.size(F.split("markdown", "\n", -1)).alias("n_lines"))
    return hierarchy.section_ends(heads(spark, sf_dir), n)


@R.query("str09", f"SELECT document_id, section_id, section_end FROM ({ENDS})", section_end="INT")
def str09(spark, sf_dir):
    return _ends(spark, sf_dir).select("document_id", "section_id", "section_end")


@R.query("hie10", f"SELECT section_id, next_heading FROM ({ENDS})")
def hie10(spark, sf_dir):
    return _ends(spark, sf_dir).select("section_id", "next_heading")


TERMINAL = LINES + f""", {HEADS},
n AS (SELECT h.document_id, h.section_id, h.level, h.start, len(d.parts) AS n_lines, d.parts, lead(h.start) OVER w AS next_start, lead(h.level) OVER w AS next_level
  FROM heads h JOIN docs d USING (document_id) WINDOW w AS (PARTITION BY h.document_id ORDER BY h.start, h.section_id)),
e AS (SELECT n.*, (SELECT min(x.start) FROM heads x WHERE x.document_id = n.document_id AND x.start > n.start AND x.level <= n.level) AS next_same FROM n),
own AS (SELECT document_id, level, start + 1 AS start_line, CASE WHEN next_level > level THEN next_start ELSE coalesce(next_same, n_lines) END AS end_line, coalesce(next_level > level, false) AS preface, parts FROM e),
lead AS (SELECT d.document_id, NULL::INT AS level, 0 AS start_line, coalesce(min(h.start), any_value(len(d.parts))) AS end_line, count(h.start) > 0 AS preface, any_value(d.parts) AS parts FROM docs d LEFT JOIN heads h USING (document_id) GROUP BY 1),
terminal AS (SELECT document_id, level, start_line::INT AS start_line, end_line::INT AS end_line FROM (SELECT * FROM own UNION ALL SELECT * FROM lead)
  WHERE NOT preface OR len(list_filter(list_slice(parts, start_line + 1, end_line), lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*<!-- PDF page ([1-9][0-9]*) -->\\s*$'))) > 0)
"""


@R.query("str10", TERMINAL + "SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY start_line) - 1 AS ordinal, level, start_line, end_line FROM terminal")
def str10(spark, sf_dir):
    rows = markdown.terminal_sections(md(spark, sf_dir))
    return rows.select("document_id", F.col("ordinal").cast("bigint").alias("ordinal"), "level", "start_line", "end_line")


@R.query("str11")
def str11(spark, sf_dir):
    return markdown.section_blocks(md(spark, sf_dir))


@R.query("str12", TERMINAL + "SELECT document_id, level, start_line, start_line - 1 AS heading_line FROM terminal WHERE level IS NOT NULL")
def str12(spark, sf_dir):
    return markdown.owning_headings(md(spark, sf_dir)).select("document_id", "level", "start_line", "heading_line")


@R.query("chk01", "SELECT 768 AS chunk_size, 96 AS overlap_tokens, true AS valid")
def chk01(spark, sf_dir):
    return spark.createDataFrame([(*chunking.checked(768, 96), True)], "chunk_size int, overlap_tokens int, valid boolean")


@R.query("chk02", "SELECT doc_id, coalesce(length(text), 0) AS tokens FROM documents", tokens="INT")
def chk02(spark, sf_dir):
    return chunking.token_counts(table(spark, sf_dir, "documents"))


@R.query("chk02_tokens")
def chk02_tokens(spark, sf_dir):
    """By the public tokenizer."""
    return chunking.token_counts(text_table(spark, sf_dir, "documents"), vocabulary=tokens.DEFAULT_VOCABULARY)


def token_leaves(spark, sf_dir, size=768, overlap=96):
    """Leaves by tokens of the public tokenizer."""
    return markdown.leaves(md(spark, sf_dir), size, overlap, tokens.DEFAULT_VOCABULARY)


@R.query("chk03")
def chk03(spark, sf_dir):
    return token_leaves(spark, sf_dir).where("unit = 'packed'")


@R.query("chk04")
def chk04(spark, sf_dir):
    return token_leaves(spark, sf_dir, 64, 8).where("unit = 'table'")


@R.query("chk05", """
SELECT doc_id, CAST(k AS INT) AS window_no, substr(text, CAST(k * 672 + 1 AS INT), 768) AS content
FROM (SELECT doc_id, text, unnest(range(0, 1 + CAST(ceil(greatest(length(text) - 768, 0) / 672.0) AS BIGINT))) AS k FROM documents WHERE length(text) > 0)
WHERE regexp_matches(substr(text, CAST(k * 672 + 1 AS INT), 768), '[^ \\t\\n\\r\\f\\v]')""")
def chk05(spark, sf_dir):
    return chunking.token_windows(table(spark, sf_dir, "documents"), 768, 96)


@R.query("chk06")
def chk06(spark, sf_dir):
    """How much each leaf takes over from the one before."""
    return token_leaves(spark, sf_dir, 256, 64).select("chunk_id", "document_id", "chunk_index", F.length("content").alias("n_chars"))


@R.query("chk07")
def chk07(spark, sf_dir):
    return token_leaves(spark, sf_dir).select("chunk_id", "page_start", "page_end")


@R.query("chk08", f"""WITH {HEADS}
SELECT section_id, 'sec_' || sha256('{{"document_id":' || to_json(document_id) || ',"heading_level":' || level || ',"kind":"heading","source_start":' || start || '}}') AS made_id FROM heads""")
def chk08(spark, sf_dir):
    return heads(spark, sf_dir).select("section_id", chunking.section_identity(F.col("document_id"), F.lit("heading"), F.col("level"), F.col("start")).alias("made_id"))


@R.query("chk09")
def chk09(spark, sf_dir):
    return token_leaves(spark, sf_dir).select("document_id", "chunk_index", "section_ordinal", "chunk_id")


@R.query("chk10", """WITH leaves AS (SELECT document_id, ordinal AS chunk_index, CASE WHEN ordinal % 5 = 0 THEN document_id ELSE source_ref END AS chunk_id, coalesce(text, '') AS content, CASE WHEN from_ocr THEN 'table' ELSE 'packed' END AS unit, page_no AS page_start, page_no - (ordinal % 7 = 0)::INT AS page_end
  FROM (SELECT DISTINCT document_id, ordinal, source_ref, text, from_ocr, page_no FROM source_cells WHERE document_id IS NOT NULL AND ordinal IS NOT NULL)),
x AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS expected, count(*) OVER (PARTITION BY chunk_id) AS copies FROM leaves)
SELECT document_id, chunk_index, fault FROM (SELECT document_id, chunk_index, unnest([CASE WHEN trim(content) = '' THEN 'empty' END, CASE WHEN length(content) > 60 AND unit <> 'table' THEN 'oversize' END, CASE WHEN page_start > page_end THEN 'pages' END, CASE WHEN copies > 1 THEN 'duplicate' END]) AS fault FROM x) WHERE fault IS NOT NULL""")
def chk10(spark, sf_dir):
    """Faults of leaf rows made of cells, into which each fault is planted; numbers come in several pages, so gaps are another query's."""
    cells = table(spark, sf_dir, "source_cells").where("document_id is not null and ordinal is not null").select("document_id", "ordinal", "source_ref", "text", "from_ocr", "page_no").distinct()
    rows = cells.select(
        "document_id", F.col("ordinal").alias("chunk_index"), F.when(F.col("ordinal") % 5 == 0, F.col("document_id")).otherwise(F.col("source_ref")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"),
        F.when(F.col("from_ocr"), "table").otherwise("packed").alias("unit"), F.col("page_no").alias("page_start"), (F.col("page_no") - (F.col("ordinal") % 7 == 0).cast("int")).alias("page_end"),
    )
    return markdown.leaf_faults(rows, 60).where("fault <> 'gap'")


@R.query("chk10_leaves", "SELECT '' AS document_id, CAST(0 AS INT) AS chunk_index, '' AS fault WHERE false")
def chk10_leaves(spark, sf_dir):
    """The real leaves have no fault."""
    return markdown.leaf_faults(markdown.leaves(md(spark, sf_dir)))


@R.query("chk11", TERMINAL + ", r AS (SELECT DISTINCT document_id FROM terminal WHERE level IS NULL) SELECT document_id, 'heading' AS kind, level, start AS start_line FROM heads JOIN docs USING (document_id) UNION ALL SELECT document_id, 'document_root', NULL, 0 FROM r")
def chk11(spark, sf_dir):
    return markdown.section_refs(md(spark, sf_dir)).select("document_id", "kind", "level", "start_line")


@R.query("chk12", """
WITH cut AS (
  SELECT document_id, unnest(CASE WHEN length(markdown) <= 500 THEN [markdown] WHEN contains(markdown, chr(10) || '## ') THEN string_split(markdown, chr(10) || '## ')
    ELSE [substr(markdown, CAST(k * 450 + 1 AS INT), 500) FOR k IN range(0, (length(markdown) - 1) // 450 + 1)] END) AS piece
  FROM document_md WHERE markdown <> '')
SELECT document_id, piece, count(*) AS n FROM cut GROUP BY ALL""")
def chk12(spark, sf_dir):
    return chunking.fixed_chunks(md(spark, sf_dir), 500, 50).groupBy("document_id", "piece").agg(F.count("*").alias("n"))


@R.query("chk13", LINES + """,
marked AS (SELECT document_id, line_no, line, CASE WHEN line LIKE '# %' THEN 1 WHEN line LIKE '## %' THEN 2 WHEN line LIKE '### %' THEN 3 END AS level FROM lined),
runs AS (SELECT *, count(level) OVER (PARTITION BY document_id ORDER BY line_no) AS run FROM marked)
SELECT document_id, run, max(level) AS level, string_agg(line, chr(10) ORDER BY line_no) AS content FROM runs GROUP BY document_id, run""")
def chk13(spark, sf_dir):
    return chunking.header_chunks(markdown.lines(md(spark, sf_dir)))


#: White space as Python strips it.
STRIP = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]"


def merged_sql(parts, separator, size, overlap):
    """Greedy merging of ``parts`` (a list per doc_id): the group is the slice from ``s`` to the part before ``i``."""
    length = f"length(array_to_string(list_slice(p, {{0}}, i - 1), {separator}))"
    return f"""
WITH RECURSIVE src AS (SELECT doc_id, {parts} AS p FROM documents WHERE text <> ''),
step AS (SELECT doc_id, p, 1::BIGINT AS i, 1::BIGINT AS s, NULL::BIGINT AS f, NULL::BIGINT AS z FROM src WHERE len(p) > 0
  UNION ALL SELECT doc_id, p, i + 1, CASE WHEN over_it THEN coalesce(keep, i) ELSE s END, CASE WHEN over_it THEN s END, CASE WHEN over_it THEN i - 1 END FROM (
    SELECT doc_id, p, i, s, i > s AND {length.format('s')} + length({separator}) + length(p[i]) > {size} AS over_it,
      list_min(list_filter(range(s, i), lambda k: {length.format('k')} <= {overlap} AND {length.format('k')} + length(p[i]) + length({separator}) <= {size})) AS keep FROM step WHERE i <= len(p))),
cut AS (SELECT doc_id, p, f, z FROM step WHERE f IS NOT NULL UNION ALL SELECT doc_id, p, s, len(p) FROM step WHERE i = len(p) + 1),
named AS (SELECT doc_id, f, z, regexp_replace(array_to_string(list_slice(p, f, z), {separator}), '^{STRIP}+|{STRIP}+$', '', 'g') AS content FROM cut)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY z, f) - 1)::INT AS piece_no, content FROM named WHERE content <> ''"""


@R.query("chk14", merged_sql("list_filter(string_split(text, chr(10) || chr(10)), lambda x: x <> '')", "(chr(10) || chr(10))", 200, 10))
def chk14(spark, sf_dir):
    return chunking.character_chunks(table(spark, sf_dir, "documents"), "\n\n", 200, 10)


@R.query("chk15")
def chk15(spark, sf_dir):
    return chunking.recursive_chunks(table(spark, sf_dir, "documents"), 200, 10)


SENTENCES = """
sents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, parts[i] AS sentence
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?]+\\s+'), lambda x: regexp_matches(x, '\\S')) AS parts FROM documents WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS r(i))
"""


@R.query("chk17", f"""WITH {SENTENCES}
SELECT doc_id, pos, sentence, array_to_string(list(sentence) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), ' ') AS "window" FROM sents""", pos="INT")
def chk17(spark, sf_dir):
    return chunking.sentence_windows(chunking.simple_sentences(table(spark, sf_dir, "documents")), 3)


@R.query("win04", f"""WITH {SENTENCES}
SELECT doc_id, pos, count(*) OVER w AS n, sum(length(sentence)) OVER w AS chars FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", pos="INT", chars="BIGINT")
def win04(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-3, 3)
    rows = chunking.simple_sentences(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "pos", F.count("*").over(w).alias("n"), F.sum(F.length("sentence")).over(w).alias("chars"))


@R.query("rec06", f"""WITH {SENTENCES}
SELECT doc_id, pos, array_to_string(list(sentence) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), ' ') AS context FROM sents QUALIFY contains(sentence, 'Torque')""", pos="INT")
def rec06(spark, sf_dir):
    """Sentences that match a search, each replaced by its window."""
    found = chunking.sentence_windows(chunking.simple_sentences(table(spark, sf_dir, "documents")), 3)
    return found.where(F.col("sentence").contains("Torque")).select("doc_id", "pos", F.col("window").alias("context"))


CUT = f"list_filter(string_split(regexp_replace(text, '([.!?。！？]){STRIP}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^' || substr('{STRIP}', 2)))"


@R.query("chk18", merged_sql(f"flatten([CASE WHEN length(x) <= 512 THEN [x] ELSE [substr(x, (k * 512 + 1)::INT, 512) FOR k IN range(0, (length(x) + 511) // 512)] END FOR x IN {CUT}])", "' '", 512, 0))
def chk18(spark, sf_dir):
    return chunking.sentence_chunks(table(spark, sf_dir, "documents"), 512)


@R.query("chk16", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT vec_id, label, 1 - list_inner_product(e, lag(e) OVER (PARTITION BY label ORDER BY vec_id)) / sqrt(list_inner_product(e, e) * list_inner_product(lag(e) OVER (PARTITION BY label ORDER BY vec_id), lag(e) OVER (PARTITION BY label ORDER BY vec_id))) AS dist FROM v),
p AS (SELECT label, quantile_cont(dist, 0.95) AS cut FROM d GROUP BY 1)
SELECT d.label, d.vec_id, sum(CASE WHEN round(dist, 9) > round(cut, 9) THEN 1 ELSE 0 END) OVER (PARTITION BY d.label ORDER BY vec_id) AS chunk FROM d JOIN p USING (label)""", chunk="BIGINT")
def chk16(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label"), F.col("vec_id"), "embedding")
    return chunking.semantic_breaks(rows, "label", "vec_id", "embedding", 0.95)


@R.query("chk19")
def chk19(spark, sf_dir):
    return chunking.hybrid_chunks(markdown.leaves(md(spark, sf_dir), 768, 0), 768)


@R.query("hie01", PARENTS + "SELECT document_id, section_id, parent_id FROM parents")
def hie01(spark, sf_dir):
    return hierarchy.heading_parents(heads(spark, sf_dir)).select("document_id", "section_id", "parent_id")


@R.query("joi15", PARENTS + "SELECT section_id, level, parent_id IS NULL AS top FROM parents")
def joi15(spark, sf_dir):
    return hierarchy.heading_parents(heads(spark, sf_dir)).select("section_id", "level", F.col("parent_id").isNull().alias("top"))


@R.query("hie02", "SELECT DISTINCT document_id, section_id, source_start, source_end FROM section_nodes WHERE kind = 'document_root'")
def hie02(spark, sf_dir):
    return table(spark, sf_dir, "section_nodes").where("kind = 'document_root'").select("document_id", "section_id", "source_start", "source_end").distinct()


@R.query("hie03", PARENTS + "SELECT p.section_id, h.heading AS parent_heading, h.level AS parent_level FROM parents p JOIN heads h ON h.section_id = p.parent_id")
def hie03(spark, sf_dir):
    h = heads(spark, sf_dir)
    up = h.select(F.col("section_id").alias("parent_id"), F.col("heading").alias("parent_heading"), F.col("level").alias("parent_level"))
    return hierarchy.heading_parents(h).join(up, "parent_id").select("section_id", "parent_heading", "parent_level")


@R.query("hie04", PARENTS.replace("WITH", "WITH RECURSIVE", 1) + """,
up AS (SELECT section_id, parent_id AS ancestor_id, 1 AS distance FROM parents WHERE parent_id IS NOT NULL
  UNION ALL SELECT u.section_id, p.parent_id, u.distance + 1 FROM up u JOIN parents p ON p.section_id = u.ancestor_id WHERE p.parent_id IS NOT NULL)
SELECT section_id, ancestor_id, distance FROM up""")
def hie04(spark, sf_dir):
    return hierarchy.closure(hierarchy.heading_parents(heads(spark, sf_dir)))


@R.query("hie05", PARENTS + "SELECT document_id, parent_id, list(section_id ORDER BY start, section_id) AS children FROM parents WHERE parent_id IS NOT NULL GROUP BY ALL")
def hie05(spark, sf_dir):
    return hierarchy.children(hierarchy.heading_parents(heads(spark, sf_dir)))


@R.query("hie07", """
WITH rows AS (SELECT DISTINCT section_id, document_id, parent_section_id, heading_level FROM section_nodes WHERE section_id IS NOT NULL),
x AS (SELECT r.*, p.document_id AS pd, p.heading_level AS pl FROM rows r LEFT JOIN rows p ON p.section_id = r.parent_section_id WHERE r.parent_section_id IS NOT NULL)
SELECT section_id, 'missing' AS fault FROM x WHERE pd IS NULL UNION ALL SELECT section_id, 'document' FROM x WHERE pd <> document_id UNION ALL SELECT section_id, 'level' FROM x WHERE pl >= heading_level""")
def hie07(spark, sf_dir):
    return hierarchy.link_faults(table(spark, sf_dir, "section_nodes"))


@R.query("hie08", """
WITH a AS (SELECT DISTINCT document_id FROM section_nodes), b AS (SELECT DISTINCT document_id FROM document_md)
SELECT document_id, 'no text' AS fault FROM a ANTI JOIN b USING (document_id) UNION ALL SELECT document_id, 'no section' FROM b ANTI JOIN a USING (document_id)""")
def hie08(spark, sf_dir):
    a = table(spark, sf_dir, "section_nodes").select("document_id").distinct()
    b = md(spark, sf_dir).select("document_id").distinct()
    return a.join(b, "document_id", "left_anti").withColumn("fault", F.lit("no text")).unionByName(b.join(a, "document_id", "left_anti").withColumn("fault", F.lit("no section")))


@R.query("hie09", f"""WITH {HEADS}, r AS (SELECT section_id, level, row_number() OVER (PARTITION BY level ORDER BY length(heading) DESC, section_id) AS rank FROM heads)
SELECT section_id, level, rank FROM r WHERE rank <= 3 ORDER BY level, rank, section_id LIMIT 10""", rank="INT")
def hie09(spark, sf_dir):
    return hierarchy.spot_checks(heads(spark, sf_dir))


NUMBERED = f"""WITH {HEADS}, n AS (SELECT *, regexp_extract(heading, '^([0-9]+(?:\\.[0-9]+)*)\\s', 1) AS number FROM heads),
d AS (SELECT document_id, section_id, level, number, len(string_split(number, '.')) AS depth FROM n WHERE number <> ''),
i AS (SELECT section_id, number, depth, dense_rank() OVER (PARTITION BY document_id ORDER BY depth) AS inferred_level FROM d)"""


@R.query("hie12", NUMBERED + "SELECT section_id, number, depth, inferred_level FROM i", depth="INT", inferred_level="INT")
def hie12(spark, sf_dir):
    return hierarchy.numbered_levels(heads(spark, sf_dir))


@R.query("hie11", NUMBERED + "SELECT h.section_id, least(6, greatest(1, coalesce(i.inferred_level, h.level))) AS level FROM heads h LEFT JOIN i USING (section_id)", level="INT")
def hie11(spark, sf_dir):
    return hierarchy.merged_levels(heads(spark, sf_dir))


@R.query("hie13")
def hie13(spark, sf_dir):
    """Headings scored against the titles of their document's manifest rows."""
    titles = chunking.document_titles(table(spark, sf_dir, "quality_reports"), table(spark, sf_dir, "manifest"))
    return chunking.match_scores(heads(spark, sf_dir).join(titles, "document_id").select("section_id", "heading", "title"))


@R.query("hie14", f"""WITH RECURSIVE {HEADS}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY start, section_id) AS i FROM heads),
r AS (SELECT document_id, section_id, i, [heading] AS stack FROM o WHERE i = 1 UNION ALL SELECT o.document_id, o.section_id, o.i, list_append(list_slice(r.stack, 1, least(o.level - 1, len(r.stack))), o.heading) FROM r JOIN o ON o.document_id = r.document_id AND o.i = r.i + 1)
SELECT section_id, stack FROM r""")
def hie14(spark, sf_dir):
    return hierarchy.position_stacks(heads(spark, sf_dir))
