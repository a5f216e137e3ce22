"""Routing, generation, text-to-SQL and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataquill.operators import answers as op
from strataquill.operators import evaluation, hierarchy, markdown
from strataquill.plans import retrieval
from strataquill.plans.registry import Registry
from strataquill.session import scratch, table
from strataquill.sources import sqlite

R = Registry()
t = table


def q(name, sql=None, **types):
    return R.query(name, sql, **types)


def items(s, d):
    return t(s, d, "eval_items").select("query_id", "query").distinct()


BASE = "i AS (SELECT DISTINCT query_id, query FROM eval_items)"
BM25 = f"{retrieval.QUERIES}, {retrieval.bm25_sql(retrieval.WORDS, 10)}, hits AS (SELECT b.query_id, b.doc_id, b.rank, d.text, d.source FROM bm25 b JOIN documents d USING (doc_id))"


def hits(s, d):
    return retrieval.bm25(s, d, 10).select("query_id", "doc_id", "rank").join(t(s, d, "documents").select("doc_id", "text", "source"), "doc_id")


@q("rte01", f"WITH {BASE} SELECT query_id, CASE WHEN coalesce(trim(query), '') = '' THEN 'unsupported' WHEN regexp_matches(lower(query), 'who are you|help|version') THEN 'system' ELSE 'knowledge' END AS route FROM i")
def rte01(s, d):
    return items(s, d).select("query_id", op.capability(F.col("query")).alias("route"))


@q("rte02", f"WITH {BASE} SELECT query_id, query FROM i")
def rte02(s, d):
    return op.processed(items(s, d))


@q("rte03", f"WITH {BASE} SELECT query_id, CASE WHEN regexp_matches(lower(query), 'which|list|what are') THEN 'list' WHEN regexp_matches(lower(query), 'how|why|what') THEN 'detail' ELSE 'general' END AS kind FROM i")
def rte03(s, d):
    return items(s, d).select("query_id", op.answer_kind(F.col("query")).alias("kind"))


@q("rte04", f"WITH {BASE} SELECT query_id, round((contains(lower(query), 'after')::INT + contains(lower(query), 'of')::INT + contains(lower(query), 'which')::INT) / 3.0, 6) AS ratio, (contains(lower(query), 'after')::INT + contains(lower(query), 'of')::INT + contains(lower(query), 'which')::INT) / 3.0 > 0.3 AS related FROM i")
def rte04(s, d):
    r = op.hit_ratio(F.col("query"), ["after", "of", "which"])
    return items(s, d).select("query_id", F.round(r, 6).alias("ratio"), (r > 0.3).alias("related"))


@q("rte05", f"WITH {BASE} SELECT query_id, greatest(1, (length(query) % 9) // 2)::INT AS traditional, (length(query) % 9 - greatest(1, (length(query) % 9) // 2))::INT AS graph FROM i")
def rte05(s, d):
    return items(s, d).select("query_id", op.split_k(F.length("query") % 9).alias("x")).select("query_id", F.col("x.traditional").cast("int").alias("traditional"), F.col("x.graph").cast("int").alias("graph"))


@q("rte07", f"WITH {BASE} SELECT query_id, CASE WHEN contains(lower(query), 'grinding') THEN 'grinding' WHEN contains(lower(query), 'milling') THEN 'milling' ELSE 'default' END AS branch FROM i")
def rte07(s, d):
    low = F.lower("query")
    return items(s, d).select("query_id", F.when(low.contains("grinding"), "grinding").when(low.contains("milling"), "milling").otherwise("default").alias("branch"))


@q("rte08", f"WITH {BASE} SELECT query_id, trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) AS query FROM i")
def rte08(s, d):
    """A rewrite as one step: lower case, single blanks."""
    return op.processed(items(s, d), [lambda x: x.withColumn("query", F.trim(F.regexp_replace(F.lower("query"), r"\s+", " ")))])


@q("rte09", f"WITH {BASE} SELECT query_id, list_slice(w, 1, 3) AS entities, list_slice(w, 4, 6) AS topics FROM (SELECT query_id, list_filter(string_split(query, ' '), lambda x: x <> '') AS w FROM i WHERE query IS NOT NULL)")
def rte09(s, d):
    return items(s, d).where("query is not null").select("query_id", op.keyword_slices(F.col("query")).alias("x")).select("query_id", "x.entities", "x.topics")


@q("gen01", f"WITH {BM25}, c AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM hits), o AS (SELECT *, max((total > 2000)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS over_it FROM c) SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS blocks FROM o WHERE over_it = 0 GROUP BY 1")
def gen01(s, d):
    return op.context(hits(s, d), "query_id", "text", 2000)


SPLIT = "list_filter(regexp_split_to_array(text, '[.!?]+\\s+'), lambda x: regexp_matches(x, '\\S'))"


@q("gen02", f"""WITH RECURSIVE {BM25},
s AS (SELECT h.query_id, h.rank, h.doc_id, h.text, ss, i, ss[i] AS sentence, len(list_intersect(list_distinct({retrieval.WORDS.format('ss[i]')}), list_distinct({retrieval.WORDS.format('q.text')}))) AS n
  FROM (SELECT *, {SPLIT} AS ss FROM hits) h JOIN queries q USING (query_id), unnest(range(1, len(ss) + 1)) AS r(i)),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY n DESC, i) = 1),
forms AS (SELECT h.query_id, h.rank, h.doc_id, [h.text, array_to_string(list_slice(b.ss, greatest(b.i - 3, 1), b.i + 3), ' '), b.sentence] AS forms FROM hits h LEFT JOIN best b USING (query_id, rank)),
pick AS (SELECT query_id, 0::BIGINT AS rank, NULL::BIGINT AS form, 4000::BIGINT AS left_over FROM queries UNION ALL
  SELECT f.query_id, f.rank, x.form, p.left_over - CASE WHEN x.form IS NULL THEN 0 ELSE length(f.forms[x.form]) END
  FROM pick p JOIN forms f ON f.query_id = p.query_id AND f.rank = p.rank + 1, LATERAL (SELECT min(k) AS form FROM range(1, 4) AS r(k) WHERE length(f.forms[k]) <= p.left_over) x)
SELECT query_id, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS evidence_id, doc_id, ['whole', 'window', 'sentence'][form] AS granularity, forms[form] AS content FROM pick JOIN forms USING (query_id, rank) WHERE form IS NOT NULL""")
def gen02(s, d):
    """The whole document, the best sentence with its neighbours, the sentence, or nothing."""
    asked = hits(s, d).join(retrieval.queries(s, d).select("query_id", F.col("text").alias("asked")), "query_id")
    return op.evidence(op.ladder(asked, "asked", "text"), "query_id", ["whole", "window", "sentence"], 4000)


@q("gen03", f"WITH {BM25}, e AS (SELECT query_id, 'E' || rank AS evidence_id, doc_id FROM hits), a AS (SELECT query_id, unnest(['E1', 'E3', 'E99']) AS evidence_id FROM queries) SELECT a.query_id, a.evidence_id, e.doc_id, e.doc_id IS NOT NULL AS known FROM a LEFT JOIN e ON e.query_id = a.query_id AND e.evidence_id = a.evidence_id")
def gen03(s, d):
    answers = retrieval.queries(s, d).select("query_id", F.lit("So it is [E1], also [E3] and [E99], again [E1].").alias("answer"))
    return op.citations(answers, op.evidence(hits(s, d), "query_id", ["text"], 1 << 30), "query_id")


@q("gen04", f"WITH {BM25}, n AS (SELECT query_id, source, min(rank) AS r FROM hits GROUP BY 1, 2), l AS (SELECT query_id, list(source ORDER BY r) AS names FROM n GROUP BY 1) SELECT query_id, array_to_string(list_slice(names, 1, 3), ', ') || CASE WHEN len(names) > 3 THEN ' and ' || (len(names) - 3) || ' more' ELSE '' END AS answer FROM l")
def gen04(s, d):
    return op.list_answer(hits(s, d), "query_id", "source")


@q("gen05", f"SELECT query_id, string_split(regexp_replace(trim(context, chr(32) || chr(9) || chr(10) || chr(13)), '([.!?。])[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]', '\\1' || chr(1)), chr(1))[1] AS answer FROM ({{GEN01}})".replace("{GEN01}", R.sql["gen01"]))
def gen05(s, d):
    return op.generate(op.context(hits(s, d), "query_id", "text", 2000), "query_id", "context")


@q("gen06", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def gen06(s, d):
    return t(s, d, "events").select("event_id", op.structured(F.col("props"), "k int")["k"].alias("k"))


KB = "kb AS (SELECT 'ddl' AS kind, 'table ' || n AS content FROM (VALUES ('orders'), ('customer'), ('part')) AS v(n) UNION ALL SELECT DISTINCT 'qsql', query FROM eval_items UNION ALL SELECT DISTINCT 'description', title FROM manifest WHERE title IS NOT NULL)"


def knowledge(s, d):
    ddl = s.createDataFrame([("table orders",), ("table customer",), ("table part",)], "content string").select(F.lit("ddl").alias("kind"), "content")
    asked = t(s, d, "eval_items").select(F.lit("qsql").alias("kind"), F.col("query").alias("content")).distinct()
    told = t(s, d, "manifest").where("title is not null").select(F.lit("description").alias("kind"), F.col("title").alias("content")).distinct()
    return ddl.unionByName(asked).unionByName(told)


@q("t2s01", f"WITH {KB} SELECT kind, content FROM kb")
def t2s01(s, d):
    return knowledge(s, d)


T2S_WORDS = "list_distinct(list_filter(" + retrieval.WORDS + ", lambda x: x NOT IN (" + ", ".join(repr(w) for w in op.lexical.STOP_WORDS) + ")))"


@q("t2s02", f"WITH {BASE}, a AS (SELECT query_id, unnest({T2S_WORDS.format('query')}) AS word FROM i), b AS (SELECT id AS example_id, unnest({T2S_WORDS.format('title')}) AS word FROM (SELECT DISTINCT id, title FROM manifest WHERE title IS NOT NULL)), x AS (SELECT query_id, example_id, count(*)::DOUBLE AS score FROM a JOIN b USING (word) GROUP BY 1, 2) SELECT query_id, example_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank FROM x QUALIFY rank <= 3")
def t2s02(s, d):
    examples = t(s, d, "manifest").where("title is not null").select(F.col("id").alias("example_id"), F.col("title").alias("example")).distinct()
    return op.nearest_example(items(s, d).withColumnRenamed("query", "question"), examples, 3)


@q("t2s03", f"WITH {BASE} SELECT query_id, 'SELECT count(*) AS n FROM documents WHERE lower(text) LIKE ' || chr(39) || '%' || regexp_extract(lower(query), '([a-z]{{5,}})', 1) || '%' || chr(39) AS statement FROM i WHERE query IS NOT NULL")
def t2s03(s, d):
    """The offline generator's statement for every question, without its fences."""
    word = F.regexp_extract(F.lower("query"), "([a-z]{5,})", 1)
    raw = F.concat(F.lit("```sql\nSELECT count(*) AS n FROM documents WHERE lower(text) LIKE '%"), word, F.lit("%';\n```"))
    return items(s, d).where("query is not null").select("query_id", op.without_fences(raw).alias("statement"))


@q("t2s04", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def t2s04(s, d):
    t(s, d, "customer").createOrReplaceTempView("customer_asked")
    broken = "```sql\nSELECT c_mktsegment, count(*) AS n FROM customer_askd GROUP BY c_mktsegment\n```"
    return op.answer_by_sql(s, broken, lambda q, _: q.replace("askd", "asked"))


T2S_HITS = f"WITH {BASE}, a AS (SELECT query_id, unnest({T2S_WORDS.format('query')}) AS word FROM i), b AS (SELECT id AS example_id, unnest({T2S_WORDS.format('title')}) AS word FROM (SELECT DISTINCT id, title FROM manifest WHERE title IS NOT NULL)), x AS (SELECT query_id, example_id, count(*)::DOUBLE AS score FROM a JOIN b USING (word) GROUP BY 1, 2), h AS (SELECT query_id, example_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank FROM x QUALIFY rank <= 3)"


@q("t2s05", T2S_HITS + ", m AS (SELECT id, min(title) AS title FROM manifest WHERE title IS NOT NULL GROUP BY 1) SELECT query_id, count(*) AS n, string_agg(title, chr(10) ORDER BY rank) AS context FROM h JOIN m ON id = example_id GROUP BY 1")
def t2s05(s, d):
    """The prompt context: what the search found for each question, in rank order."""
    titles = t(s, d, "manifest").where("title is not null").groupBy(F.col("id").alias("example_id")).agg(F.min("title").alias("title"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"])
    return t2s02(s, d).join(titles, "example_id").groupBy("query_id").agg(F.count("*").alias("n"), F.array_join(ordered, "\n").alias("context"))


def database(s, d):
    """The suppliers as an SQLite file in the shared folder, with keys and defaults."""
    path = scratch(s, "suppliers") + ".sqlite"
    sqlite.write_table(t(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path, "supplier", "s_suppkey INTEGER PRIMARY KEY, s_name TEXT NOT NULL, s_nationkey INTEGER DEFAULT 0, s_acctbal REAL")
    return path


@q("src13", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000")
def src13(s, d):
    """An SQLite table, scanned in ranges of its rows."""
    return sqlite.scan(s, database(s, d), "supplier", "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double").where("s_acctbal > 5000").select("s_suppkey", "s_name")


@q("src14", "SELECT * FROM (VALUES ('supplier', 's_suppkey', 'INTEGER', true, NULL, true), ('supplier', 's_name', 'TEXT', false, NULL, false), ('supplier', 's_nationkey', 'INTEGER', true, '0', false), ('supplier', 's_acctbal', 'REAL', true, NULL, false)) AS v(table_name, column_name, type, nullable, default_value, primary_key)")
def src14(s, d):
    """Columns of the tables of an SQLite file: type, null, default, key."""
    return sqlite.columns(s, database(s, d))


# --- reports ------------------------------------------------------------------------------------------------------------------------


@q("agg09")
def agg09(s, d):
    """Chunking report: leaves, windows, tables, duplicates, gaps."""
    leaves = markdown.leaves(t(s, d, "document_md"))
    w = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1
    return leaves.withColumn("i", w).agg(
        F.count("*").alias("leaves"), F.count_if(F.col("unit") == "window").alias("windows"), F.count_if(F.col("unit") == "table").alias("tables"),
        (F.count("*") - F.count_distinct("chunk_id")).alias("duplicates"), F.count_if(F.col("i") != F.col("chunk_index")).alias("gaps"), F.max(F.length("content")).alias("longest"), F.round(F.avg(F.length("content")), 6).alias("mean"),
    )


@q("agg10", retrieval.PARENTS.join(["WITH RECURSIVE ", ", up AS (SELECT section_id, parent_id AS a, 1 AS d FROM parents WHERE parent_id IS NOT NULL UNION ALL SELECT u.section_id, p.parent_id, u.d + 1 FROM up u JOIN parents p ON p.section_id = u.a WHERE p.parent_id IS NOT NULL), depth AS (SELECT h.section_id, coalesce(max(d), 0) AS depth FROM heads h LEFT JOIN up USING (section_id) GROUP BY 1) SELECT count(*) AS sections, sum((depth = 0)::INT)::BIGINT AS top, max(depth) AS deepest, round(quantile_cont(depth, 0.5), 6) AS p50, round(quantile_cont(depth, 0.95), 6) AS p95 FROM depth"]))
def agg10(s, d):
    """Hierarchy report: sections, top sections, depth."""
    heads = hierarchy.heading_rows(t(s, d, "section_nodes"))
    deep = hierarchy.closure(hierarchy.heading_parents(heads)).groupBy("section_id").agg(F.max("distance").alias("d"))
    rows = heads.join(deep, "section_id", "left").select(F.coalesce("d", F.lit(0)).alias("depth"))
    return rows.agg(F.count("*").alias("sections"), F.count_if(F.col("depth") == 0).alias("top"), F.max("depth").alias("deepest"), F.round(F.percentile("depth", 0.5), 6).alias("p50"), F.round(F.percentile("depth", 0.95), 6).alias("p95"))


@q("eva09", f"""WITH {retrieval.QUERIES}, {retrieval.GOLD},
g AS (SELECT query_id, gold_group_id, evidence_text, page_start, page_end, offset_start, offset_end FROM eval_items UNION ALL SELECT query_id || '#p', gold_group_id || '#p', '', page_end + 1, page_start, offset_end, offset_start FROM eval_items UNION ALL SELECT query_id || '#t', gold_group_id, evidence_text || ' x', page_start, page_end, offset_start, offset_end FROM eval_items WHERE variant_type = 'direct'),
f AS (SELECT gold_group_id AS id, 'several texts' AS fault FROM g GROUP BY 1 HAVING count(DISTINCT evidence_text) > 1 UNION ALL SELECT query_id, 'page order' FROM g WHERE page_end < page_start UNION ALL SELECT query_id, 'offset order' FROM g WHERE offset_end <= offset_start UNION ALL SELECT query_id, 'no text' FROM g WHERE trim(coalesce(evidence_text, '')) = ''
  UNION ALL SELECT query_id, 'not conserved' FROM g WHERE offset_end > offset_start AND offset_end - offset_start <> length(evidence_text) UNION ALL SELECT DISTINCT query_id, 'leaked' FROM gold)
SELECT id, fault FROM f""")
def eva09(s, d):
    """Faults of the gold items and of copies with planted ones: page order, offsets, conservation of text and span, leakage into the corpus."""
    columns = ["query_id", "gold_group_id", "evidence_text", "page_start", "page_end", "offset_start", "offset_end"]
    items_ = t(s, d, "eval_items")
    broken = items_.select(F.concat("query_id", F.lit("#p")).alias("query_id"), F.concat("gold_group_id", F.lit("#p")).alias("gold_group_id"), F.lit("").alias("evidence_text"), (F.col("page_end") + 1).alias("page_start"), F.col("page_start").alias("page_end"), F.col("offset_end").alias("offset_start"), F.col("offset_start").alias("offset_end"))
    other = items_.where("variant_type = 'direct'").withColumn("query_id", F.concat("query_id", F.lit("#t"))).withColumn("evidence_text", F.concat("evidence_text", F.lit(" x")))
    g = items_.select(columns).unionByName(broken).unionByName(other.select(columns))
    return evaluation.gold_faults(g).unionByName(retrieval.gold(s, d).select(F.col("query_id").alias("id"), F.lit("leaked").alias("fault")).distinct())
