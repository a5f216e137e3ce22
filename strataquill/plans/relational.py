"""Filters, projections, joins, aggregations, windows, sorts and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataquill.operators import relational as op
from strataquill.plans.registry import Registry
from strataquill.session import table

R = Registry()

t = table


def q(name, sql, **types):
    return R.query(name, sql, **types)


def r6(c):
    return F.round(c, 6)


# --- filters and projections --------------------------------------------------------------------------------------------------------


@q("fil01", "SELECT doc_id, lang, source FROM documents WHERE category = 'milling' OR lang = 'en'")
def fil01(s, d):
    return t(s, d, "documents").where((F.col("category") == "milling") | (F.col("lang") == "en")).select("doc_id", "lang", "source")


SCORED = "WITH scored AS (SELECT p_partkey, p_brand, p_size, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)"


@q("fil02", SCORED + ", kept AS (SELECT * FROM scored WHERE rank <= 300 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND p_size IS NOT NULL) SELECT p_partkey, rank FROM kept ORDER BY rank LIMIT 100", rank="INT")
def fil02(s, d):
    """Filter after a search that fetches three times as much, then cut."""
    ranked = t(s, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(300)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")))
    return ranked.where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21") & F.col("p_size").isNotNull()).orderBy("rank").limit(100).select("p_partkey", "rank")


DOT = "list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@q("fil03", f"""WITH x AS (SELECT q.vec_id AS query_id, v.vec_id, round({DOT}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.label IN (1, 2, 3))
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM x QUALIFY rank <= 10""")
def fil03(s, d):
    from strataquill.operators import vectors

    rows = t(s, d, "embeddings")
    return vectors.exact_topk(rows.where("vec_id % 50 = 0"), rows.where(F.col("label").isin(1, 2, 3)), 10)


@q("fil04", f"""WITH x AS (SELECT q.vec_id AS query_id, v.vec_id, round({DOT}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.label IN (1, 2, 3)),
a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM x QUALIFY rank <= 10),
y AS (SELECT q.vec_id AS query_id, v.vec_id, round(sqrt(greatest(0, 2 - 2 * {DOT})), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.label IN (1, 2, 3)),
b AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM y QUALIFY rank <= 10)
SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def fil04(s, d):
    """A fused search that applies the filter in every branch."""
    from strataquill.operators import fusion, vectors

    rows = t(s, d, "embeddings")
    queries, kept = rows.where("vec_id % 50 = 0"), rows.where(F.col("label").isin(1, 2, 3))
    a = vectors.exact_topk(queries, kept, 10).withColumn("source", F.lit("ip"))
    b = vectors.exact_topk(queries, kept, 10, "unit_l2").withColumn("source", F.lit("l2"))
    return fusion.rrf(a.unionByName(b), "query_id", "vec_id", 60)


@q("fil05", "SELECT id, title FROM manifest WHERE category = 'alloys'")
def fil05(s, d):
    return t(s, d, "manifest").where("category = 'alloys'").select("id", "title")


@q("fil06", "SELECT p_partkey, p_size FROM part WHERE p_size > 20 AND p_retailprice < 1500 ORDER BY p_size, p_partkey LIMIT 25")
def fil06(s, d):
    """A structured filter specification as a predicate and a limit."""
    spec = {"filters": [("p_size", ">", 20), ("p_retailprice", "<", 1500)], "order": ["p_size", "p_partkey"], "limit": 25}
    compare = {">": lambda c, v: c > v, "<": lambda c, v: c < v, "=": lambda c, v: c == v}
    rows = t(s, d, "part")
    for column, sign, value in spec["filters"]:
        rows = rows.where(compare[sign](F.col(column), value))
    return rows.orderBy(*spec["order"]).limit(spec["limit"]).select("p_partkey", "p_size")


@q("fil07", """SELECT DISTINCT query_id, coalesce(CASE WHEN contains(query, 'laser cutting') THEN 'laser cutting' END, CASE WHEN contains(query, 'hot rolling') THEN 'hot rolling' END, CASE WHEN contains(query, 'grinding') THEN 'grinding' END, CASE WHEN contains(query, 'milling') THEN 'milling' END) AS category FROM eval_items""")
def fil07(s, d):
    items = t(s, d, "eval_items")
    return items.select("query_id", op.first_contained(items, "query", ["milling", "grinding", "hot rolling", "laser cutting"]).alias("category")).distinct()


@q("fil08", "SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND (contains(p_type, 'STEEL') OR contains(p_brand, '3') OR contains(p_name, 'green'))")
def fil08(s, d):
    return t(s, d, "part").where(F.col("p_name").contains("a") & (F.col("p_type").contains("STEEL") | F.col("p_brand").contains("3") | F.col("p_name").contains("green"))).select("p_partkey")


@q("fil09", "SELECT doc_id FROM documents WHERE text <> '' AND len(list_filter(['spindle', 'fixture', 'gauge block'], lambda k: contains(text, k) OR contains(k, text))) > 0")
def fil09(s, d):
    words = F.array(*map(F.lit, ("spindle", "fixture", "gauge block")))
    return t(s, d, "documents").where(F.col("text") != "").where(F.exists(words, lambda k: F.contains(F.col("text"), k) | F.contains(k, F.col("text")))).select("doc_id")


@q("fil10", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey > 10")
def fil10(s, d):
    return t(s, d, "orders").where(F.col("o_totalprice").between(1000, 50000) & (F.col("o_orderkey") > 10)).select("o_orderkey", "o_totalprice")


@q("fil11", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def fil11(s, d):
    events = t(s, d, "events")
    last = events.agg(F.max("ts").alias("last"))  # one row
    return events.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).select("event_id")


@q("fil12", "SELECT document_id, regexp_matches(path, '^([/\\\\]|[A-Za-z]:|[Ff][Ii][Ll][Ee]:)') AS bound FROM document_md")
def fil12(s, d):
    return t(s, d, "document_md").select("document_id", op.machine_bound(F.col("path")).alias("bound"))


@q("fil14", """SELECT l_orderkey, l_linenumber, coalesce(TRY_CAST(regexp_replace(l_quantity || ' pcs', ' pcs$', '') AS DOUBLE), 0)::BIGINT AS quantity,
coalesce(TRY_CAST(l_returnflag AS INT), 0) AS flag FROM lineitem""")
def fil14(s, d):
    """A column with a unit suffix as a number; what isn't one is 0."""
    text = F.concat(F.col("l_quantity").cast("string"), F.lit(" pcs"))
    number = F.coalesce(F.expr("try_cast(x as double)"), F.lit(0.0)).cast("bigint")
    rows = t(s, d, "lineitem").withColumn("x", F.regexp_replace(text, " pcs$", ""))
    return rows.select("l_orderkey", "l_linenumber", number.alias("quantity"), F.coalesce(F.expr("try_cast(l_returnflag as int)"), F.lit(0)).alias("flag"))


@q("prj01", "SELECT id, coalesce(nullif(trim(source_url), ''), nullif(trim(local_path), '')) AS source FROM manifest")
def prj01(s, d):
    blank_null = lambda c: F.nullif(F.trim(c), F.lit(""))
    return t(s, d, "manifest").select("id", F.coalesce(blank_null("source_url"), blank_null("local_path")).alias("source"))


@q("prj02", """SELECT id, CASE WHEN list_contains(string_split(local_path, '/'), 'alloys') THEN 'metal' WHEN list_contains(string_split(local_path, '/'), 'milling') THEN 'cutting' ELSE 'other' END AS area FROM manifest""")
def prj02(s, d):
    parts = F.split("local_path", "/")
    return t(s, d, "manifest").select("id", F.when(F.array_contains(parts, "alloys"), "metal").when(F.array_contains(parts, "milling"), "cutting").otherwise("other").alias("area"))


@q("prj03", """SELECT p_partkey, CASE length(regexp_extract(repeat('*', 1 + p_size % 5) || p_name, '\\*+')) WHEN 1 THEN 'very easy' WHEN 2 THEN 'easy' WHEN 3 THEN 'medium' WHEN 4 THEN 'hard' ELSE 'very hard' END AS difficulty FROM part""")
def prj03(s, d):
    """Length of a run of stars as a label."""
    labels = F.create_map(*(F.lit(x) for kv in enumerate(("very easy", "easy", "medium", "hard", "very hard"), 1) for x in kv))
    run = F.length(F.regexp_extract(F.concat(F.expr("repeat('*', 1 + p_size % 5)"), "p_name"), r"\*+", 0))
    return t(s, d, "part").select("p_partkey", labels[run].alias("difficulty"))


@q("prj04", """SELECT doc_id, CASE WHEN length(x) > 160 THEN substr(x, 1, 160) || '...' ELSE x END AS preview FROM (SELECT doc_id, replace(trim(coalesce(text, '')), chr(10), ' ') AS x FROM documents)""")
def prj04(s, d):
    flat = F.translate(F.trim(F.coalesce("text", F.lit(""))), "\n", " ")
    return t(s, d, "documents").select("doc_id", F.when(F.length(flat) > 160, F.concat(F.substring(flat, 1, 160), F.lit("..."))).otherwise(flat).alias("preview"))


@q("prj05", "SELECT doc_id, substr(coalesce(text, ''), 1, 50) AS cut FROM documents")
def prj05(s, d):
    return t(s, d, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 50).alias("cut"))


# --- joins --------------------------------------------------------------------------------------------------------------------------

REGISTRY = """WITH m AS (SELECT lower(sha256) AS hash, min(title) AS title, min(coalesce(nullif(trim(source_url), ''), nullif(trim(local_path), ''))) AS source FROM manifest GROUP BY 1),
q AS (SELECT document_id, min(lower(source_sha256)) AS hash FROM quality_reports WHERE document_id IS NOT NULL GROUP BY 1)
SELECT d.document_id, m.title, m.source FROM document_md d LEFT JOIN q USING (document_id) LEFT JOIN m USING (hash)"""


@q("joi01", REGISTRY)
def joi01(s, d):
    return op.registry(t(s, d, "document_md"), t(s, d, "quality_reports"), t(s, d, "manifest"))


@q("joi02", """SELECT c.source_ref, n.section_id, m.path FROM (SELECT DISTINCT source_ref, document_id, page_no FROM source_cells) c
JOIN (SELECT DISTINCT section_id, document_id, page_start FROM section_nodes) n ON n.document_id = c.document_id AND n.page_start = c.page_no JOIN document_md m ON m.document_id = c.document_id""")
def joi02(s, d):
    cells = t(s, d, "source_cells").select("source_ref", "document_id", F.col("page_no").alias("page_start")).distinct()
    nodes = t(s, d, "section_nodes").select("section_id", "document_id", "page_start").distinct()
    return cells.join(nodes, ["document_id", "page_start"]).join(t(s, d, "document_md").select("document_id", "path"), "document_id").select("source_ref", "section_id", "path")


@q("joi03", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000")
def joi03(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    return t(s, d, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey").join(c, "o_custkey").join(t(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("o_orderkey", "c_name", "n_name")


@q("joi04", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def joi04(s, d):
    counts = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))  # aggregated before the join
    return t(s, d, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@q("joi05", "SELECT c_custkey FROM customer LEFT JOIN (FROM orders WHERE o_totalprice > 200000) ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def joi05(s, d):
    large = t(s, d, "orders").where("o_totalprice > 200000")
    return t(s, d, "customer").select("c_custkey").join(large.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@q("joi06", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def joi06(s, d):
    ids = t(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t(s, d, "part").select("p_partkey", "p_name").join(ids, "p_partkey", "left_semi")


@q("joi07", """WITH a AS (SELECT DISTINCT document_id, page_no FROM source_cells WHERE from_ocr), b AS (SELECT DISTINCT document_id, page_no FROM source_cells WHERE NOT from_ocr)
SELECT document_id, page_no, a.document_id IS NOT NULL AS has_ocr, b.document_id IS NOT NULL AS has_native,
CASE WHEN a.document_id IS NULL THEN 'native' WHEN b.document_id IS NULL THEN 'ocr' ELSE 'both' END AS decision FROM a FULL JOIN b USING (document_id, page_no)""".replace("SELECT document_id, page_no, a.", "SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.page_no, b.page_no) AS page_no, a.").replace("USING (document_id, page_no)", "ON a.document_id = b.document_id AND a.page_no = b.page_no"))
def joi07(s, d):
    cells = t(s, d, "source_cells").where("document_id is not null and page_no is not null")
    a = cells.where("from_ocr").select("document_id", "page_no").distinct().withColumn("ocr", F.lit(True))
    b = cells.where("not from_ocr").select("document_id", "page_no").distinct().withColumn("native", F.lit(True))
    decision = F.when(F.col("ocr").isNull(), "native").when(F.col("native").isNull(), "ocr").otherwise("both")
    return a.join(b, ["document_id", "page_no"], "full").select("document_id", "page_no", F.col("ocr").isNotNull().alias("has_ocr"), F.col("native").isNotNull().alias("has_native"), decision.alias("decision"))


@q("joi16", """WITH c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
SELECT a.doc_id, b.doc_id AS neighbour_id, b.i - a.i AS shift FROM c a JOIN c b ON a.source = b.source AND b.i - a.i IN (-1, 1)""")
def joi16(s, d):
    """Neighbours by position, n = 1: lag and lead instead of a self-join."""
    w = Window.partitionBy("source").orderBy("doc_id")
    near = t(s, d, "documents").where("source is not null").select("doc_id", F.lag("doc_id").over(w).alias("a"), F.lead("doc_id").over(w).alias("b"))
    rows = near.select("doc_id", F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(-1).alias("k")), F.struct(F.col("b").alias("n"), F.lit(1).alias("k")))).alias("x"))
    return rows.where("x.n is not null").select("doc_id", F.col("x.n").alias("neighbour_id"), F.col("x.k").cast("bigint").alias("shift"))


@q("joi18", """WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1)
SELECT o_orderkey, list_slice(coalesce(parts, []), 1, 3) AS parts FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def joi18(s, d):
    l = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.slice(F.array_sort(F.collect_list("l_partkey")), 1, 3).alias("p"))
    return t(s, d, "orders").select("o_orderkey").join(l, "o_orderkey", "left").select("o_orderkey", F.coalesce("p", F.array().cast("array<bigint>")).alias("parts"))


@q("joi20", "SELECT o_orderkey, o_orderdate, sum(l_quantity) AS quantity, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def joi20(s, d):
    """A lookup per row, decorrelated: aggregated once, joined once."""
    l = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    return t(s, d, "orders").select("o_orderkey", "o_orderdate").join(l, "o_orderkey")


# --- aggregations -------------------------------------------------------------------------------------------------------------------


@q("agg01", "SELECT lang, category, count(*) AS n FROM documents GROUP BY ALL")
def agg01(s, d):
    return t(s, d, "documents").groupBy("lang", "category").agg(F.count("*").alias("n"))


@q("agg02", "SELECT l_partkey, round(sum(l_quantity * l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, l_partkey LIMIT 5")
def agg02(s, d):
    return t(s, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("total")).orderBy(F.desc("total"), "l_partkey").limit(5)


@q("agg03", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def agg03(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@q("agg04", "SELECT round(avg(n), 6) AS mean FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def agg04(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).agg(r6(F.avg("n")).alias("mean"))


@q("agg05", """SELECT lang, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.75), 6) AS p75, round(quantile_cont(length(text), 0.9), 6) AS p90,
round(quantile_cont(length(text), 0.95), 6) AS p95, round(avg(length(text)), 6) AS mean, max(length(text)) AS most, count(text) AS n FROM documents GROUP BY 1""", most="INT")
def agg05(s, d):
    n = F.length("text")
    p = lambda x: r6(F.percentile(n, x))
    return t(s, d, "documents").groupBy("lang").agg(p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.9).alias("p90"), p(0.95).alias("p95"), r6(F.avg(n)).alias("mean"), F.max(n).alias("most"), F.count("text").alias("n"))


@q("agg06", "SELECT " + ", ".join(f"count(CASE WHEN length(text) > {k} THEN 1 END) AS over_{k}" for k in (256, 512, 768, 1024, 2048)) + " FROM documents")
def agg06(s, d):
    return t(s, d, "documents").agg(*(F.count_if(F.length("text") > k).alias(f"over_{k}") for k in (256, 512, 768, 1024, 2048)))


@q("agg07", "SELECT l::INT AS heading_level, count(h.heading_level) AS n FROM range(1, 7) AS r(l) LEFT JOIN (SELECT DISTINCT section_id, heading_level FROM section_nodes WHERE kind = 'heading') h ON h.heading_level = l GROUP BY 1")
def agg07(s, d):
    counts = t(s, d, "section_nodes").where("kind = 'heading'").select("section_id", "heading_level").distinct().groupBy("heading_level").agg(F.count("*").alias("c"))
    levels = s.range(1, 7).select(F.col("id").cast("int").alias("heading_level"))
    return levels.join(counts, "heading_level", "left").select("heading_level", F.coalesce("c", F.lit(0)).alias("n"))


@q("agg08", """SELECT count(*) AS documents, count(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 END) AS empty_texts, sum(length(text)) AS chars, count(DISTINCT source) AS sources,
count(CASE WHEN n_chars <> length(text) THEN 1 END) AS wrong_lengths, count(*) - count(DISTINCT text) - count(CASE WHEN text IS NULL THEN 1 END) AS copies FROM documents""", chars="BIGINT")
def agg08(s, d):
    text = F.col("text")
    return t(s, d, "documents").agg(
        F.count("*").alias("documents"), F.count_if(text.isNull() | (F.trim("text") == "")).alias("empty_texts"), F.sum(F.length("text")).alias("chars"), F.count_distinct("source").alias("sources"),
        F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_lengths"), (F.count("*") - F.count_distinct(F.sha2("text", 256)) - F.count_if(text.isNull())).alias("copies"),
    )


@q("agg11", "SELECT count(section_id) AS n, count(DISTINCT section_id) AS different, count(section_id) - count(DISTINCT section_id) AS again FROM section_nodes")
def agg11(s, d):
    return t(s, d, "section_nodes").agg(F.count("section_id").alias("n"), F.count_distinct("section_id").alias("different"), (F.count("section_id") - F.count_distinct("section_id")).alias("again"))


@q("agg14", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def agg14(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@q("agg15", "SELECT title, min(id) AS id, string_agg(local_path, chr(10) ORDER BY id, local_path) AS local_path FROM (SELECT DISTINCT id, title, local_path FROM manifest WHERE title IS NOT NULL AND local_path IS NOT NULL) GROUP BY 1")
def agg15(s, d):
    return op.merge_by_name(t(s, d, "manifest").where("title is not null and local_path is not null").select("id", "title", "local_path").distinct(), "title", "id", "local_path")


@q("agg16", "SELECT l_orderkey, l_partkey, l_returnflag, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2, 3")
def agg16(s, d):
    """The first of several edges with the same ends and type."""
    return t(s, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_returnflag").agg(F.min("l_linenumber").alias("l_linenumber"))


HITS = "hits AS (SELECT document_id, page_no, source_ref, row_number() OVER (ORDER BY length(text) DESC, source_ref) AS rank FROM (SELECT DISTINCT document_id, page_no, source_ref, text FROM source_cells WHERE contains(text, 'spindle')))"


@q("agg17", f"WITH {HITS} SELECT document_id, count(*) AS hits, min(rank) AS first_rank FROM hits GROUP BY 1")
def agg17(s, d):
    rows = t(s, d, "source_cells").where(F.col("text").contains("spindle")).select("document_id", "page_no", "source_ref", "text").distinct()
    ranked = op.global_rank(rows, F.desc(F.length("text")), F.col("source_ref"))
    return ranked.groupBy("document_id").agg(F.count("*").alias("hits"), F.min("rank").cast("bigint").alias("first_rank"))


@q("rec05", f"WITH {HITS}, p AS (SELECT document_id, count(*) AS hits, min(rank) AS first_rank FROM hits GROUP BY 1) SELECT document_id, row_number() OVER (ORDER BY hits DESC, first_rank) AS position FROM p")
def rec05(s, d):
    parents = agg17(s, d)
    return op.global_rank(parents, F.desc("hits"), F.col("first_rank"), name="position").select("document_id", "position")


@q("agg18", "SELECT count(*) AS n, round(avg(length(text)), 6) AS mean_length, round(avg(n_chars), 6) AS mean_stated FROM documents WHERE text IS NOT NULL")
def agg18(s, d):
    return t(s, d, "documents").where("text is not null").agg(F.count("*").alias("n"), r6(F.avg(F.length("text"))).alias("mean_length"), r6(F.avg("n_chars")).alias("mean_stated"))


@q("agg19", "SELECT count(*) AS n, count(CASE WHEN status = 'ok' THEN 1 END) AS ok, count(CASE WHEN status = 'partial' THEN 1 END) AS part, count(CASE WHEN status IS NULL THEN 1 END) AS missing FROM quality_reports")
def agg19(s, d):
    c = F.col("status")
    return t(s, d, "quality_reports").agg(F.count("*").alias("n"), F.count_if(c == "ok").alias("ok"), F.count_if(c == "partial").alias("part"), F.count_if(c.isNull()).alias("missing"))


@q("agg20", "SELECT document_id, count(DISTINCT page_no) AS pages, count(CASE WHEN from_ocr THEN 1 END) AS ocr_cells, count(CASE WHEN text IS NULL OR text = '' THEN 1 END) AS blank_cells FROM source_cells GROUP BY 1")
def agg20(s, d):
    return t(s, d, "source_cells").groupBy("document_id").agg(F.count_distinct("page_no").alias("pages"), F.count_if("from_ocr").alias("ocr_cells"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("blank_cells"))


@q("agg22", """WITH s AS (SELECT user_id, avg(CASE WHEN isnan(value) THEN NULL ELSE value END) AS m, quantile_cont(value, 0.1) AS low FROM events GROUP BY 1)
SELECT user_id, round(m, 6) AS mean, round(low, 6) AS low, CASE WHEN m IS NULL THEN 'unspecified' WHEN m / 100 < 0.5 THEN 'poor' WHEN m / 100 < 0.8 THEN 'fair' WHEN m / 100 < 0.9 THEN 'good' ELSE 'excellent' END AS grade FROM s""")
def agg22(s, d):
    value = F.when(~F.isnan("value"), F.col("value"))
    rows = t(s, d, "events").groupBy("user_id").agg(F.avg(value).alias("m"), F.percentile("value", 0.1).alias("low"))
    g = F.col("m") / 100
    grade = F.when(F.col("m").isNull(), "unspecified").when(g < 0.5, "poor").when(g < 0.8, "fair").when(g < 0.9, "good").otherwise("excellent")
    return rows.select("user_id", r6("m").alias("mean"), r6("low").alias("low"), grade.alias("grade"))


@q("agg23", "SELECT document_id, page_no, min(bbox.l) AS l, min(bbox.t) AS t, max(bbox.r) AS r, max(bbox.b) AS b FROM source_cells GROUP BY 1, 2")
def agg23(s, d):
    return t(s, d, "source_cells").groupBy("document_id", "page_no").agg(F.min("bbox.l").alias("l"), F.min("bbox.t").alias("t"), F.max("bbox.r").alias("r"), F.max("bbox.b").alias("b"))


@q("agg24", "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def agg24(s, d):
    return t(s, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("spread"), r6(F.percentile("value", 0.95)).alias("p95"))


@q("agg25", "SELECT count(*) AS n, " + ", ".join(f"round(count(CASE WHEN event_type = '{k}' THEN 1 END) / count(*), 6) AS {k}_share" for k in ("click", "view", "purchase")) + " FROM events")
def agg25(s, d):
    return t(s, d, "events").agg(F.count("*").alias("n"), *(r6(F.count_if(F.col("event_type") == k) / F.count("*")).alias(f"{k}_share") for k in ("click", "view", "purchase")))


@q("agg26", "SELECT variant_type, round(avg(CASE WHEN length(reference_answer) > 60 THEN 1.0 ELSE 0.0 END), 6) AS passing FROM eval_items GROUP BY 1")
def agg26(s, d):
    return t(s, d, "eval_items").groupBy("variant_type").agg(r6(F.avg(F.coalesce((F.length("reference_answer") > 60).cast("double"), F.lit(0.0)))).alias("passing"))


# --- windows ------------------------------------------------------------------------------------------------------------------------


@q("win01", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents")
def win01(s, d):
    return t(s, d, "documents").select("doc_id", "source", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("bigint").alias("i"))


@q("win02", "SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win02(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"))


@q("win03", "SELECT source_ref, row_number() OVER (PARTITION BY document_id, page_no, from_ocr ORDER BY ordinal, source_ref) AS i FROM (SELECT DISTINCT source_ref, document_id, page_no, from_ocr, ordinal FROM source_cells)")
def win03(s, d):
    w = Window.partitionBy("document_id", "page_no", "from_ocr").orderBy("ordinal", "source_ref")
    return t(s, d, "source_cells").select("source_ref", "document_id", "page_no", "from_ocr", "ordinal").distinct().select("source_ref", F.row_number().over(w).cast("bigint").alias("i"))


CELLS = "cells AS (SELECT DISTINCT document_id, page_no, ordinal, source_ref, text FROM source_cells WHERE text <> '' AND ordinal IS NOT NULL)"


@q("win05", f"""WITH {CELLS}, e AS (SELECT *, sum(CASE WHEN regexp_matches(p, '[.?!]$') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_no ORDER BY ordinal, source_ref) AS run
  FROM (SELECT *, lag(text, 1, '') OVER (PARTITION BY document_id, page_no ORDER BY ordinal, source_ref) AS p FROM cells))
SELECT document_id, page_no, run, string_agg(text, ' ' ORDER BY ordinal, source_ref) AS sentence FROM e GROUP BY 1, 2, 3""", run="BIGINT")
def win05(s, d):
    """Items of a page merged up to an end mark."""
    w = Window.partitionBy("document_id", "page_no").orderBy("ordinal", "source_ref")
    cells = t(s, d, "source_cells").where("text <> '' and ordinal is not null").select("document_id", "page_no", "ordinal", "source_ref", "text").distinct()
    ends = F.when(F.lag("text", 1, "").over(w).rlike("[.?!]$"), 1).otherwise(0)
    runs = cells.withColumn("e", ends).withColumn("run", F.sum("e").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "source_ref", "text"))), lambda x: x["text"]), " ")
    return runs.groupBy("document_id", "page_no", "run").agg(joined.alias("sentence"))


@q("win06", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem")
def win06(s, d):
    w = Window.partitionBy("l_returnflag", "l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("bigint").alias("rank"))


@q("win07", """WITH m AS (SELECT event_id, user_id, ts, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM events)
SELECT event_id, round(a, 6) AS mean FROM m QUALIFY round(a, 9) > coalesce(round(lag(a) OVER (PARTITION BY user_id ORDER BY ts, event_id), 9), -1e300) AND round(a, 9) > coalesce(round(lead(a) OVER (PARTITION BY user_id ORDER BY ts, event_id), 9), -1e300)""")
def win07(s, d):
    """Peaks of a moving average."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t(s, d, "events").select("event_id", "user_id", "ts", F.avg("value").over(w.rowsBetween(-2, 2)).alias("a"))
    near = rows.select("event_id", "a", F.coalesce(F.lag("a").over(w), F.lit(-1e300)).alias("p"), F.coalesce(F.lead("a").over(w), F.lit(-1e300)).alias("n"))
    return near.where((F.round("a", 9) > F.round("p", 9)) & (F.round("a", 9) > F.round("n", 9))).select("event_id", r6("a").alias("mean"))


@q("win08", f"""WITH {CELLS} SELECT source_ref, CASE WHEN regexp_matches(text, '\\p{{L}}-$') AND n IS NOT NULL THEN regexp_replace(text, '-$', '') || n ELSE text END AS joined
FROM (SELECT *, lead(text) OVER (PARTITION BY document_id, page_no ORDER BY ordinal, source_ref) AS n FROM cells)""")
def win08(s, d):
    """A line that ends in a hyphen takes the next one."""
    w = Window.partitionBy("document_id", "page_no").orderBy("ordinal", "source_ref")
    cells = t(s, d, "source_cells").where("text <> '' and ordinal is not null").select("document_id", "page_no", "ordinal", "source_ref", "text").distinct()
    rows = cells.withColumn("n", F.lead("text").over(w))
    return rows.select("source_ref", F.when(F.col("text").rlike(r"\p{L}-$") & F.col("n").isNotNull(), F.concat(F.regexp_replace("text", "-$", ""), "n")).otherwise(F.col("text")).alias("joined"))


# --- sorts and limits ---------------------------------------------------------------------------------------------------------------


@q("srt01", "SELECT doc_id, source, length(text) AS n FROM documents WHERE text IS NOT NULL ORDER BY n DESC, source, doc_id LIMIT 15", n="INT")
def srt01(s, d):
    return t(s, d, "documents").where("text is not null").select("doc_id", "source", F.length("text").alias("n")).orderBy(F.desc("n"), "source", "doc_id").limit(15)


@q("srt02", "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 5")
def srt02(s, d):
    rows = op.top_k(t(s, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5)
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("bigint").alias("rank"))


@q("srt03", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def srt03(s, d):
    return op.sort_by_instruction(t(s, d, "part"), {"field": "p_retailprice", "direction": "desc"}, ["p_retailprice", "p_size"], "p_partkey").select("p_partkey", "p_retailprice")


@q("srt04", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 100)")
def srt04(s, d):
    t(s, d, "orders").createOrReplaceTempView("orders_guarded")
    return op.guarded_select(s, "SELECT o_orderkey FROM orders_guarded").agg(F.count("*").alias("n"))


@q("srt05", "SELECT section_id, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(heading_level, 999), coalesce(source_start, 999), section_id) AS i FROM (SELECT DISTINCT section_id, document_id, heading_level, source_start FROM section_nodes)")
def srt05(s, d):
    rows = t(s, d, "section_nodes").select("section_id", "document_id", "heading_level", "source_start").distinct()
    w = Window.partitionBy("document_id").orderBy(F.coalesce("heading_level", F.lit(999)), F.coalesce("source_start", F.lit(999)), "section_id")
    return rows.select("section_id", F.row_number().over(w).cast("bigint").alias("i"))


@q("srt06", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey < 12 ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def srt06(s, d):
    return t(s, d, "supplier").where("s_nationkey < 12").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20).select("s_suppkey", "s_acctbal")


@q("srt07", "SELECT source_ref, row_number() OVER (PARTITION BY document_id, page_no ORDER BY bbox.t, bbox.l, source_ref) AS top_left, row_number() OVER (PARTITION BY document_id, page_no ORDER BY bbox.l, bbox.t, source_ref) AS left_top FROM (SELECT DISTINCT source_ref, document_id, page_no, bbox FROM source_cells)")
def srt07(s, d):
    rows = t(s, d, "source_cells").select("source_ref", "document_id", "page_no", F.col("bbox.l").alias("l"), F.col("bbox.t").alias("t")).distinct()
    w = Window.partitionBy("document_id", "page_no")
    nulls = lambda c: F.col(c).asc_nulls_last()
    return rows.select("source_ref", F.row_number().over(w.orderBy(nulls("t"), nulls("l"), "source_ref")).cast("bigint").alias("top_left"), F.row_number().over(w.orderBy(nulls("l"), nulls("t"), "source_ref")).cast("bigint").alias("left_top"))


@q("srt08", "SELECT source, arg_max(doc_id, (length(text), -doc_id)) AS doc_id, max(length(text)) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1", n="INT")
def srt08(s, d):
    return t(s, d, "documents").where("text is not null").groupBy("source").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"), F.max(F.length("text")).alias("n"))


# --- set operations -----------------------------------------------------------------------------------------------------------------

A, B = "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48", "SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.09"


def _sets(s, d):
    l = t(s, d, "lineitem")
    return l.where("l_quantity > 48").select(F.col("l_partkey").alias("k")), l.where("l_discount > 0.09").select(F.col("l_partkey").alias("k"))


@q("set01", f"SELECT k, count(*) AS n FROM ({A} UNION ALL {B}) GROUP BY 1")
def set01(s, d):
    a, b = _sets(s, d)
    return a.unionByName(b).groupBy("k").agg(F.count("*").alias("n"))


@q("set02", f"SELECT k FROM (({A} UNION {B}) EXCEPT SELECT p_partkey FROM part WHERE p_size > 25)")
def set02(s, d):
    a, b = _sets(s, d)
    return a.union(b).distinct().join(t(s, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("k")), "k", "left_anti")


@q("set03", "SELECT (SELECT count(*) FROM ((SELECT document_id FROM document_md EXCEPT SELECT document_id FROM section_nodes) UNION ALL (SELECT document_id FROM section_nodes EXCEPT SELECT document_id FROM document_md))) = 0 AS same")
def set03(s, d):
    a, b = (t(s, d, n).select("document_id").distinct() for n in ("document_md", "section_nodes"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("same"))


@q("set04", "SELECT (SELECT count(*) FROM (SELECT document_id FROM document_md EXCEPT SELECT document_id FROM quality_reports)) = 0 AS subset")
def set04(s, d):
    return t(s, d, "document_md").select("document_id").join(t(s, d, "quality_reports").select("document_id"), "document_id", "left_anti").agg((F.count("*") == 0).alias("subset"))


@q("set05", """WITH o AS (SELECT DISTINCT document_id, page_no FROM source_cells WHERE page_no IS NOT NULL AND from_ocr), e AS (SELECT document_id, unnest(range(1, 1 + max(page_no)))::INT AS page_no FROM o GROUP BY 1)
SELECT document_id, page_no FROM e ANTI JOIN o USING (document_id, page_no)""")
def set05(s, d):
    """Pages up to a document's last scanned one on which no scanned cell stands."""
    seen = t(s, d, "source_cells").where("page_no is not null and from_ocr").select("document_id", "page_no").distinct()
    wanted = seen.groupBy("document_id").agg(F.max("page_no").alias("m")).where("m >= 1").select("document_id", F.explode(F.sequence(F.lit(1), "m")).alias("page_no"))
    return wanted.join(seen, ["document_id", "page_no"], "left_anti")


@q("set06", "SELECT o_orderkey, list(l_suppkey ORDER BY f, l_suppkey) AS suppliers FROM (SELECT l_orderkey AS o_orderkey, l_suppkey, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def set06(s, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])
    return t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_distinct(ordered).alias("suppliers"))


@q("set07", "SELECT min(doc_id) AS doc_id, md5(substr(text, 1, 200)) AS hash, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 2")
def set07(s, d):
    return t(s, d, "documents").where("text is not null").groupBy(F.md5(F.substring("text", 1, 200)).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@q("set07_forms", "SELECT form, min(doc_id) AS doc_id, hash, count(*) AS copies FROM (SELECT doc_id, unnest(['full', '100', '200']) AS form, unnest([md5(text), md5(substr(text, 1, 100)), md5(substr(text, 1, 200))]) AS hash FROM documents WHERE text IS NOT NULL) GROUP BY form, hash")
def set07_forms(s, d):
    """Hashes of the full text, of its first 100 and of its first 200 characters."""
    return op.hash_copies(t(s, d, "documents"), "doc_id", "text")


RANKED = "SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {} DESC, l_partkey) AS rank FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@q("set08", f"""WITH a AS ({RANKED.format('q')}), b AS ({RANKED.format('n')}), u AS (SELECT l_suppkey, l_partkey, min((rank, source)) AS best FROM (SELECT *, 0 AS source FROM a UNION ALL SELECT *, 1 AS source FROM b) GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY best, l_partkey) AS position FROM u QUALIFY position <= 10""")
def set08(s, d):
    sums = t(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    rank = lambda c: sums.withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc(c), "l_partkey")))
    return op.interleave(rank("q"), rank("n"), "l_suppkey", "l_partkey", 10).withColumn("position", F.col("position").cast("bigint"))
