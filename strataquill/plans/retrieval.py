"""Vector and lexical search, fusion, reranking, recovery and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataquill.operators import evaluation, fusion, lexical, markdown, recovery, rerank, vectors
from strataquill.plans.registry import Registry
from strataquill.session import cut_lineage, table, text_table

R = Registry()
t = table


def q(name, sql=None, **types):
    return R.query(name, sql, **types)


def vecs(s, d):
    rows = t(s, d, "embeddings")
    return rows.where("vec_id % 50 = 0"), rows


E = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
NORM = "sqrt(list_inner_product({0}.embedding::DOUBLE[], {0}.embedding::DOUBLE[]))"


def topk_sql(score, order, k=20, where="true"):
    return f"""SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank
FROM (SELECT q.vec_id AS query_id, v.vec_id, round({score}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND {where}) QUALIFY rank <= {k}"""


@q("vec02", topk_sql(E, "DESC"))
def vec02(s, d):
    return vectors.exact_topk(*vecs(s, d), 20)


@q("joi17", topk_sql(E, "DESC", 3))
def joi17(s, d):
    return vectors.exact_topk(*vecs(s, d), 3)


@q("vec03", topk_sql(f"{E} / ({NORM.format('q')} * {NORM.format('v')})", "DESC", 20, "v.label < 8"))
def vec03(s, d):
    a, b = vecs(s, d)
    return vectors.exact_topk(a, b.where("label < 8"), 20, "cosine")


@q("vec04", topk_sql(f"sqrt(greatest(0, list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) + list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) - 2 * {E}))", "", 20, "v.vec_id <> q.vec_id"))
def vec04(s, d):
    """The query itself is left out: its distance is 0 but for rounding."""
    found = vectors.exact_topk(*vecs(s, d), 21, "l2").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("bigint")).where("rank <= 20")


@q("vec05")
def vec05(s, d):
    """Approximate search, each vector under its two nearest cells."""
    a, b = vecs(s, d)
    c = vectors.centroids(b, 16)
    return vectors.probed_topk(a, vectors.cell_index(b, c, 2), c, 8, 10)


@q("vec06")
def vec06(s, d):
    a, b = vecs(s, d)
    c = vectors.centroids(b, 16)
    return vectors.probed_topk(a, vectors.cell_index(b, c), c, 12, 10)


@q("vec07", f"SELECT q.label AS a, v.label AS b, round(avg({E}), 6) AS mean, round(max({E}), 6) AS most FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 GROUP BY 1, 2")
def vec07(s, d):
    """Likeness of every stated query with every vector, summed up by label within each batch."""
    a, b = vecs(s, d)
    return vectors.likeness_by_group(a, b, "label")


@q("vec08", f"SELECT 'ip' AS mode, * FROM ({topk_sql(E, 'DESC', 5)}) UNION ALL SELECT 'filtered', * FROM ({topk_sql(E, 'DESC', 5, 'v.label = q.label')})")
def vec08(s, d):
    """Search modes side by side."""
    a, b = vecs(s, d)
    plain = vectors.exact_topk(a, b, 5).withColumn("mode", F.lit("ip"))
    labels = [r[0] for r in a.select("label").distinct().collect()]  # of the stated queries
    parts = [vectors.exact_topk(a.where(F.col("label") == k), b.where(F.col("label") == k), 5) for k in sorted(labels)]
    own = parts[0]
    for p in parts[1:]:
        own = own.unionByName(p)
    return plain.unionByName(own.withColumn("mode", F.lit("filtered")))


# --- lexical ------------------------------------------------------------------------------------------------------------------------

WORDS = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
SPACED = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
QUERIES = "queries AS (SELECT DISTINCT gold_group_id AS query_id, evidence_text AS text FROM eval_items)"


def bm25_sql(tokens, k):
    return f"""
sized AS (SELECT doc_id, coalesce({tokens.format('text')}, []) AS ts FROM documents),
shape AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM sized),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM sized) GROUP BY 1, 2),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf, shape GROUP BY term, n),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens.format('text')}) AS term FROM queries) GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN qt USING (term), shape GROUP BY 1, 2),
bm25 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= {k})"""


def queries(s, d):
    return t(s, d, "eval_items").select(F.col("gold_group_id").alias("query_id"), F.col("evidence_text").alias("text")).distinct()


def index(s, d, tokens=None):
    """The documents' words, written once."""
    return lexical.tokenised(text_table(s, d, "documents"), "doc_id", lexical.words(F.col("text")) if tokens is None else tokens)


def bm25(s, d, k=20, tokens=None, words=None):
    of = lexical.words(F.col("text")) if tokens is None else tokens
    return lexical.search_index(index(s, d, of) if words is None else words, "doc_id", queries(s, d), "query_id", of, k)


@q("lex01", f"SELECT doc_id, list_filter({WORDS.format('text')}, lambda x: x NOT IN ({', '.join(repr(w) for w in lexical.STOP_WORDS)})) AS tokens FROM documents WHERE text IS NOT NULL")
def lex01(s, d):
    return t(s, d, "documents").where("text is not null").select("doc_id", lexical.words(F.col("text"), lexical.STOP_WORDS).alias("tokens"))


@q("lex02", f"WITH {QUERIES}, {bm25_sql(WORDS, 20)} SELECT query_id, doc_id, score, rank FROM bm25")
def lex02(s, d):
    return bm25(s, d)


@q("lex03", f"WITH {QUERIES}, {bm25_sql(SPACED, 5)} SELECT query_id, doc_id, score, rank FROM bm25")
def lex03(s, d):
    return bm25(s, d, 5, lexical.white_space_tokens(F.col("text")))


@q("fil13", f"WITH {QUERIES}, {bm25_sql(WORDS, 1000000)} SELECT query_id, count(*) AS n FROM bm25 GROUP BY 1")
def fil13(s, d):
    of = lexical.words(F.col("text"))
    return lexical.hit_counts(index(s, d), "doc_id", queries(s, d), "query_id", of)


TFIDF = f"""
ts AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
terms AS (SELECT doc_id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS term FROM ts),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
top AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 10000),
w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN top USING (term), (SELECT count(*) AS n FROM documents)),
vectors AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@q("lex04", f"WITH {TFIDF} SELECT doc_id, count(*) AS terms, round(max(weight), 5) AS most FROM vectors GROUP BY 1")
def lex04(s, d):
    v = lexical.tfidf(text_table(s, d, "documents"), "doc_id", lexical.words(F.col("text")))
    return v.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 5).alias("most"))


@q("vec09", f"WITH {QUERIES}, {TFIDF}, qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({WORDS.format('text')}) AS term FROM queries) GROUP BY 1, 2), x AS (SELECT query_id, doc_id, round(sum(weight * times), 4) AS score FROM vectors JOIN qt USING (term) GROUP BY 1, 2) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0 QUALIFY rank <= 10")
def vec09(s, d):
    """Sparse inner product through postings."""
    v = lexical.tfidf(text_table(s, d, "documents"), "doc_id", lexical.words(F.col("text")))
    wanted = lexical.postings(queries(s, d), "query_id", lexical.words(F.col("text"))).withColumnRenamed("tf", "times")
    scores = v.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("times")), 4).alias("score"))
    return lexical.ranked(scores.where("score > 0"), "query_id", "doc_id", 10)


PREFIXES = "(SELECT DISTINCT query_id, substr(regexp_extract(lower(query), '([a-z]{5,})[^a-z]*$', 1), 1, 5) AS prefix FROM eval_items)"


@q("lex05", f"WITH {QUERIES}, {bm25_sql(WORDS, 1)}, p AS {PREFIXES}, w AS (SELECT doc_id, term, idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS weight FROM tf JOIN idf USING (term), shape), x AS (SELECT query_id, doc_id, round(sum(weight) * 0.7, 6) AS score FROM w JOIN p ON starts_with(term, prefix) WHERE length(prefix) >= 2 GROUP BY 1, 2) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0 QUALIFY rank <= 5")
def lex05(s, d):
    weights = lexical.bm25_index(index(s, d), "doc_id")
    prefixes = t(s, d, "eval_items").select("query_id", F.substring(F.regexp_extract(F.lower("query"), r"([a-z]{5,})[^a-z]*$", 1), 1, 5).alias("prefix"))
    return lexical.prefix_search(weights, prefixes, "query_id", "doc_id", "prefix", 5)


@q("lex06", f"WITH w AS (SELECT query_id, unnest(list_distinct({WORDS.format('query')})) AS word FROM (SELECT DISTINCT query_id, query FROM eval_items)), x AS (SELECT query_id, id, sum(2 * contains(lower(title), word)::INT + contains(lower(local_path), word)::INT) AS score FROM w, (SELECT DISTINCT id, title, local_path FROM manifest WHERE title IS NOT NULL AND local_path IS NOT NULL) GROUP BY 1, 2) SELECT query_id, id, score::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x WHERE score > 0 QUALIFY rank <= 3")
def lex06(s, d):
    """Two points for a word in the title, one for a word in the path."""
    items = t(s, d, "eval_items").select("query_id", F.explode(F.array_distinct(lexical.words(F.col("query")))).alias("word")).distinct()
    return rerank.keyword_scores(items, t(s, d, "manifest").where("title is not null and local_path is not null").select("id", "title", "local_path").distinct(), 3)


# --- dense branch and fusion --------------------------------------------------------------------------------------------------------


def signs_sql(name, of, key):
    """Signed counts of hashed words, and their length."""
    return f"""{name}v AS (SELECT {key}, b, sum(s) AS x FROM {of} JOIN slots USING (w) GROUP BY 1, 2), {name}n AS (SELECT {key}, sqrt(sum(x * x)) AS n FROM {name}v GROUP BY 1 HAVING n > 0)"""


def dense_sql(k):
    """Exact inner products of hashed words; after ``bm25_sql``, whose tokens it uses."""
    return f"""
dw AS (SELECT doc_id, unnest(ts) AS w FROM sized),
qw AS (SELECT query_id, unnest({WORDS.format('text')}) AS w FROM queries),
slots AS (SELECT w, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS b, CASE WHEN ('0x' || substr(md5(w), 5, 1))::INT % 2 = 0 THEN 1 ELSE -1 END AS s FROM (SELECT w FROM dw UNION SELECT w FROM qw)),
{signs_sql('d', 'dw', 'doc_id')}, {signs_sql('q', 'qw', 'query_id')},
ds AS (SELECT query_id, doc_id, round(sum((q.x / qn.n) * (d.x / dn.n)), 6) AS score FROM qv q JOIN qn USING (query_id) JOIN dv d USING (b) JOIN dn USING (doc_id) GROUP BY 1, 2),
dense AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds WHERE score > 0 QUALIFY rank <= {k})"""


@q("vec01", f"WITH sized AS (SELECT doc_id, {WORDS.format('text')} AS ts FROM documents), dw AS (SELECT doc_id, unnest(ts) AS w FROM sized), slots AS (SELECT DISTINCT w, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS b, CASE WHEN ('0x' || substr(md5(w), 5, 1))::INT % 2 = 0 THEN 1 ELSE -1 END AS s FROM dw), {signs_sql('d', 'dw', 'doc_id')} SELECT doc_id, list(round(coalesce(x / n, 0), 6) ORDER BY i) AS embedding FROM documents, range(0, 64) AS r(i) LEFT JOIN dv ON dv.doc_id = documents.doc_id AND b = i LEFT JOIN dn ON dn.doc_id = documents.doc_id GROUP BY 1".replace("SELECT doc_id, list(", "SELECT documents.doc_id, list(").replace("FROM documents, range(0, 64) AS r(i) LEFT", "FROM (SELECT doc_id, i FROM documents, range(0, 64) AS r(i)) AS documents LEFT"))
def vec01(s, d):
    """Offline stand-in of an embedder: hashed words, unit length."""
    found = rerank.embeddings(text_table(s, d, "documents"), "doc_id", lexical.words(F.col("text")))
    return found.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6) + F.lit(0.0)).alias("embedding"))


def dense(s, d, k=20, words=None):
    return rerank.dense_search(index(s, d) if words is None else words, "doc_id", queries(s, d), "query_id", lexical.words(F.col("text")), k)


BRANCHES = f"WITH {QUERIES}, {bm25_sql(WORDS, 20)}, {dense_sql(20)}, branches AS (SELECT *, 'bm25' AS source FROM bm25 UNION ALL SELECT *, 'dense' FROM dense)"


def branches(s, d, words=None):
    """Dense and BM25, 20 of each, over one token table; written, since stages read them again."""
    words = index(s, d) if words is None else words
    both = dense(s, d, 20, words).withColumn("source", F.lit("dense")).unionByName(bm25(s, d, 20, words=words).withColumn("source", F.lit("bm25")))
    return cut_lineage(both)


def fused_sql(k, n):
    return f"{BRANCHES}, fused AS (SELECT query_id, doc_id, round(sum(1.0 / ({k} + rank)), 6) AS score, min(rank) AS best FROM branches GROUP BY 1, 2) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, doc_id) AS rank FROM fused QUALIFY rank <= {n}"


@q("fus01", fused_sql(60, 20))
def fus01(s, d):
    return fusion.rrf(branches(s, d), "query_id", "doc_id", 60, 20)


@q("fus02", f"{BRANCHES} SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(rank) AS best, max(CASE WHEN source = 'dense' THEN rank END) AS dense_rank, max(CASE WHEN source = 'bm25' THEN rank END) AS bm25_rank FROM branches GROUP BY 1, 2")
def fus02(s, d):
    """Fusion that keeps each source's best rank."""
    rows = branches(s, d)
    of = lambda n: F.min(F.when(F.col("source") == n, F.col("rank"))).alias(f"{n}_rank")
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("score"), F.min("rank").alias("best"), of("dense"), of("bm25"))


@q("fus03", fused_sql(60, 10))
def fus03(s, d):
    return fusion.rrf(branches(s, d), "query_id", "doc_id", 60, 10)


@q("fus04", fused_sql(55, 20))
def fus04(s, d):
    """The baseline: dense 20 and BM25 20, fused with k = 55."""
    return fusion.rrf(branches(s, d), "query_id", "doc_id", 55, 20)


@q("fus05", f"{BRANCHES}, qe AS (SELECT DISTINCT query_id, term FROM qt WHERE length(term) >= 4), held AS (SELECT doc_id, term FROM tf WHERE term IN (SELECT term FROM qe)), ent AS (SELECT term FROM held GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20), hop AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank FROM held JOIN ent USING (term) JOIN qe USING (term) GROUP BY 1, 2 QUALIFY rank <= 20), three AS (SELECT query_id, doc_id, rank FROM branches UNION ALL SELECT query_id, doc_id, rank FROM hop), fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(rank) AS best FROM three GROUP BY 1, 2) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, doc_id) AS rank FROM fused QUALIFY rank <= 10")
def fus05(s, d):
    """Three branches of max(2k, 10) candidates for k = 10: entity graph, vectors, BM25."""
    words = index(s, d)
    hop = lexical.shared_entities(words, "doc_id", queries(s, d), "query_id", lexical.words(F.col("text")), 20).withColumn("source", F.lit("graph"))
    columns = ["query_id", "doc_id", "rank", "source"]
    return fusion.rrf(branches(s, d, words).select(columns).unionByName(hop.select(columns)), "query_id", "doc_id", 60, 10)


# --- reranking and recovery ---------------------------------------------------------------------------------------------------------


@q("rrk01", f"{BRANCHES}, fused AS ({fused_sql(55, 20).split(BRANCHES)[1].replace(', fused AS', 'SELECT * FROM (WITH fused AS', 1)})), x AS (SELECT f.query_id, f.doc_id, f.rank AS before, round(len(list_intersect(list_distinct({WORDS.format('q.text')}), list_distinct({WORDS.format('d.text')}))) / len(list_distinct({WORDS.format('q.text')})), 6) AS score FROM fused f JOIN queries q USING (query_id) JOIN documents d USING (doc_id)) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM x QUALIFY rank <= 5")
def rrk01(s, d):
    """The offline scorer: share of the query's words that the document holds."""
    fused = fusion.rrf(branches(s, d), "query_id", "doc_id", 55, 20)
    return rerank.rerank(fused, queries(s, d), t(s, d, "documents").select("doc_id", "text"), 5)


@q("rrk02", f"SELECT query, document, round(sum(best), 5) AS score FROM (SELECT q.vec_id, q.label AS query, v.label AS document, max({E}) AS best FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2", query="BIGINT", document="BIGINT")
def rrk02(s, d):
    a, b = vecs(s, d)
    return vectors.late_interaction(a, b, "label")


STOPPED = "list_distinct(list_filter(" + WORDS + ", lambda w: w NOT IN (" + ", ".join(repr(w) for w in lexical.STOP_WORDS) + ")))"


@q("rrk03", f"WITH {QUERIES}, {bm25_sql(WORDS, 5)}, own AS (SELECT query_id, {STOPPED.format('text')} AS own FROM queries) SELECT b.query_id, b.doc_id, b.rank, array_to_string(list_filter(string_split(regexp_replace(d.text, '([.!?。])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(list_intersect(list_distinct({WORDS.format('x')}), own)) >= 2), ' ') AS passage FROM bm25 b JOIN own USING (query_id) JOIN documents d USING (doc_id)")
def rrk03(s, d):
    """Extractive compression: the sentences of each hit that share words with the query."""
    return rerank.compressed(bm25(s, d, 5), queries(s, d), t(s, d, "documents").select("doc_id", "text"))


PARENTS = """heads AS (SELECT DISTINCT document_id, section_id, heading_level AS level, heading, source_start AS start, source_end AS "end" FROM section_nodes WHERE kind = 'heading' AND section_id IS NOT NULL AND heading_level BETWEEN 1 AND 6 AND source_start >= 0),
parents AS (SELECT h.document_id, h.section_id, h.level, h.start, h."end", arg_max(p.section_id, (p.start, p.section_id)) AS parent_id FROM heads h LEFT JOIN heads p ON p.document_id = h.document_id AND (p.start, p.section_id) < (h.start, h.section_id) AND p.level < h.level GROUP BY ALL)"""


@q("rec01", f"""WITH RECURSIVE {PARENTS}, up AS (SELECT section_id, section_id AS ancestor_id, 0 AS distance FROM parents UNION ALL SELECT u.section_id, p.parent_id, u.distance + 1 FROM up u JOIN parents p ON p.section_id = u.ancestor_id WHERE p.parent_id IS NOT NULL),
x AS (SELECT u.*, a."end" - a.start AS size FROM up u JOIN heads a ON a.section_id = u.ancestor_id)
SELECT section_id, ancestor_id, size FROM x WHERE size <= 60 QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY size DESC, distance, ancestor_id) = 1""")
def rec01(s, d):
    """The largest section around a hit that stays within a budget of lines."""
    return recovery.within_budget(t(s, d, "section_nodes"), 60, "largest")


HITS = "hits AS (SELECT section_id, document_id, row_number() OVER (ORDER BY length(heading) DESC, section_id) AS rank FROM heads)"


@q("rec02", f"WITH {PARENTS}, {HITS} SELECT p.parent_id, min(rank) AS first_rank, count(*) AS hits FROM hits JOIN parents p USING (section_id) WHERE p.parent_id IS NOT NULL GROUP BY 1")
def rec02(s, d):
    return recovery.by_parent(t(s, d, "section_nodes"))


@q("rec03", f"WITH {PARENTS}, n AS (SELECT section_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY start, section_id) AS i FROM heads) SELECT a.section_id, b.section_id AS neighbour_id FROM n a JOIN n b ON a.document_id = b.document_id AND b.i IN (a.i - 1, a.i + 1)")
def rec03(s, d):
    return recovery.neighbours(t(s, d, "section_nodes"))


@q("rec04", f"WITH {QUERIES}, {bm25_sql(WORDS, 10)} SELECT b.query_id, b.doc_id, b.rank, CASE WHEN b.rank <= 3 THEN CASE WHEN length(d.text) > 300 THEN substr(d.text, 1, 300) || ' …' ELSE d.text END END AS parent FROM bm25 b JOIN documents d USING (doc_id)")
def rec04(s, d):
    cut = F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 300), F.lit(" …"))).otherwise(F.col("text"))
    return bm25(s, d, 10).join(t(s, d, "documents").select("doc_id", "text"), "doc_id").select("query_id", "doc_id", "rank", F.when(F.col("rank") <= 3, cut).alias("parent"))


ROUTED = f"means AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) AS r(i) GROUP BY 1, 2) GROUP BY 1), route AS (SELECT q.vec_id AS query_id, m.label FROM embeddings q, means m WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], m.c), 6) DESC, m.label) = 1)"


@q("rec07", f"WITH {ROUTED} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT r.query_id, v.vec_id, round({E}, 6) AS score FROM route r JOIN embeddings q ON q.vec_id = r.query_id JOIN embeddings v ON v.label = r.label) QUALIFY rank <= 5")
def rec07(s, d):
    """First the group whose mean is nearest, then a search inside it."""
    return rerank.two_step(*vecs(s, d), 5)


@q("vec10", f"WITH x AS ({topk_sql(E, 'DESC', 10)}) SELECT query_id, x.vec_id, rank, n.near FROM x JOIN (SELECT a.vec_id, list(b.vec_id ORDER BY b.vec_id) AS near FROM embeddings a JOIN embeddings b ON a.label = b.label AND abs(a.vec_id - b.vec_id) BETWEEN 1 AND 20 GROUP BY 1) n ON n.vec_id = x.vec_id WHERE rank <= 5")
def vec10(s, d):
    """Search twice as many, add neighbours, cut."""
    a, b = vecs(s, d)
    w = Window.partitionBy("label").orderBy("vec_id").rangeBetween(-20, 20)
    near = b.select("vec_id", F.array_remove(F.array_sort(F.collect_list("vec_id").over(w)), F.col("vec_id")).alias("near")).where("size(near) > 0")
    return vectors.exact_topk(a, b, 10).join(near, "vec_id").where("rank <= 5").select("query_id", "vec_id", "rank", "near")


@q("rte06", f"WITH {ROUTED} SELECT query_id, label FROM route")
def rte06(s, d):
    return rerank.routes(*vecs(s, d))


# --- evaluation ---------------------------------------------------------------------------------------------------------------------

GOLD = "gold AS (SELECT query_id, doc_id FROM (SELECT query_id, trim(regexp_replace(text, '{0}', ' ', 'g')) AS text FROM queries) q JOIN (SELECT doc_id, trim(regexp_replace(text, '{0}', ' ', 'g')) AS text FROM documents) d ON q.text <> '' AND contains(d.text, q.text))".replace("{0}", evaluation.BLANKS)
RERANKED = f"len(list_intersect(list_distinct({WORDS.format('q.text')}), list_distinct({WORDS.format('d.text')}))) / len(list_distinct({WORDS.format('q.text')}))"
STAGES = BRANCHES + f", {GOLD}, fused AS (SELECT query_id, doc_id, round(sum(1.0 / (55 + rank)), 6) AS score, min(rank) AS best FROM branches GROUP BY 1, 2), rrf AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, doc_id) AS rank FROM fused QUALIFY rank <= 20), reranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM (SELECT f.query_id, f.doc_id, f.rank AS before, round({RERANKED}, 6) AS score FROM rrf f JOIN queries q USING (query_id) JOIN documents d USING (doc_id))), stages AS (SELECT source AS stage, query_id, doc_id, rank FROM branches UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM rrf UNION ALL SELECT 'rerank', query_id, doc_id, rank FROM reranked)"
ORDER = ["dense", "bm25", "rrf", "rerank"]


def gold(s, d):
    """Documents that hold the whole evidence of an item, white space normalised."""
    return evaluation.containing_whole(queries(s, d), text_table(s, d, "documents"))


def stages(s, d):
    """Dense, BM25, their fusion (k = 55, 20) and its reranking."""
    rows = branches(s, d)
    columns = ["query_id", "doc_id", "rank"]
    fused = cut_lineage(fusion.rrf(rows, "query_id", "doc_id", 55, 20))
    best = rerank.rerank(fused, queries(s, d), t(s, d, "documents").select("doc_id", "text"), 20)
    single = rows.select(F.col("source").alias("stage"), *columns)
    return cut_lineage(single.unionByName(fused.select(F.lit("rrf").alias("stage"), *columns)).unionByName(best.select(F.lit("rerank").alias("stage"), *columns)))


@q("eva01", STAGES + ", n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), h AS (SELECT stage, s.query_id, k, count(*) AS h FROM stages s JOIN gold USING (query_id, doc_id), (VALUES (5), (10), (20)) AS ks(k) WHERE rank <= k GROUP BY 1, 2, 3) SELECT st.stage, k, round(avg(coalesce(h.h, 0) / n.n), 6) AS recall FROM (SELECT DISTINCT stage FROM stages) st, n, (VALUES (5), (10), (20)) AS ks(k) LEFT JOIN h ON h.stage = st.stage AND h.query_id = n.query_id AND h.k = ks.k GROUP BY 1, 2".replace("LEFT JOIN h ON h.stage = st.stage AND h.query_id = n.query_id AND h.k = ks.k GROUP", "LEFT JOIN h USING (stage, query_id, k) GROUP").replace("FROM (SELECT DISTINCT stage FROM stages) st, n, (VALUES (5), (10), (20)) AS ks(k) LEFT", "FROM (SELECT stage, query_id, n, k FROM (SELECT DISTINCT stage FROM stages), n, (VALUES (5), (10), (20)) AS ks(k)) n LEFT").replace("st.stage, k", "stage, k"))
def eva01(s, d):
    return evaluation.recall_at(stages(s, d), gold(s, d))


@q("eva02", STAGES + " SELECT stage, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM (SELECT stage, query_id, min(CASE WHEN g.doc_id IS NOT NULL THEN rank END) AS r FROM (SELECT * FROM stages WHERE query_id IN (SELECT query_id FROM gold)) s LEFT JOIN gold g USING (query_id, doc_id) GROUP BY 1, 2) GROUP BY 1")
def eva02(s, d):
    return evaluation.mrr(stages(s, d), gold(s, d))


@q("eva03", """WITH g AS (SELECT DISTINCT gold_group_id, offset_start AS a, offset_end AS b FROM eval_items WHERE offset_end > offset_start),
e AS (SELECT gold_group_id, i, a + i * (b - a) // 4 - i * 20 AS x, a + (i + 1) * (b - a) // 4 - i * 20 AS y, a, b FROM g, range(0, 4) AS r(i)),
c AS (SELECT gold_group_id, a, b, i, greatest(x, a) AS x, least(y, b) AS y FROM e),
m AS (SELECT *, greatest(x, coalesce(max(y) OVER (PARTITION BY gold_group_id, a, b ORDER BY x, y, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x)) AS fresh FROM c WHERE y > x)
SELECT gold_group_id, a, b, round(sum(greatest(y - fresh, 0)) / (b - a), 6) AS coverage, sum(greatest(y - fresh, 0)) >= 0.8 * (b - a) AS hit FROM m GROUP BY 1, 2, 3""")
def eva03(s, d):
    """Union coverage of a gold span by several overlapping spans."""
    g = t(s, d, "eval_items").where("offset_end > offset_start").select("gold_group_id", F.col("offset_start").alias("a"), F.col("offset_end").alias("b")).distinct()
    pieces = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("gold_group_id", "a", "b", F.expr("a + i * (b - a) div 4 - i * 20").alias("x"), F.expr("a + (i + 1) * (b - a) div 4 - i * 20").alias("y"))
    return evaluation.coverage(pieces, ["gold_group_id", "a", "b"], 0.8)


@q("eva04", f"WITH {QUERIES}, {bm25_sql(WORDS, 5)}, {GOLD} SELECT query_id, count(g.doc_id) AS recovered, count(*) AS shown FROM bm25 LEFT JOIN gold g USING (query_id, doc_id) GROUP BY 1")
def eva04(s, d):
    g = gold(s, d).withColumn("hit", F.lit(1))
    return bm25(s, d, 5).join(g, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("hit").alias("recovered"), F.count("*").alias("shown"))


@q("eva05", STAGES + " SELECT g.query_id, g.doc_id, CASE WHEN count(CASE WHEN stage = 'dense' AND rank <= 5 THEN 1 END) = 0 THEN 'dense' WHEN count(CASE WHEN stage = 'bm25' AND rank <= 5 THEN 1 END) = 0 THEN 'bm25' WHEN count(CASE WHEN stage = 'rrf' AND rank <= 5 THEN 1 END) = 0 THEN 'rrf' WHEN count(CASE WHEN stage = 'rerank' AND rank <= 5 THEN 1 END) = 0 THEN 'rerank' ELSE 'kept' END AS lost_at FROM gold g LEFT JOIN stages s ON s.query_id = g.query_id AND s.doc_id = g.doc_id GROUP BY 1, 2")
def eva05(s, d):
    return evaluation.loss_stage(stages(s, d), gold(s, d), ORDER, 5)


@q("eva06", STAGES + ", v AS (SELECT DISTINCT gold_group_id AS query_id, variant_type FROM eval_items) SELECT variant_type, stage, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM (SELECT stage, query_id, min(CASE WHEN g.doc_id IS NOT NULL THEN rank END) AS r FROM (SELECT * FROM stages WHERE query_id IN (SELECT query_id FROM gold)) s LEFT JOIN gold g USING (query_id, doc_id) GROUP BY 1, 2) JOIN v USING (query_id) GROUP BY 1, 2")
def eva06(s, d):
    kinds = t(s, d, "eval_items").select(F.col("gold_group_id").alias("query_id"), "variant_type").distinct()
    return evaluation.mrr(stages(s, d), gold(s, d), kinds, ["variant_type"])


def shared_sql(c):
    return f"len(list_intersect(list_distinct({WORDS.format('reference_answer')}), list_distinct({WORDS.format(c)})))"


@q("eva07", f"SELECT variant_type, count(*) AS n, round(avg(coalesce((2 * {shared_sql('evidence_text')} >= len(list_distinct({WORDS.format('reference_answer')})))::INT, 0)), 6) AS faithful, round(avg(coalesce(({shared_sql('query')} > 0)::INT, 0)), 6) AS relevant FROM eval_items WHERE reference_answer IS NOT NULL GROUP BY 1")
def eva07(s, d):
    """Rates of boolean judgements: faithful where the evidence holds half of the answer's words, relevant where the query shares one."""
    of = lambda c: F.array_distinct(lexical.words(F.col(c)))
    shared = lambda c: F.size(F.array_intersect(of("reference_answer"), of(c)))
    rate = lambda ok: F.round(F.avg(F.coalesce(ok.cast("double"), F.lit(0.0))), 6)
    asked = t(s, d, "eval_items").where("reference_answer is not null")
    return asked.groupBy("variant_type").agg(F.count("*").alias("n"), rate((F.col("evidence_text").isNotNull()) & (2 * shared("evidence_text") >= F.size(of("reference_answer")))).alias("faithful"), rate((F.col("query").isNotNull()) & (shared("query") > 0)).alias("relevant"))


@q("eva08", STAGES + ", h AS (SELECT stage, query_id, rank, (g.doc_id IS NOT NULL)::INT AS hit FROM (SELECT * FROM stages WHERE rank <= 5 AND query_id IN (SELECT query_id FROM gold)) s LEFT JOIN gold g USING (query_id, doc_id)), c AS (SELECT *, sum(hit) OVER (PARTITION BY stage, query_id ORDER BY rank) AS upto FROM h) SELECT stage, round(avg(p), 6) AS precision_at_5, round(avg(ap), 6) AS map FROM (SELECT stage, query_id, sum(hit) / 5.0 AS p, coalesce(sum(hit * upto / rank) / nullif(sum(hit), 0), 0) AS ap FROM c GROUP BY 1, 2) GROUP BY 1")
def eva08(s, d):
    return evaluation.precision_map(stages(s, d), gold(s, d), 5)


def span_coverage(s, d, end):
    """Coverage of the gold spans by the five best sections of each query."""
    spans = markdown.section_spans(text_table(s, d, "document_md"))
    of = lexical.words(F.col("text"))
    found = lexical.search(spans.select("span_id", F.col("content").alias("text")), "span_id", of, queries(s, d), "query_id", of, 5)
    rankings = found.join(spans.select("span_id", F.col("document_id").alias("source_document"), "x", F.col(end).alias("y")), "span_id")
    gold_spans = t(s, d, "eval_items").where("offset_end > offset_start").select(F.col("gold_group_id").alias("query_id"), "source_document", F.col("offset_start").alias("a"), F.col("offset_end").alias("b")).distinct()
    return evaluation.coverage_hits(rankings, gold_spans)


@q("eva03_retrieved")
def eva03_retrieved(s, d):
    """By the retrieved sections' own text."""
    return span_coverage(s, d, "y")


@q("eva04_recovered")
def eva04_recovered(s, d):
    """By what is recovered of them: the sections with their subsections."""
    return span_coverage(s, d, "whole")
