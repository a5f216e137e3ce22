"""Lexical retrieval: tokens, BM25, TF-IDF, keyword scores.

Texts are tokenised once; the token table is written and read by statistics and
scoring. A search is a batch over a stated query set: the weights of its terms
form a matrix of bounded size that is broadcast (more queries go in blocks), so
scoring is one pass without a shuffle of postings, and only each batch's best
rows leave the workers. Null and empty texts have no tokens but count as
documents of length 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.session import cut_lineage

#: Largest matrix of query terms times queries that is broadcast at a time, and the largest block of products.
WEIGHT_BYTES, PRODUCT_CELLS = 64 << 20, 4 << 20

#: Words that searches leave out.
STOP_WORDS = "a an and are as at be by for from has in is it its of on or that the this to was were with".split()


def words(text: Column, stop: Sequence[str] = ()) -> Column:
    """LEX01: runs of letters and digits in lower case, without stop words."""
    found = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.filter(found, lambda x: ~x.isin(list(stop))) if stop else found


def white_space_tokens(text: Column) -> Column:
    """LEX03: what white space separates."""
    return F.array_remove(F.split(text, r"\s+"), "")


def postings(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``(key, term, tf)``."""
    return rows.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tokenised(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``(key, ts)`` of every row, written once."""
    return cut_lineage(rows.select(key, tokens.alias("ts")))


def lengths(ts: str = "ts") -> Column:
    return F.coalesce(F.greatest(F.size(ts), F.lit(0)), F.lit(0))


def term_statistics(index: DataFrame) -> tuple[DataFrame, int, float]:
    """``(term, df, raw)`` with the raw idf, the number of documents and their mean length.

    Document frequencies come from each text's distinct tokens, so they shuffle
    one row a term and partition, not one a document and term.
    """
    n, mean = index.agg(F.count("*"), F.avg(lengths())).first()
    df = index.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("raw", F.ln(F.lit(float(n)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)), n, mean or 0.0


def bm25_index(index: DataFrame, key: str, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """LEX02: ``(key, term, weight)`` of a token table; a term in most documents gets ``floor`` times the mean idf."""
    idf, _, avgdl = term_statistics(index)
    mean = idf.agg(F.avg("raw").alias("mean"))
    idf = idf.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    tf = index.select(key, lengths().alias("dl"), F.explode("ts").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    return tf.join(idf, "term").select(key, "term", weight.alias("weight"))


def query_matrices(wanted: DataFrame, query: str, idf: dict[str, float]) -> Iterator[tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """``(query ids, row of each term, weights)`` in blocks of bounded size; ``wanted(query, term, times)`` of a stated query set."""
    ids: list = []
    rows: list[tuple[int, int, float]] = []
    terms: dict[str, int] = {}

    def block() -> tuple[np.ndarray, dict[str, int], np.ndarray]:
        m = np.zeros((len(terms), len(ids)))
        for i, j, w in rows:
            m[i, j] = w
        return np.array(ids), dict(terms), m

    for r in wanted.groupBy(query).agg(F.collect_list(F.struct("term", "times")).alias("x")).orderBy(query).toLocalIterator():
        own = [(x["term"], x["times"] * idf[x["term"]]) for x in r["x"] if x["term"] in idf]
        if ids and (len(terms) + len(own)) * (len(ids) + 1) * 8 > WEIGHT_BYTES:
            yield block()
            ids, rows, terms = [], [], {}
        for term, w in own:
            rows.append((terms.setdefault(term, len(terms)), len(ids), w))
        ids.append(r[query])
    if ids and terms:
        yield block()


def bm25_scores(index: DataFrame, key: str, queries: DataFrame, query: str, asked: Column, kept: Callable, columns: str, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """Rows that ``kept(query ids, keys, scores)`` makes of each batch's scores (keys times queries, rounded to 6 digits)."""
    wanted = postings(queries, query, asked).withColumnRenamed("tf", "times")
    df, _, avgdl = term_statistics(index)
    # one row a wanted term, and one for all other terms, since the mean idf is over all
    of = F.when(F.col("asked"), F.col("term"))
    known = df.join(wanted.select("term", F.lit(True).alias("asked")).distinct(), "term", "left").groupBy(of.alias("term")).agg(F.sum("raw").alias("raw"), F.count("*").alias("n")).collect()
    mean = sum(r["raw"] for r in known) / max(1, sum(r["n"] for r in known))
    idf = {r["term"]: floor * mean if r["raw"] < 0 else r["raw"] for r in known if r["term"] is not None}
    kinds = dict(index.dtypes)[key], dict(queries.dtypes)[query]
    schema = columns.format(key=f"{key} {kinds[0]}", query=f"{query} {kinds[1]}")
    out = None
    for ids, terms, matrix in query_matrices(wanted, query, idf):
        shared = index.sparkSession.sparkContext.broadcast((ids, terms, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, terms, matrix = shared.value
            for batch in batches:
                keys, at, scores = batch.column(0), 0, []
                docs = []
                for ts in batch.column(1).to_pylist():
                    counts: dict[int, int] = {}
                    for t in ts or ():
                        i = terms.get(t)
                        if i is not None:
                            counts[i] = counts.get(i, 0) + 1
                    docs.append((len(ts or ()), counts))
                while at < len(docs):
                    size, end = 0, at
                    while end < len(docs) and (end == at or (size + len(docs[end][1])) * len(ids) <= PRODUCT_CELLS):
                        size += len(docs[end][1])
                        end += 1
                    part = np.zeros((end - at, len(ids)))
                    some = [(j, n, c) for j, (n, c) in enumerate(docs[at:end]) if c]
                    if some:
                        which = np.fromiter((i for _, _, c in some for i in c), np.int64, size)
                        tf = np.fromiter((x for _, _, c in some for x in c.values()), np.float64, size)
                        n_terms = np.array([len(c) for _, _, c in some])
                        dl = np.repeat([n for _, n, _ in some], n_terms)
                        w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                        part[[j for j, _, _ in some]] = np.add.reduceat(matrix[which] * w[:, None], np.cumsum(n_terms) - n_terms, axis=0)
                    scores.append(part)
                    at = end
                if docs:
                    yield kept(ids, keys, np.round(np.concatenate(scores), 6))

        part = index.select(key, "ts").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return index.sparkSession.createDataFrame([], schema) if out is None else out


def ranked(scores: DataFrame, query: str, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def search_index(index: DataFrame, key: str, queries: DataFrame, query: str, asked: Column, k: int) -> DataFrame:
    """LEX02, FIL13: ``(query, key, score, rank)`` by BM25 over a token table; scores of 0 or less are dropped."""

    def kept(ids: np.ndarray, keys: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
        names = np.array(keys.to_pylist())
        rows: list[np.ndarray] = []
        for j in range(len(ids)):
            own = np.flatnonzero(scores[:, j] > 0)
            rows.append(own[np.lexsort((names[own], -scores[own, j]))[:k]] if len(own) > k else own)
        at = np.concatenate(rows)
        of = np.repeat(np.arange(len(ids)), [len(r) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(ids[of].tolist(), pa.string() if ids.dtype.kind == "U" else None), keys.take(pa.array(at)), pa.array(scores[at, of])], names=[query, key, "score"])

    return ranked(bm25_scores(index, key, queries, query, asked, kept, "{query}, {key}, score double"), query, key, k)


def hit_counts(index: DataFrame, key: str, queries: DataFrame, query: str, asked: Column) -> DataFrame:
    """FIL13: ``(query, n)``: how many rows score above 0; summed within each batch."""

    def kept(ids: np.ndarray, keys: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids.tolist()), pa.array((scores > 0).sum(axis=0))], names=[query, "n"])

    counts = bm25_scores(index, key, queries, query, asked, kept, "{query}, n bigint")
    return counts.groupBy(query).agg(F.sum("n").alias("n")).where("n > 0")


def search(rows: DataFrame, key: str, tokens: Column, queries: DataFrame, query: str, asked: Column, k: int) -> DataFrame:
    """LEX02, LEX03: search over texts that are tokenised for it."""
    return search_index(tokenised(rows, key, tokens), key, queries, query, asked, k)


def shared_entities(index: DataFrame, key: str, queries: DataFrame, query: str, asked: Column, k: int, least: int = 2, most: int = 20, letters: int = 4) -> DataFrame:
    """FUS05, GRA05: documents one hop from a query over entities, ``(query, key, score, rank)``.

    An entity is a word of at least ``letters`` letters that ``least`` to
    ``most`` documents hold; a document scores by the entities that it shares
    with the query. The bound on its documents also bounds the join.
    """
    wanted = queries.select(query, F.explode(F.array_distinct(asked)).alias("term")).where(F.length("term") >= letters).distinct()
    held = index.select(key, F.explode(F.array_distinct("ts")).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    entities = held.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(least, most)).select("term")
    scores = held.join(entities, "term").join(wanted, "term").groupBy(query, key).agg(F.count("*").alias("score"))
    return ranked(scores, query, key, k)


def tfidf(rows: DataFrame, key: str, tokens: Column, features: int = 10_000) -> DataFrame:
    """LEX04: unit vectors over one- and two-word terms; the most frequent ``features`` terms of the corpus."""
    two = F.when(F.size("ts") > 1, F.zip_with(F.slice("ts", F.lit(1), F.size("ts") - 1), F.slice("ts", F.lit(2), F.size("ts") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    terms = rows.select(key, tokens.alias("ts")).where("ts is not null").select(key, F.concat("ts", two).alias("ts"))
    tf = cut_lineage(postings(terms, key, F.col("ts")))
    top = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features)
    n = rows.agg(F.count("*").alias("n"))
    w = tf.join(top, "term").crossJoin(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def prefix_search(index: DataFrame, queries: DataFrame, query: str, key: str, prefix: str, k: int, damping: float = 0.7) -> DataFrame:
    """LEX05: terms that begin with the query's prefix, scores damped.

    Joined on the prefix's first two letters, then compared whole.
    """
    wanted = queries.where(F.length(prefix) >= 2).select(query, F.lower(prefix).alias("prefix")).distinct().withColumn("head", F.substring("prefix", 1, 2))
    hits = index.withColumn("head", F.substring("term", 1, 2)).join(wanted, "head").where(F.expr("startswith(term, prefix)"))
    return ranked(hits.groupBy(query, key).agg(F.round(F.sum("weight") * damping, 6).alias("score")).where("score > 0"), query, key, k)
