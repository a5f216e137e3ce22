"""Offline stand-ins of models, reranking, compression and routing by means."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions.search import holding
from strataquill.operators import lexical, vectors
from strataquill.session import broadcast_small


def hashed_words(tokens: Sequence[Sequence[str] | None], size: int = 64) -> np.ndarray:
    """Signed counts of hashed words, scaled to length 1; zeros for a row without words."""
    out = np.zeros((len(tokens), size))
    known: dict[str, tuple[int, int]] = {}
    for row, words in zip(out, tokens, strict=True):
        for w in words if words is not None else ():
            at = known.get(w)
            if at is None:
                h = hashlib.md5(w.encode("utf-8", "replace")).hexdigest()
                at = known[w] = int(h[:4], 16) % size, 1 if int(h[4], 16) % 2 == 0 else -1
            row[at[0]] += at[1]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def embeddings(rows: DataFrame, key: str, column: Column, embed: Callable[[list], np.ndarray] = hashed_words) -> DataFrame:
    """VEC01: ``(key, embedding)`` by a pluggable embedder, which gets a batch of the column's values (here lists of words).

    A model that wants texts gets a text column; an instruction for queries is
    part of that column.
    """
    source = rows.select(key, column.alias("input"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = embed(b.column(1).to_pylist())
            flat = pa.array(v.ravel())
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], names=[key, "embedding"])

    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, embedding array<double>")


def dense_search(index: DataFrame, key: str, queries: DataFrame, query: str, asked: Column, k: int, embed: Callable[[list], np.ndarray] = hashed_words) -> DataFrame:
    """The dense branch: ``(query, key, score, rank)`` by exact inner products of a token table with a stated query set; scores of 0 or less are dropped."""
    found = vectors.exact_topk(embeddings(queries, query, asked, embed).withColumnRenamed(query, key), embeddings(index, key, F.col("ts"), embed), k, key=key)
    return found.where("score > 0").withColumnRenamed("query_id", query)


def rerank(ranked: DataFrame, queries: DataFrame, documents: DataFrame, n: int, score=None) -> DataFrame:
    """RRK01: the n best by ``score(query, text)``, a pluggable column; by default the share of the query's words found."""
    hits = broadcast_small(ranked.withColumnRenamed("rank", "before").join(queries.select("query_id", F.col("text").alias("query")), "query_id"))
    both = documents.join(hits, "doc_id")
    own = F.array_distinct(lexical.words(F.col("query")))
    share = F.size(F.array_intersect(own, F.array_distinct(lexical.words(F.col("text"))))) / F.size(own)
    scored = both.select("query_id", "doc_id", "before", F.round(share if score is None else score(F.col("query"), F.col("text")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "before"))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= n).select("query_id", "doc_id", "score", "rank")


def compressed(ranked: DataFrame, queries: DataFrame, documents: DataFrame, least: int = 2) -> DataFrame:
    """RRK03: of each hit the sentences that share at least ``least`` words with the query."""
    both = ranked.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(documents, "doc_id")
    own = F.array_distinct(lexical.words(F.col("query"), lexical.STOP_WORDS))
    kept = F.filter(F.split("text", r"(?<=[.!?。])\s*", -1), lambda x: F.size(F.array_intersect(F.array_distinct(lexical.words(x)), F.col("own"))) >= least)
    return both.withColumn("own", own).select("query_id", "doc_id", "rank", F.array_join(kept, " ").alias("passage"))


def keyword_scores(words: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """LEX06: two points for a word in the title, one in the path.

    One automaton finds all words of a stated query set in a text, so rows and
    words are not paired.
    """
    needles = [(r[0], r[0]) for r in words.select("word").distinct().where("word <> ''").collect()]
    parts = [holding(rows.select("id", "title", "local_path", F.lower(c).alias("_text")), "id", "_text", needles, "word", ["title", "local_path"]).withColumn("p", F.lit(p)) for c, p in (("title", 2), ("local_path", 1))]
    hits = parts[0].unionByName(parts[1])
    scores = hits.join(words, "word").groupBy("query_id", "id").agg(F.sum("p").alias("score"))
    return lexical.ranked(scores.where("score > 0"), "query_id", "id", k)


def means(rows: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """The mean vector of each group."""
    parts = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))


def routes(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """RTE06: the group whose mean fits the query best."""
    centers = means(rows).select(F.col("label").cast("bigint").alias("vec_id"), F.col("mean").alias("embedding"))
    best = vectors.exact_topk(queries, centers, 1)
    return best.select("query_id", F.col("vec_id").cast("int").alias("label"))


def two_step(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """REC07: route to a group, then search inside it."""
    routed = routes(queries, rows).join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    dot = F.aggregate(F.zip_with("q", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    found = rows.join(routed, "label").select("query_id", "vec_id", F.round(dot, 6).alias("score"))
    return lexical.ranked(found, "query_id", "vec_id", k)
