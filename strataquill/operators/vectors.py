"""Exact and approximate vector search; a search is a batch over a queries frame.

Vectors become one matrix per Arrow batch. The query side is collected into a
broadcast only after its size is checked against ``QUERY_BYTES``; more queries
go in blocks, each a pass of its own. Null vectors and vectors of another
length than the first query's have no score. Ties break by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Largest query matrix that is broadcast at a time.
QUERY_BYTES = 64 << 20


def _scores(kind: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows: queries; larger is better."""
    dot = q @ v.T
    if kind == "ip":
        return dot
    if kind == "cosine":
        return dot / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :], 1e-300)
    if kind == "unit_l2":
        return -np.sqrt(np.maximum(0, 2 - 2 * dot))
    if kind == "l2":
        return -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * dot))
    raise ValueError(f"unknown metric {kind}")


def query_blocks(queries: DataFrame, key: str, vector: str, beside: str | None = None) -> Iterator[tuple]:
    """The queries' ids and matrix (and another column's values), in blocks of bounded size; the driver holds one block at a time."""
    ids, rows, more, size = [], [], [], 0
    columns = [key, vector, *([beside] if beside else [])]

    def block() -> tuple:
        return (np.array(ids), np.stack(rows), *([np.array(more)] if beside else []))

    for r in queries.where(F.col(vector).isNotNull()).select(columns).orderBy(key).toLocalIterator():
        v = np.asarray(r[1], np.float64)
        if ids and size + v.nbytes > QUERY_BYTES:
            yield block()
            ids, rows, more, size = [], [], [], 0
        ids.append(r[0])
        rows.append(v)
        more += [r[2]] if beside else []
        size += v.nbytes
    if ids:
        yield block()


def fitting(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and matrix of a batch's vectors of that many components."""
    ok = pc.equal(pc.list_value_length(batch.column(1)), size)
    own, lists = batch.column(0).filter(ok), batch.column(1).filter(ok)
    return np.array(own.to_pylist()), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "ip", key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """VEC02-VEC04: ``(query_id, key, score, rank)``; the k best of each query.

    Each batch keeps k rows a query, so what is shuffled is bounded by k times
    queries times batches. Distances are returned as such, smaller first.
    """
    spark, out = vectors.sparkSession, None
    source = vectors.where(F.col(vector).isNotNull()).select(key, vector)
    kinds = dict(queries.dtypes)[key], dict(source.dtypes)[key]
    schema = f"query_id {kinds[0]}, {key} {kinds[1]}, s double"
    for ids, matrix in query_blocks(queries, key, vector):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                own, v = fitting(b, q.shape[1])
                if not len(own):
                    continue
                s = np.round(_scores(metric, q, v), digits) + 0.0
                order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :k]
                arrays = [pa.array(np.repeat(ids, order.shape[1]).tolist()), pa.array(own[order].ravel().tolist()), pa.array(np.take_along_axis(s, order, 1).ravel())]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", key, "s"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), key))
    score = F.col("s") if metric in ("ip", "cosine") else -F.col("s") + F.lit(0.0)
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", key, score.alias("score"), F.col("rank").cast("bigint").alias("rank"))


def likeness_by_group(queries: DataFrame, vectors: DataFrame, group: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """VEC07: mean and largest inner product of every group of queries with every group of vectors; ``(a, b, mean, most)``.

    A batch gives one row a pair of groups, so pairs of rows are never shuffled.
    """
    spark, out = vectors.sparkSession, None
    kind = dict(vectors.dtypes)[group]
    source = vectors.where(F.col(vector).isNotNull()).select(group, vector)
    for _, matrix, owners in query_blocks(queries, key, vector, group):
        names, of = np.unique(owners, return_inverse=True)
        shared = spark.sparkContext.broadcast((names, of, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, of, q = shared.value
            for b in batches:
                own, v = fitting(b, q.shape[1])
                if not len(own):
                    continue
                dots = np.round(q @ v.T, 12)
                groups, at = np.unique(own, return_inverse=True)
                rows = [(a, g, dots[np.ix_(of == i, at == j)]) for i, a in enumerate(names.tolist()) for j, g in enumerate(groups.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], b.schema.field(0).type), pa.array([float(r[2].sum()) for r in rows]), pa.array([r[2].size for r in rows], pa.int64()), pa.array([float(r[2].max()) for r in rows])], names=["a", "b", "total", "n", "most"])

        part = source.mapInArrow(run, f"a {kind}, b {kind}, total double, n bigint, most double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"a {kind}, b {kind}, total double, n bigint, most double")
    return out.groupBy("a", "b").agg(F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.round(F.max("most"), 6).alias("most"))


def centroids(vectors: DataFrame, cells: int, key: str = "vec_id", vector: str = "embedding", sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Cells of an inverted file, fitted by k-means on a bounded sample (the smallest key hashes)."""
    rows = vectors.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(key), key).limit(sample).collect()
    x = np.array([r[0] for r in rows], np.float64)
    c = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].mean(axis=0)
    return c


def cell_index(vectors: DataFrame, cells: np.ndarray, copies: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """VEC05, VEC06: every vector under its nearest cell (or its ``copies`` nearest): ``(cell, key, vector)``."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)
    source = vectors.where(F.col(vector).isNotNull()).select(key, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), np.float64)
            near = np.argsort(-(x @ c.T - 0.5 * (c * c).sum(1)), axis=1)[:, :copies]
            at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], names=["cell", key, vector])

    return source.mapInArrow(run, f"cell int, {key} bigint, {vector} array<float>")


def probed_topk(queries: DataFrame, index: DataFrame, cells: np.ndarray, nprobe: int, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best of each query among the vectors of its ``nprobe`` nearest cells, by inner product."""
    probes = cell_index(queries, cells, nprobe, key, vector).select("cell", F.col(key).alias("query_id"), F.col(vector).alias("q"))
    dot = F.aggregate(F.zip_with("q", vector, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    found = index.join(probes, "cell").select("query_id", key, F.round(dot, 6).alias("score")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def late_interaction(queries: DataFrame, documents: DataFrame, group: str, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """RRK02: for each query token the best dot product among a document's tokens, summed over the query's tokens.

    ``group`` names the query or document a token vector belongs to. A batch
    keeps one maximum a query token and document; only those are shuffled.
    """
    spark = documents.sparkSession
    out = None
    source = documents.where(F.col(vector).isNotNull()).select(group, vector)
    for ids, matrix in query_blocks(queries, key, vector):
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                groups = np.array(b.column(0).to_pylist())
                s = q @ np.array(b.column(1).to_pylist(), np.float64).T
                names = np.unique(groups)
                best = np.stack([s[:, groups == g].max(axis=1) for g in names])
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(names))), pa.array(np.repeat(names, len(ids)).astype(np.int64)), pa.array(best.ravel())], names=["token", "document", "s"])

        part = source.mapInArrow(run, "token bigint, document bigint, s double")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("token", "document").agg(F.max("s").alias("s"))
    owner = queries.select(F.col(key).alias("token"), F.col(group).cast("bigint").alias("query"))
    return best.join(owner, "token").groupBy("query", "document").agg(F.round(F.sum("s"), 5).alias("score"))
