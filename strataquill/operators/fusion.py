"""Fusion of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(rankings: DataFrame, query: str, item: str, k: int = 60, n: int | None = None, source: str = "source") -> DataFrame:
    """FUS01-FUS04: reciprocal rank fusion of ``(query, item, source, rank)``; of a source only the best rank counts.

    With ``n`` the first n of each query are kept, ranked by score, then best
    rank, then item.
    """
    best = rankings.groupBy(query, item, source).agg(F.min("rank").alias("rank"))
    scored = best.groupBy(query, item).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("score"), F.min("rank").alias("best"))
    if n is None:
        return scored.select(query, item, "score")
    order = Window.partitionBy(query).orderBy(F.desc("score"), "best", item)
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n).select(query, item, "score", "rank")
