"""Structured Streaming forms of batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.operators import markdown
from strataquill.sources import sinks


def arriving_leaves(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, size: int = 768, overlap: int = 96) -> None:
    """STM01, STM02: documents that arrive as Parquet files become leaves; leaves already stored are left out.

    Runs until what is there has been read. A batch that is run again after a
    failure appends nothing twice, since leaf ids depend on content alone.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        sinks.append_new(markdown.leaves(batch, size, overlap), target, "chunk_id")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and time window with a watermark; works on streams and batches."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_once(stream: DataFrame, target: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """What has arrived, transformed and appended as Parquet."""
    each(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
