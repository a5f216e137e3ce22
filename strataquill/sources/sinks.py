"""Writers: transactional publish, appends, exports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, root: str, least: int = 1) -> str:
    """SNK01: write a run beside the others, check its rows, then point ``_CURRENT`` to it.

    A run of fewer than ``least`` rows stays but isn't pointed to, and the error
    tells. The pointer is replaced by one overwriting rename, so readers see the
    run before or this one, and a crash in between leaves the one before.
    """
    spark = df.sparkSession
    run = f"run-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{run}")
    n = spark.read.parquet(f"{root}/{run}").count()
    if n < least:
        raise ValueError(f"{n} rows written, {least} wanted; {run} isn't published")
    fs, staged = _fs(spark, f"{root}/_CURRENT-{run}")
    out = fs.create(staged, True)
    out.write(run.encode())
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(staged), fs.makeQualified(hadoop.Path(f"{root}/_CURRENT")), over)
    return run


def published(spark: SparkSession, root: str) -> DataFrame:
    """SNK05: the run that is pointed to."""
    fs, pointer = _fs(spark, f"{root}/_CURRENT")
    stream = fs.open(pointer)
    run = bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    stream.close()
    return spark.read.parquet(f"{root}/{run}")


def exists(spark: SparkSession, path: str) -> bool:
    """SNK06: whether a path holds something."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


#: Column that a table of unique keys is partitioned by.
BUCKET = "_bucket"


def append_new(fresh: DataFrame, path: str, key: str, buckets: int = 16) -> None:
    """SNK04, STM02: append rows whose key isn't stored yet; of equal keys in a batch one.

    The table is partitioned by a hash of the key, so a batch reads the keys of
    the partitions that its own fall into and of no others.
    """
    spark = fresh.sparkSession
    rows = fresh.dropDuplicates([key]).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if exists(spark, path):
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most ``buckets``
        known = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).select(key)
        rows = rows.join(known, key, "left_anti")
    rows.repartition(BUCKET).write.partitionBy(BUCKET).mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What ``append_new`` has written."""
    return spark.read.parquet(path).drop(BUCKET)


def statistics(df: DataFrame, key: str) -> DataFrame:
    """SNK06: rows and distinct keys."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"))


def export_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """SNK07, SNK08: JSON lines, optionally a folder for each value of a column."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def page_markdown(cells: DataFrame) -> DataFrame:
    """SNK09: each document as Markdown with a marker before every page, cells in order; blank cells are left out."""
    rows = cells.where("document_id is not null and page_no is not null and trim(text) <> ''").select("document_id", "page_no", "ordinal", "source_ref", "text").distinct()
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "source_ref", "text"))), lambda x: x["text"]), "\n\n")
    pages = rows.groupBy("document_id", "page_no").agg(body.alias("body"))
    text = F.concat(F.lit("<!-- PDF page "), F.col("page_no").cast("string"), F.lit(" -->\n\n"), "body")
    return pages.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", text.alias("text")))), lambda x: x["text"]), "\n\n").alias("markdown"))


def write_canonical(documents: DataFrame, root: str) -> int:
    """SNK10: ``<root>/<id>/document.md`` of every document with Markdown, written by the executors; the number of files.

    The root is an address that all executors reach, of any file system that
    Arrow knows (local or mounted, ``hdfs``, ``s3``, ``gs``, ``abfs``); one that
    can't be opened is an error.
    """
    source = documents.where("document_id is not null and markdown is not null").select("document_id", "markdown")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        address = root if "://" in root else "file://" + root[5:] if root.startswith("file:") else root
        system, folder = fs.FileSystem.from_uri(address)
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system.create_dir(f"{folder}/{d}", recursive=True)
                with system.open_output_stream(f"{folder}/{d}/document.md") as f:
                    f.write(t.encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return source.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
