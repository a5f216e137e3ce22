"""SQLite files: scans in ranges of rows, column descriptions, a writer for small tables.

A file is opened read-only by every task, so it must lie where all executors
reach it. Tables without row ids can't be scanned.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{plain(path)}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def scan(spark: SparkSession, path: str, table: str, schema: str, rows_a_task: int = 1_000_000) -> DataFrame:
    """SRC13: a table's rows; each task reads one range of row ids and only the columns of the schema."""
    with opened(path) as db:
        low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {quoted(table)}").fetchone()
    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(fields)
    names = ", ".join(quoted(n) for n in fields.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                db = sqlite3.connect(f"file:{plain(path)}?mode=ro", uri=True)
                cursor = db.execute(f"SELECT {names} FROM {quoted(table)} WHERE rowid >= ? AND rowid < ?", (at, at + rows_a_task))
                while rows := cursor.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], names=kinds.names)
                db.close()

    starts = spark.range(low, high + 1, rows_a_task, max(1, (high - low) // rows_a_task + 1))
    return starts.mapInArrow(run, schema)


def columns(spark: SparkSession, path: str) -> DataFrame:
    """SRC14: ``(table_name, column_name, type, nullable, default_value, primary_key)`` of every table."""
    with opened(path) as db:
        tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        rows = [(t, name, kind, not required, default, bool(key)) for t in tables for _, name, kind, required, default, key in db.execute(f"PRAGMA table_info({quoted(t)})")]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, nullable boolean, default_value string, primary_key boolean")


def write_table(df: DataFrame, path: str, table: str, columns: str) -> None:
    """A small table as an SQLite file, written by one task, since a file has one writer."""
    n = len(df.columns)
    # the table is there also where no task runs, as for an empty one
    Path(plain(path)).parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(plain(path)) as db:
        db.execute(f"DROP TABLE IF EXISTS {quoted(table)}")
        db.execute(f"CREATE TABLE {quoted(table)} ({columns})")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, done = sqlite3.connect(plain(path)), 0
        db.execute(f"DELETE FROM {quoted(table)}")  # of an attempt before this one
        for b in batches:
            db.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * n)})", zip(*(c.to_pylist() for c in b.columns), strict=True))
            done += b.num_rows
        db.commit()
        db.close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    df.coalesce(1).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
