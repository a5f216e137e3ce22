"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "strataquill") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    For expensive work on the rows of a table that is stored in few files; a
    table of enough splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are expensive to work on."""
    return spread(table(spark, sf_dir, name))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one is
    used only where none is set and Spark runs in a single local process.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="strataquill-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def broadcast_small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` written once, and marked for a broadcast where it was counted to have at most ``most_rows`` rows.

    Beyond that it is joined by a shuffle like any other table. For rows of a few
    hundred bytes, such as rankings of a stated query set.
    """
    from pyspark.sql import functions as F

    written = cut_lineage(df)
    return F.broadcast(written) if written.count() <= most_rows else written


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, for what a query writes and reads again."""
    import uuid

    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(spark.range(1))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
