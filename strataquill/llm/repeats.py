"""Lines that one publisher repeats in many of its documents (problem 3).

Documents with the same letters are collapsed to one cluster first; lines are
exploded and counted once a cluster, with the cluster's number of documents and
its dates carried along, so a text that is republished a thousand times costs
one. ``repeated_keys`` decides by documents (at least ``min_docs`` and at least
``min_share`` of the publisher's documents). ``boilerplate_keys`` decides by
clusters and dates: different texts, not published all on one day, so that a
republished article isn't taken for boilerplate.

Two lines are the same when their letters, in order and in lower case, are the
same; lines with fewer than ``min_letters`` letters never count.

Defined results: a document without text or with a null one has no lines but
counts as a document only if its Markdown is not null; a document without a
publisher is left as it is; rows delivered again count once; one document with
several manifest rows counts for each publisher it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.session import cut_lineage

OUTER = r"(?U)^\s+|\s+$"


def folded(c: Column) -> Column:
    """Lower case without outer blanks; null stays null."""
    return F.lower(F.regexp_replace(c, OUTER, ""))


def letters(line: Column) -> Column:
    """The letters of a line, in order and in lower case."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def publishers(reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(document_id, organization, category)`` through the hash, each once; nulls in the pair leave the row out."""
    pairs = manifest.select(
        F.lower("sha256").alias("hash"), folded(F.col("organization")).alias("organization"), folded(F.col("category")).alias("category")
    ).distinct()
    docs = reports.select("document_id", F.lower("source_sha256").alias("hash")).distinct()
    return docs.join(pairs.where("organization is not null and category is not null"), "hash").select("document_id", "organization", "category").distinct()


def line_keys(markdown: Column, min_letters: int) -> Column:
    """Per line the letters' digest, null for lines with too few letters."""
    return F.transform(F.split(markdown, "\n", -1), lambda x: _digest(letters(x), min_letters))


def _digest(text: Column, min_letters: int) -> Column:
    return F.when(F.length(text) >= min_letters, F.unhex(F.md5(text)))


def publisher_lines(documents: DataFrame, reports: DataFrame, manifest: DataFrame, min_letters: int = 15) -> DataFrame:
    """``(document_id, organization, category, keys, loaded_at)``: the digests of each document's lines.

    They are written once, 16 bytes a line, since counting and marking both read
    them and the texts need not be read twice.
    """
    docs = documents.where("markdown is not null").select("document_id", "loaded_at", line_keys(F.col("markdown"), min_letters).alias("keys"))
    return cut_lineage(docs.join(publishers(reports, manifest), "document_id"))


def repeated_keys(lines: DataFrame, min_docs: int = 3, min_share: float = 0.25, min_clusters: int = 1) -> DataFrame:
    """``(organization, category, key, docs, clusters, dates)`` of the lines repeated excessively."""
    pair = ["organization", "category"]
    totals = lines.groupBy(*pair).agg(F.count("*").alias("all_docs"))
    counted = cluster_counts(text_clusters(lines)).where((F.col("docs") >= min_docs) & (F.col("clusters") >= min_clusters))
    return counted.join(totals, pair).where(F.col("docs") >= F.lit(min_share) * F.col("all_docs")).drop("all_docs")


def text_clusters(lines: DataFrame) -> DataFrame:
    """``(organization, category, cluster, docs, keys, first_day, last_day)``: documents of one publisher with the same set of lines."""
    known = lines.withColumn("keys", F.array_sort(F.array_distinct(F.array_compact("keys"))))
    day = F.to_date("loaded_at")
    return known.groupBy("organization", "category", F.md5(F.concat_ws(",", F.transform("keys", F.hex))).alias("cluster")).agg(
        F.count("*").alias("docs"), F.first("keys").alias("keys"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )


def cluster_counts(clusters: DataFrame) -> DataFrame:
    """``(organization, category, key, docs, clusters, first_day, last_day)`` of every line, each cluster exploded once."""
    rows = clusters.select("organization", "category", "docs", "first_day", "last_day", F.explode("keys").alias("key"))
    return rows.groupBy("organization", "category", "key").agg(F.sum("docs").alias("docs"), F.count("*").alias("clusters"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def boilerplate_keys(lines: DataFrame, min_clusters: int = 3, min_share: float = 0.25) -> DataFrame:
    """As ``repeated_keys``, of the lines that stand in at least ``min_clusters`` and ``min_share`` of the publisher's clusters, on at least two days."""
    pair = ["organization", "category"]
    clusters = text_clusters(lines)
    totals = clusters.groupBy(*pair).agg(F.count("*").alias("all_clusters"))
    counted = cluster_counts(clusters).where((F.col("clusters") >= min_clusters) & (F.col("first_day") < F.col("last_day")))
    return counted.join(totals, pair).where(F.col("clusters") >= F.lit(min_share) * F.col("all_clusters")).drop("all_clusters")


def repeated_lines(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """``(document_id, line_no)`` of every repeated line.

    At most 1/min_share times a document's distinct lines are repeated in a
    publisher, so the right side stays a small part of the lines; Spark
    broadcasts it only where its measured size allows that.
    """
    at = lines.select("document_id", "organization", "category", F.posexplode("keys").alias("line_no", "key")).where("key is not null")
    return at.join(keys.select("organization", "category", "key"), ["organization", "category", "key"], "left_semi").select("document_id", "line_no").distinct()


def without_lines(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``(document_id, text)`` of every document without the found lines; a null text stays null."""
    marks = found.groupBy("document_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("markdown", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    return documents.join(marks, "document_id", "left").select(
        "document_id", F.when(F.col("gone").isNull(), F.col("markdown")).otherwise(F.array_join(kept, "\n")).alias("text")
    )
