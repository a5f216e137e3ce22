"""Relational operators of the retrieval programs that are more than one DataFrame call."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.session import cut_lineage


def registry(documents: DataFrame, reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """JOI01, PRJ01: each document with title and source: its URL, else its path.

    The manifest counts once per hash (smallest values where rows differ), so
    the join keeps one row a document; a document without a row has nulls.
    """
    blank_null = lambda c: F.nullif(F.trim(c), F.lit(""))
    by_hash = manifest.groupBy(F.lower("sha256").alias("hash")).agg(
        F.min("title").alias("title"), F.min(F.coalesce(blank_null(F.col("source_url")), blank_null(F.col("local_path")))).alias("source")
    )
    of = reports.where("document_id is not null").groupBy("document_id").agg(F.min(F.lower("source_sha256")).alias("hash"))
    return documents.select("document_id").join(of, "document_id", "left").join(by_hash, "hash", "left").select("document_id", "title", F.col("source"))


def registry_faults(reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """What makes a registry unusable: ``(fault, value)``; none is expected.

    A hash in several manifest rows that differ, a document with several
    sidecars that differ, a row without title or without both URL and path, a
    sidecar without a manifest row. Rows delivered again are one row.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = manifest.where("sha256 is not null").select(F.lower("sha256").alias("hash"), "title", "source_url", "local_path").distinct()
    side = reports.where("document_id is not null").select("document_id", F.lower("source_sha256").alias("hash")).distinct()
    fault = lambda df, name, value: df.select(F.lit(name).alias("fault"), F.col(value).alias("value"))
    return (
        fault(rows.groupBy("hash").count().where("count > 1"), "duplicate manifest hash", "hash")
        .unionByName(fault(side.groupBy("document_id").count().where("count > 1"), "duplicate sidecar", "document_id"))
        .unionByName(fault(rows.where(blank(F.col("title"))), "no title", "hash"))
        .unionByName(fault(rows.where(blank(F.col("source_url")) & blank(F.col("local_path"))), "no source", "hash"))
        .unionByName(fault(side.join(rows.select("hash").distinct(), "hash", "left_anti"), "no manifest row", "document_id"))
        .distinct()
    )


def strict_registry(documents: DataFrame, reports: DataFrame, manifest: DataFrame) -> DataFrame:
    """JOI01 as a gate: the registry of the documents, or an error that names the first faults of their sidecars and rows."""
    own = reports.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    rows = manifest.join(own.select(F.lower("source_sha256").alias("_hash")).distinct(), F.lower("sha256") == F.col("_hash"), "left_semi")
    faults = registry_faults(own, rows).orderBy("fault", "value").limit(5).collect()
    if faults:
        raise ValueError("; ".join(f"{f['fault']}: {f['value']}" for f in faults))
    return registry(documents, reports, manifest)


def machine_bound(path: Column) -> Column:
    """FIL12: whether a path only means something on one machine."""
    return path.rlike(r"^(?:[/\\]|[A-Za-z]:|(?i:file:))")


def first_contained(rows: DataFrame, text: str, terms: Sequence[str]) -> Column:
    """FIL07: the longest of the terms that the text contains, ties in order; null without one."""
    ordered = sorted(terms, key=lambda t: -len(t))
    return F.coalesce(*(F.when(F.col(text).contains(t), F.lit(t)) for t in ordered))


def merge_by_name(rows: DataFrame, name: str, key: str, text: str) -> DataFrame:
    """AGG15: rows of one name merged: the first key stays, all texts are joined in key order."""
    parts = F.array_sort(F.collect_list(F.struct(key, text)))
    return rows.groupBy(name).agg(F.min(key).alias(key), F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias(text))


def top_k(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """SRT02: the first k rows of each group, ranked from 1; the order must break ties."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def global_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Position of every row in one order over all rows, from 1, without one task sorting them all.

    Rows are split by ranges of the order and written; each range is ranked by
    itself and shifted by the number of rows before it, of which there is one
    number a range. The order must break ties.
    """
    split = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = split.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return split.join(F.broadcast(before), "_range").withColumn(name, own + F.col("_before")).drop("_range", "_before")


def sort_by_instruction(rows: DataFrame, instruction: dict[str, str], allowed: Sequence[str], tie: str) -> DataFrame:
    """SRT03: first row after sorting by an instruction of a field and a direction, both validated."""
    field, direction = instruction["field"], instruction.get("direction", "asc")
    if field not in allowed or direction not in ("asc", "desc"):
        raise ValueError(f"can't sort by {field} {direction}")
    return rows.orderBy(F.col(field).asc() if direction == "asc" else F.col(field).desc(), F.col(tie)).limit(1)


#: Nodes of Spark's parsed plans that only read.
READING_NODES = frozenset(
    """
    Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit GlobalLimitAndOffset Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot
    Project Range Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot Window WithWindowDefinition
    """.split()
)
#: Functions that reach beyond the tables of a query.
FORBIDDEN_FUNCTIONS = frozenset("reflect java_method try_reflect".split())


def guarded_select(spark, statement: str, default_limit: int = 100) -> DataFrame:
    """SRT04, T2S04: a single SELECT, limited unless it has a limit of its own.

    Decided on the parsed plan, not on the text: every node must be one of those
    that only read, and a limit counts only at the top of the statement or below
    its common table expressions.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name not in READING_NODES:
            raise ValueError(f"only SELECT statements run, this one has {name}")
        stack += [node.children().apply(i) for i in range(node.children().size())]
        if name == "UnresolvedWith":
            relations = node.cteRelations()
            stack += [relations.apply(i)._2() for i in range(relations.size())]
    called = {w.strip("'").lower() for w in re.findall(r"[\w']+(?=\()", plan.toString())}
    if called & FORBIDDEN_FUNCTIONS:
        raise ValueError(f"{', '.join(sorted(called & FORBIDDEN_FUNCTIONS))} doesn't run")
    top = plan
    while top.getClass().getSimpleName() == "UnresolvedWith":
        top = top.child()
    frame = spark.sql(statement)
    return frame if top.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit") else frame.limit(default_limit)


def interleave(first: DataFrame, second: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """SET08: two rankings in turn, the first list ahead at each rank, each key once, cut to k."""
    both = first.select(group, key, "rank").withColumn("source", F.lit(0)).unionByName(second.select(group, key, "rank").withColumn("source", F.lit(1)))
    best = both.groupBy(group, key).agg(F.min(F.struct("rank", "source")).alias("at"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("at", key))
    return best.withColumn("position", rank).where(F.col("position") <= k).select(group, key, "position")


def hash_copies(rows: DataFrame, key: str, text: str) -> DataFrame:
    """SET07: the first row and the number of copies by MD5 of the full text, of its first 100 and of its first 200 characters."""
    forms = {"full": F.col(text), "100": F.substring(text, 1, 100), "200": F.substring(text, 1, 200)}
    hashes = F.explode(F.array(*(F.struct(F.lit(n).alias("form"), F.md5(c).alias("hash")) for n, c in forms.items())))
    each = rows.where(F.col(text).isNotNull()).select(key, hashes.alias("h"))
    return each.groupBy("h.form", "h.hash").agg(F.min(key).alias(key), F.count("*").alias("copies"))
