"""Retrieval measures over rankings ``(stage, query_id, doc_id, rank)`` and gold ``(query_id, doc_id)``.

Queries without gold are left out of every denominator; a query that a stage
doesn't answer counts as 0 where the measure is an average over the stage's
answered queries' gold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions.search import holding

#: White space of Unicode, for Java's and for RE2's regular expressions.
BLANKS = r"[\s\x{0B}\x{85}\p{Z}]+"


def spaced(text: str) -> Column:
    """A text with single blanks for runs of white space, none outside."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def containing_whole(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that hold the whole text of a query, white space normalised on both sides; the query set is stated and bounded."""
    needles = queries.select("query_id", spaced("text").alias("text")).where("length(text) > 0").toLocalIterator()
    return holding(documents.select("doc_id", spaced("text").alias("text")), "doc_id", "text", ((r[0], r[1]) for r in needles))


def recall_at(stages: DataFrame, gold: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """EVA01: mean share of a query's gold within the first k."""
    n = gold.groupBy("query_id").agg(F.count("*").alias("n"))
    cuts = F.explode(F.array(*map(F.lit, ks))).alias("k")
    hits = stages.join(gold, ["query_id", "doc_id"]).select("stage", "query_id", "rank", cuts).where("rank <= k").groupBy("stage", "query_id", "k").agg(F.count("*").alias("h"))
    grid = stages.select("stage").distinct().crossJoin(n).select("stage", "query_id", "n", cuts)
    return grid.join(hits, ["stage", "query_id", "k"], "left").groupBy("stage", "k").agg(F.round(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")), 6).alias("recall"))


def mrr(stages: DataFrame, gold: DataFrame, kinds: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """EVA02, EVA06: mean reciprocal rank of the first relevant result, optionally by kind of query."""
    asked = stages.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    marked = asked.join(gold.withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left")
    first = marked.groupBy("stage", "query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("r"))
    if kinds is not None:
        first = first.join(kinds, "query_id")
    return first.groupBy(*by, "stage").agg(F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def coverage(pieces: DataFrame, key: Sequence[str], theta: float) -> DataFrame:
    """EVA03: share of the span [a, b) that pieces [x, y) cover together, by a running maximum."""
    inside = pieces.withColumn("x", F.greatest("x", "a")).withColumn("y", F.least("y", "b")).where("y > x")
    before = F.max("y").over(Window.partitionBy(*key).orderBy("x", "y").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("y") - F.greatest("x", F.coalesce(before, F.col("x"))), F.lit(0))
    sums = inside.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("covered"))
    return sums.select(*key, F.round(F.col("covered") / (F.col("b") - F.col("a")), 6).alias("coverage"), (F.col("covered") >= theta * (F.col("b") - F.col("a"))).alias("hit"))


def coverage_hits(rankings: DataFrame, gold: DataFrame, theta: float = 0.8, k: int = 5) -> DataFrame:
    """EVA03, EVA04: union coverage of gold ``(query_id, source_document, a, b)`` by the first k spans ``(query_id, source_document, rank, x, y)`` of the same source; 0 where there are none."""
    key = ["query_id", "source_document", "a", "b"]
    near = rankings.where(F.col("rank") <= k).select("query_id", "source_document", "x", "y")
    covered = coverage(near.join(gold, ["query_id", "source_document"]), key, theta)
    return gold.join(covered, key, "left").select(*key, F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("hit", F.lit(False)).alias("hit"))


def loss_stage(stages: DataFrame, gold: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """EVA05: the first stage within whose first k a gold document doesn't stand."""
    seen = gold.join(stages.where(F.col("rank") <= k), ["query_id", "doc_id"], "left").groupBy("query_id", "doc_id").agg(F.collect_set("stage").alias("at"))
    lost = F.coalesce(*(F.when(~F.array_contains("at", s), F.lit(s)) for s in order), F.lit("kept"))
    return seen.select("query_id", "doc_id", lost.alias("lost_at"))


def precision_map(stages: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """EVA08: precision within the first k and mean average precision there."""
    asked = stages.where(F.col("rank") <= k).join(gold.select("query_id").distinct(), "query_id", "left_semi")
    hits = asked.join(gold.withColumn("g", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("g", F.lit(0)))
    upto = F.sum("hit").over(Window.partitionBy("stage", "query_id").orderBy("rank"))
    each = hits.withColumn("upto", upto).groupBy("stage", "query_id").agg((F.sum("hit") / F.lit(float(k))).alias("p"), F.coalesce(F.try_divide(F.sum(F.col("hit") * F.col("upto") / F.col("rank")), F.sum("hit")), F.lit(0.0)).alias("ap"))
    return each.groupBy("stage").agg(F.round(F.avg("p"), 6).alias("precision_at_5"), F.round(F.avg("ap"), 6).alias("map"))


def gold_faults(items: DataFrame) -> DataFrame:
    """EVA09: ``(id, fault)`` of gold items: the group's id for several texts, else the item's."""
    of = lambda where, fault: items.where(where).select(F.col("query_id").alias("id"), F.lit(fault).alias("fault"))
    texts = items.groupBy("gold_group_id").agg(F.count_distinct("evidence_text").alias("n")).where("n > 1").select(F.col("gold_group_id").alias("id"), F.lit("several texts").alias("fault"))
    return (
        texts.unionByName(of("page_end < page_start", "page order"))
        .unionByName(of("offset_end <= offset_start", "offset order"))
        .unionByName(of("trim(coalesce(evidence_text, '')) = ''", "no text"))
        .unionByName(of("offset_end > offset_start and offset_end - offset_start <> length(evidence_text)", "not conserved"))
    )
