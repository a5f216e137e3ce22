"""From hits to bounded context: ancestors within a budget, shared parents, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquill.operators import hierarchy, relational
from strataquill.operators.ordered import carried


def within_budget(sections: DataFrame, budget: int, policy: str = "nearest") -> DataFrame:
    """REC01: for each section the nearest or largest of itself and its ancestors within a budget of lines."""
    heads = hierarchy.heading_rows(sections)
    links = hierarchy.heading_parents(heads)
    own = heads.select("section_id", F.col("section_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    around = own.unionByName(hierarchy.closure(links)).join(heads.select(F.col("section_id").alias("ancestor_id"), (F.col("end") - F.col("start")).alias("size")), "ancestor_id")
    order = [F.desc("size"), F.col("distance")] if policy == "largest" else [F.col("distance")]
    pick = F.row_number().over(Window.partitionBy("section_id").orderBy(*order, "ancestor_id"))
    return around.where(F.col("size") <= budget).withColumn("i", pick).where("i = 1").select("section_id", "ancestor_id", "size")


def by_parent(sections: DataFrame) -> DataFrame:
    """REC02: hits grouped by parent, with the best rank and the number of hits."""
    heads = hierarchy.heading_rows(sections)
    ranks = relational.global_rank(heads, F.desc(F.length("heading")), F.col("section_id")).select("section_id", "rank")
    links = hierarchy.heading_parents(heads).where("parent_id is not null").select("section_id", "parent_id")
    return ranks.join(links, "section_id").groupBy("parent_id").agg(F.min("rank").alias("first_rank"), F.count("*").alias("hits"))


def neighbours(sections: DataFrame) -> DataFrame:
    """REC03: the sections before and after."""
    rows = hierarchy.heading_rows(sections).select("document_id", "section_id", "start")
    here = {"a": F.col("section_id")}
    bucket = F.floor(F.col("start") / hierarchy.BUCKET)
    order = ["start", "section_id"]
    both = [carried(rows, ["document_id"], order, bucket, here, False, later).select("section_id", F.col("a").alias("neighbour_id")) for later in (False, True)]
    return both[0].unionByName(both[1]).where("neighbour_id is not null")
