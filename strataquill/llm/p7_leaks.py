"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.llm.leaks import leaked
from strataquill.plans.registry import Registry
from strataquill.session import table, text_table

R = Registry()


@R.query("p7_found")
def p7_found(spark, sf_dir):
    return leaked(text_table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@R.query("p7_items")
def p7_items(spark, sf_dir):
    """Every gold group with the number of documents it leaked into."""
    groups = table(spark, sf_dir, "eval_items").select("gold_group_id").distinct()
    return groups.join(p7_found(spark, sf_dir).groupBy("gold_group_id").agg(F.count("*").alias("documents")), "gold_group_id", "left").na.fill(0, ["documents"])
