"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.llm.lookalikes import Lookalikes, same_look_pairs
from strataquill.plans.registry import Registry
from strataquill.session import table

R = Registry()


@R.query("p4_found")
def p4_found(spark, sf_dir):
    return same_look_pairs(table(spark, sf_dir, "source_cells"), table(spark, sf_dir, "section_nodes"))


@R.query("p4_cells")
def p4_cells(spark, sf_dir):
    """Every cell with the consistent form of its text and what was unlike."""
    cells = table(spark, sf_dir, "source_cells").select("source_ref", "text").distinct()
    return cells.withColumn("f", Lookalikes(spark).form(F.col("text"))).select("source_ref", F.col("f.form").alias("form"), F.col("f.state").alias("state"))


@R.query("p4_headings")
def p4_headings(spark, sf_dir):
    """Every section with the consistent form of its heading and what was unlike."""
    rows = table(spark, sf_dir, "section_nodes").select("section_id", "heading").distinct()
    return rows.withColumn("f", Lookalikes(spark).form(F.col("heading"))).select("section_id", F.col("f.form").alias("form"), F.col("f.state").alias("state"))
