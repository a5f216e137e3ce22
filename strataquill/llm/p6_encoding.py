"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.llm import encoding
from strataquill.plans.registry import Registry
from strataquill.session import text_table

R = Registry()


@R.query("p6_ids")
def p6_ids(spark, sf_dir):
    return encoding.encode(text_table(spark, sf_dir, "documents"))


@R.query("p6_lengths")
def p6_lengths(spark, sf_dir):
    """Tokens and characters of every document."""
    ids = p6_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_tokens"))
    return ids.join(text_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_code_points")), "doc_id")


@R.query("p6_round_trip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_round_trip(spark, sf_dir):
    """Every text, encoded and decoded."""
    return encoding.decode(p6_ids(spark, sf_dir))
