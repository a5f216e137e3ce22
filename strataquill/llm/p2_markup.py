"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.llm import markup
from strataquill.plans.registry import Registry
from strataquill.session import table, text_table

R = Registry()


def _tables(spark, sf_dir):
    return text_table(spark, sf_dir, "document_md"), table(spark, sf_dir, "quality_reports"), table(spark, sf_dir, "manifest")


@R.query("p2_found")
def p2_found(spark, sf_dir):
    return markup.markup_lines(markup.containers(*_tables(spark, sf_dir)))


@R.query("p2_clean")
def p2_clean(spark, sf_dir):
    """The clean text of every document."""
    return markup.extracted(*_tables(spark, sf_dir)).select("document_id", "text")


@R.query("p2_paths")
def p2_paths(spark, sf_dir):
    """The paths of each host, whether they won and whether their content is kept."""
    return markup.winning_paths(markup.votes(markup.containers(*_tables(spark, sf_dir))))
