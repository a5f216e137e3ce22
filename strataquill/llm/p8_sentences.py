"""Queries of problem 8."""

from __future__ import annotations

from strataquill.llm.sentences import sentences
from strataquill.plans.registry import Registry
from strataquill.session import text_table

R = Registry()


@R.query("p8_found")
def p8_found(spark, sf_dir):
    return sentences(text_table(spark, sf_dir, "documents"))


@R.query("p8_texts")
def p8_texts(spark, sf_dir):
    """Every sentence with its number and its text."""
    found = sentences(text_table(spark, sf_dir, "documents"), with_text=True)
    return found.select("doc_id", "sentence_no", "sentence")
