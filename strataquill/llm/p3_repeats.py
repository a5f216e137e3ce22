"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.llm import repeats
from strataquill.plans.registry import Registry
from strataquill.session import table, text_table

R = Registry()

PUBLISHED = r"""
WITH pub AS (
  SELECT DISTINCT q.document_id, trim(lower(m.organization)) AS organization, trim(lower(m.category)) AS category
  FROM quality_reports q JOIN manifest m ON lower(q.source_sha256) = lower(m.sha256)
  WHERE m.organization IS NOT NULL AND m.category IS NOT NULL),
docs AS (
  SELECT d.document_id, p.organization, p.category, string_split(d.markdown, chr(10)) AS parts
  FROM document_md d JOIN pub p USING (document_id) WHERE d.markdown IS NOT NULL),
lined AS (
  SELECT document_id, organization, category, i - 1 AS line_no, regexp_replace(lower(parts[i]), '[^\p{L}]+', '', 'g') AS key
  FROM docs, unnest(range(1, len(parts) + 1)) AS r(i)),
totals AS (SELECT organization, category, count(*) AS all_docs FROM docs GROUP BY ALL),
counted AS (
  SELECT organization, category, key, count(DISTINCT document_id) AS docs FROM lined WHERE length(key) >= 15 GROUP BY ALL),
often AS (
  SELECT c.* FROM counted c JOIN totals t USING (organization, category) WHERE c.docs >= 3 AND c.docs >= 0.25 * t.all_docs)
"""


def _lines(spark, sf_dir):
    return repeats.publisher_lines(text_table(spark, sf_dir, "document_md"), table(spark, sf_dir, "quality_reports"), table(spark, sf_dir, "manifest"))


@R.query("p3_found", PUBLISHED + "SELECT DISTINCT document_id, CAST(line_no AS INT) AS line_no FROM lined JOIN often USING (organization, category, key)")
def p3_found(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return repeats.repeated_lines(lines, repeats.repeated_keys(lines))


@R.query("p3_counts", PUBLISHED + "SELECT organization, category, docs, count(*) AS lines FROM often GROUP BY ALL")
def p3_counts(spark, sf_dir):
    """How many lines each publisher repeats in how many documents."""
    return repeats.repeated_keys(_lines(spark, sf_dir)).groupBy("organization", "category", "docs").agg(F.count("*").alias("lines"))


DISTINCT = PUBLISHED + """,
sets AS (
  SELECT d.document_id, d.organization, d.category, any_value(m.loaded_at)::DATE AS day, list_sort(list_distinct(coalesce(list(l.key) FILTER (length(l.key) >= 15), []))) AS ks
  FROM docs d JOIN document_md m USING (document_id) LEFT JOIN lined l ON l.document_id = d.document_id AND l.organization = d.organization AND l.category = d.category GROUP BY 1, 2, 3),
clusters AS (SELECT organization, category, ks, min(day) AS first_day, max(day) AS last_day FROM sets GROUP BY 1, 2, 3),
all_clusters AS (SELECT organization, category, count(*) AS n FROM clusters GROUP BY 1, 2),
spread AS (SELECT organization, category, key, count(*) AS n, min(first_day) AS first_day, max(last_day) AS last_day FROM (SELECT organization, category, first_day, last_day, unnest(ks) AS key FROM clusters) GROUP BY 1, 2, 3),
boilerplate AS (SELECT s.* FROM spread s JOIN all_clusters a USING (organization, category) WHERE s.n >= 3 AND first_day < last_day AND s.n >= 0.25 * a.n)
"""


@R.query("p3_boilerplate", DISTINCT + "SELECT DISTINCT document_id, CAST(line_no AS INT) AS line_no FROM lined JOIN boilerplate USING (organization, category, key)")
def p3_boilerplate(spark, sf_dir):
    """Lines repeated over distinct texts and days: what a publisher prints, not what it publishes again."""
    lines = _lines(spark, sf_dir)
    return repeats.repeated_lines(lines, repeats.boilerplate_keys(lines))


@R.query("p3_clean", PUBLISHED + """, marks AS (SELECT DISTINCT document_id, line_no FROM lined JOIN often USING (organization, category, key)),
all_lines AS (SELECT document_id, i - 1 AS line_no, parts[i] AS line FROM (SELECT document_id, string_split(markdown, chr(10)) AS parts FROM document_md WHERE markdown IS NOT NULL), unnest(range(1, len(parts) + 1)) AS r(i)),
kept AS (SELECT document_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM all_lines ANTI JOIN marks USING (document_id, line_no) GROUP BY 1)
SELECT d.document_id, CASE WHEN d.markdown IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text FROM document_md d LEFT JOIN kept k USING (document_id)""")
def p3_clean(spark, sf_dir):
    """Every document without its publisher's repeated lines."""
    lines = _lines(spark, sf_dir)
    found = repeats.repeated_lines(lines, repeats.repeated_keys(lines))
    return repeats.without_lines(text_table(spark, sf_dir, "document_md"), found)
