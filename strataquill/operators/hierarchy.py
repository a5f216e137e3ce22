"""Section hierarchies from heading levels, and recovery of section texts.

The nearest earlier or later heading of some level is a running value per
heading level (1 to 6), of which each row takes the one its own level asks for.
No self-join, so a document with very many headings costs sorts of its buckets
of lines, not a square and not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.operators.ordered import carried
from strataquill.session import cut_lineage

LEVELS = range(1, 7)


def heading_rows(sections: DataFrame) -> DataFrame:
    """Headings of ``section_nodes``, each once; rows without id, level or start are none."""
    return (
        sections.where("kind = 'heading' and section_id is not null and heading_level between 1 and 6 and source_start >= 0")
        .select("document_id", "section_id", F.col("heading_level").alias("level"), "heading", F.col("source_start").alias("start"), F.col("source_end").alias("end"))
        .distinct()
    )


#: Lines of a bucket of headings.
BUCKET = 4_096


def _by_level(headings: DataFrame, value: Column, later: bool, inclusive: bool) -> DataFrame:
    """``headings`` with ``x``: for a row of level L the nearest value among rows before (or after) with a level below L (or up to L)."""
    per_level = {f"x{k}": F.when(F.col("level") <= k if inclusive else F.col("level") < k, value) for k in LEVELS}
    found = carried(headings, ["document_id"], ["start", "section_id"], F.floor(F.col("start") / BUCKET), per_level, False, later)
    return found.withColumn("x", F.element_at(F.array(*per_level), F.col("level"))).drop(*per_level)


def section_ends(headings: DataFrame, n_lines: DataFrame) -> DataFrame:
    """STR09, HIE10: where a section ends, and the heading that ends it; ``n_lines(document_id, n_lines)``."""
    rows = _by_level(headings, F.struct("start", "heading"), True, True).join(n_lines, "document_id")
    return rows.select("document_id", "section_id", "level", "start", F.coalesce("x.start", "n_lines").alias("section_end"), F.col("x.heading").alias("next_heading"))


def heading_parents(headings: DataFrame) -> DataFrame:
    """HIE01, JOI15: the nearest earlier heading with a smaller level; null at the top."""
    return _by_level(headings, F.col("section_id"), False, False).select("document_id", "section_id", "level", "start", F.col("x").alias("parent_id"))


def closure(links: DataFrame, max_depth: int = 64) -> DataFrame:
    """HIE04: ``(section_id, ancestor_id, distance)``, nearest first, of links without cycles.

    ``links(section_id, parent_id)``; heading trees are at most six deep, so the
    loop ends after as many joins as the deepest chain has links.
    """
    pairs = cut_lineage(links.where("parent_id is not null").select("section_id", F.col("parent_id").alias("ancestor_id")))
    step, out = pairs.withColumn("distance", F.lit(1)), None
    up = pairs.select(F.col("section_id").alias("ancestor_id"), F.col("ancestor_id").alias("next"))
    for distance in range(1, max_depth + 1):
        out = step if out is None else out.unionByName(step)
        step = step.join(up, "ancestor_id").select("section_id", F.col("next").alias("ancestor_id"), F.lit(distance + 1).alias("distance"))
        if distance >= len(LEVELS) - 1:
            break
    return out


def children(links: DataFrame) -> DataFrame:
    """HIE05: children of each section in document order."""
    return links.where("parent_id is not null").groupBy("document_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("start", "section_id"))).alias("x")).select("document_id", "parent_id", F.col("x.section_id").alias("children"))


def link_faults(sections: DataFrame) -> DataFrame:
    """HIE07: links to no section, across documents, or to a level that isn't smaller."""
    rows = sections.where("section_id is not null").select("section_id", "document_id", "parent_section_id", "heading_level").distinct()
    up = rows.select(F.col("section_id").alias("parent_section_id"), F.col("document_id").alias("parent_document"), F.col("heading_level").alias("parent_level")).dropDuplicates(["parent_section_id"])
    linked = rows.where("parent_section_id is not null").join(up, "parent_section_id", "left")
    checks = {
        "missing": F.col("parent_document").isNull(),
        "document": F.col("parent_document") != F.col("document_id"),
        "level": F.col("parent_level") >= F.col("heading_level"),
    }
    return linked.select("section_id", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in checks.items())))).alias("fault"))


def spot_checks(headings: DataFrame, per_level: int = 3, total: int = 10) -> DataFrame:
    """HIE09: some headings of each level, the longest first, up to a total; a sample report."""
    rank = F.row_number().over(Window.partitionBy("level").orderBy(F.desc(F.length("heading")), "section_id"))
    return headings.withColumn("rank", rank).where(F.col("rank") <= per_level).orderBy("level", "rank", "section_id").limit(total).select("section_id", "level", "rank")


def numbered_levels(headings: DataFrame) -> DataFrame:
    """HIE12: depth of a heading's number, compressed to contiguous levels within its document."""
    number = F.regexp_extract("heading", r"^([0-9]+(?:\.[0-9]+)*)\s", 1)
    rows = headings.withColumn("number", number).where("number <> ''").withColumn("depth", F.size(F.split("number", r"\.")))
    return rows.select("section_id", "number", "depth", F.dense_rank().over(Window.partitionBy("document_id").orderBy("depth")).alias("inferred_level"))


def merged_levels(headings: DataFrame) -> DataFrame:
    """HIE11: the level from numbering where there is one, else that of the style, within 1 to 6."""
    by_number = numbered_levels(headings).select("section_id", "inferred_level")
    return headings.join(by_number, "section_id", "left").select("section_id", F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("inferred_level", "level"))).alias("level"))


def position_stacks(headings: DataFrame) -> DataFrame:
    """HIE14: the stack of heading texts by position: keep the first level - 1 entries, then append.

    The stack's size after row i is the least of i and of level + (i - j) over
    the rows j up to it; the entry at a position is the heading that last made
    the stack as deep as that. Sizes never exceed the levels, so six running
    values give the stack.
    """
    order = Window.partitionBy("document_id").orderBy("start", "section_id")
    rows = headings.withColumn("i", F.row_number().over(order))
    size = F.least("i", F.col("i") + F.min(F.col("level") - F.col("i")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    deep = {f"p{k}": F.when(F.col("size") == k, F.struct("heading")) for k in LEVELS}
    found = carried(rows.withColumn("size", size), ["document_id"], ["start", "section_id"], F.floor(F.col("start") / BUCKET), deep, True)
    return found.select("section_id", F.slice(F.array(*(F.col(f"p{k}.heading") for k in LEVELS)), F.lit(1), F.col("size")).alias("stack"))
