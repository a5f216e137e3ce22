"""Problem 5: section trees of unknown depth."""

from __future__ import annotations

from strataquill.operators import tree_links
from strataquill.operators.evaluation import BLANKS
from strataquill.plans.registry import Registry
from strataquill.session import table

R = Registry()


def key_sql(column: str) -> str:
    return f"nullif(regexp_replace(lower({column}), '^{BLANKS}|{BLANKS}$', '', 'g'), '')"


#: Every pair of a node and an ancestor once, so that cycles end; a node on a cycle is its own ancestor.
TREES = f"""
WITH RECURSIVE nodes AS (
  SELECT node, min(label) AS label, min(parent) AS parent FROM (
    SELECT {key_sql('section_id')} AS node, section_id AS label, {key_sql('parent_section_id')} AS parent FROM section_nodes)
  WHERE node IS NOT NULL GROUP BY 1),
links AS (SELECT n.node, p.node AS parent FROM nodes n JOIN nodes p ON n.parent = p.node),
pairs AS (SELECT node, parent AS up FROM links UNION SELECT p.node, l.parent FROM pairs p JOIN links l ON l.node = p.up),
circle AS (SELECT node FROM pairs WHERE node = up),
endless AS (SELECT node, min(up) AS cycle_id FROM pairs WHERE up IN (SELECT node FROM circle) GROUP BY 1),
depths AS (SELECT n.node, n.label, count(p.up) AS depth FROM nodes n LEFT JOIN pairs p USING (node) WHERE n.node NOT IN (SELECT node FROM endless) GROUP BY 1, 2),
paths AS (
  SELECT node, list(label ORDER BY depth) AS path FROM (
    SELECT d.node, d.label, d.depth FROM depths d UNION ALL SELECT p.node, a.label, a.depth FROM pairs p JOIN depths a ON a.node = p.up WHERE p.node IN (SELECT node FROM depths))
  GROUP BY 1),
found AS (
  SELECT d.label AS section_id, p.path[1] AS root_section_id, d.depth::INT AS depth, p.path FROM depths d JOIN paths p USING (node)
  UNION ALL SELECT n.label, '', -1, NULL FROM nodes n JOIN endless USING (node))
"""


@R.query("p5_found", TREES + "SELECT section_id, root_section_id, depth FROM found")
def p5_found(spark, sf_dir):
    return tree_links.roots_and_depths(table(spark, sf_dir, "section_nodes"))


@R.query("p5_paths", TREES + "SELECT * FROM found")
def p5_paths(spark, sf_dir):
    return tree_links.full_paths(table(spark, sf_dir, "section_nodes"))


@R.query("p5_descendants", TREES + "SELECT a.label AS section_id, d.label AS descendant_id, (d.depth - a.depth)::INT AS distance FROM pairs p JOIN depths d USING (node) JOIN depths a ON a.node = p.up")
def p5_descendants(spark, sf_dir):
    return tree_links.descendants(table(spark, sf_dir, "section_nodes"))


@R.query("p5_cycles", TREES + "SELECT n.label AS section_id, cycle_id, node IN (SELECT node FROM circle) AS on_cycle FROM endless JOIN nodes n USING (node)")
def p5_cycles(spark, sf_dir):
    return tree_links.circular_links(table(spark, sf_dir, "section_nodes"))
