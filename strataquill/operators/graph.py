"""Property graphs as two frames: ``nodes(node_id, label, name)`` and ``edges(src, dst, rel)``.

Path searches start from stated sources and go at most ``depth`` links (3 by
default); an edge is used once in a path. Degrees are counted once, before the
paths. A node that a third of all edges touch makes many paths only if one of
the sources reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquill.session import cut_lineage


def both_ways(edges: DataFrame) -> DataFrame:
    """JOI19: every edge from either end: ``(a, b, rel, edge)``."""
    known = edges.withColumn("edge", F.concat_ws("|", "src", "rel", "dst"))
    return known.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel", "edge").unionByName(known.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel", "edge"))


def degrees(edges: DataFrame) -> DataFrame:
    """AGG13: links of every node."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))


def paths(edges: DataFrame, sources: DataFrame, depth: int = 3) -> DataFrame:
    """GRA08: undirected paths of 1 to ``depth`` links from ``sources(node_id)``: ``(source, target, nodes, rels, edges)``."""
    ways = both_ways(edges)
    step = ways.join(sources.select(F.col("node_id").alias("a")).distinct(), "a").select(
        F.col("a").alias("source"), F.col("b").alias("target"), F.array("a", "b").alias("nodes"), F.array("rel").alias("rels"), F.array("edge").alias("edges")
    )
    out = step
    for _ in range(depth - 1):
        step = step.join(ways.withColumnRenamed("a", "target"), "target").where(~F.array_contains("edges", F.col("edge"))).select(
            "source", F.col("b").alias("target"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels"), F.concat("edges", F.array("edge")).alias("edges")
        )
        out = out.unionByName(step)
    return out.where("target <> source")


def scored_paths(found: DataFrame, degree: DataFrame, wanted: Sequence[str], k: int = 20) -> DataFrame:
    """GRA08: 1/length + mean degree/10 + 0.3 for a wanted relation; the k best paths."""
    each = found.withColumn("path", F.array_join("nodes", ">")).select("*", F.explode("nodes").alias("node_id")).join(degree, "node_id", "left")
    score = 1 / F.first(F.size("rels")) + F.sum(F.coalesce("degree", F.lit(0))) / (10 * F.first(F.size("nodes"))) + F.when(F.first(F.arrays_overlap("rels", F.array(*map(F.lit, wanted)))), 0.3).otherwise(0.0)
    total = each.groupBy("source", "target", "path", F.array_join("rels", ">").alias("relations")).agg(F.round(score, 6).alias("score"))
    return total.orderBy(F.desc("score"), "path", "relations").limit(k)


def subgraphs(edges: DataFrame, sources: DataFrame, depth: int, max_nodes: int) -> DataFrame:
    """GRA09, AGG12: distinct nodes within ``depth`` links of each source, and the density among them; larger sets vanish.

    The frontier holds each (source, node) once, so what is joined is bounded by
    the reached pairs, not by the paths.
    """
    ways = both_ways(edges).select("a", "b").distinct()
    seen = sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("node")).distinct()
    frontier = seen
    for _ in range(depth):
        frontier = frontier.join(ways, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct().join(seen, ["source", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    sizes = seen.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") <= max_nodes)
    inside = seen.join(sizes, "source")
    pairs = edges.select("src", "dst").distinct()
    links = inside.select("source", F.col("node").alias("src")).join(pairs, "src").join(inside.select("source", F.col("node").alias("dst")), ["source", "dst"]).groupBy("source").agg(F.count("*").alias("links"))
    r = F.coalesce("links", F.lit(0))
    density = F.when(F.col("n") > 1, F.round(r / (F.col("n") * (F.col("n") - 1) / 2), 6)).otherwise(F.lit(0.0))
    return sizes.join(links, "source", "left").select("source", F.col("n").alias("nodes"), r.alias("links"), density.alias("density"))


def contracted(links: DataFrame, group: Sequence[str]) -> DataFrame:
    """Links ``(group, x, y)`` with the same components: each batch's links become stars around the smallest node they join.

    Batches follow the order of the links and hold a bounded number of them, so
    what lies near each other is joined without a shuffle a step.
    """
    names = [*group, "x", "y"]
    n = len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            up: dict[tuple, tuple] = {}

            def top(v: tuple, up: dict = up) -> tuple:
                root = v
                while (above := up.get(root, root)) != root:
                    root = above
                while v != root:
                    up[v], v = root, up[v]
                return root

            for *g, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r, q = top((*g, x)), top((*g, y))
                if r != q:
                    up[max(r, q)] = min(r, q)
            rows = [(*v, top(v)[n]) for v in list(up) if top(v) != v]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(b.schema.types)], names=names)

    kinds = dict(links.dtypes)
    near = links.where(" and ".join(f"{g} is not null" for g in group) or "true").repartitionByRange(*(F.col(c) for c in names[:-1])).sortWithinPartitions(*names[:-1])
    return near.select(names).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def components(pairs: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """GRA15: connected components by the smallest label: ``(group, node, component)``.

    Alternating stars: a node hands its larger neighbours to its smallest one,
    then its smaller ones too. Each step keeps the components and brings every
    node nearer to the smallest; it ends with one star a component, after about
    log squared rounds. Links shrink to one a node, the smallest neighbour is
    aggregated before it is joined, and a hub is one row of the join's right side.
    Links that lie near each other are contracted first. Rows with a null group
    or node have no component.
    """
    # read several times below, and once more for the bounds of its ranges
    both = cut_lineage(pairs.select(*group, F.col(a).alias("x"), F.col(b).alias("y")).where(" and ".join(f"{c} is not null" for c in (*group, "x", "y"))))
    nodes = cut_lineage(both.select(*group, "x").unionByName(both.select(*group, F.col("y").alias("x"))).distinct())
    # every link once, from the larger end
    links = both.where("x <> y").select(*group, F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    links = cut_lineage(contracted(links, group).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*group, "x", "y").cast("decimal(38,0)"))).first())

    before, now = None, mark(links)
    while now != before:
        ways = links.unionByName(links.select(*group, F.col("y").alias("x"), F.col("x").alias("y")))
        least = ways.groupBy(*group, "x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = ways.where("y > x").join(least, [*group, "x"]).select(*group, F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        down = large.groupBy(*group, "x").agg(F.min("y").alias("m"))
        small = large.join(down, [*group, "x"]).select(*group, F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct("x", F.col("m").alias("y")))).alias("e")).select(*group, "e.x", "e.y")
        links = cut_lineage(small.where("x <> y").distinct())
        before, now = now, mark(links)
    return nodes.join(links, [*group, "x"], "left").select(*group, F.col("x").alias("node"), F.coalesce("y", "x").alias("component"))


def search(edges: DataFrame, names: DataFrame, kinds: DataFrame) -> DataFrame:
    """GRA11: graph queries by type: entity, neighbours, path, subgraph, other; ``kinds(query_id, kind, node_id)``."""
    near = both_ways(edges).select(F.col("a").alias("node_id"), "b").distinct()
    entity = kinds.where("kind = 'entity'").join(names, "node_id").select("query_id", "kind", F.col("name").alias("result"))
    around = kinds.where("kind = 'neighbours'").join(near, "node_id").select("query_id", "kind", F.col("b").alias("result"))
    two = kinds.where("kind = 'path'").join(near, "node_id").select("query_id", "kind", F.col("b").alias("node_id"), F.col("node_id").alias("start")).join(near, "node_id").where("b <> start").select("query_id", "kind", F.concat_ws(">", "start", "node_id", "b").alias("result"))
    return entity.unionByName(around).unionByName(two)


def shortest(edges: DataFrame, sources: DataFrame, depth: int = 6) -> DataFrame:
    """Breadth-first distances from stated sources, an extension."""
    ways = both_ways(edges).select("a", "b").distinct()
    seen = sources.select(F.col("node_id").alias("source"), F.col("node_id").alias("node"), F.lit(0).alias("distance")).distinct()
    frontier = seen
    for k in range(1, depth + 1):
        frontier = frontier.join(ways, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct().join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("distance", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen


def flood_regions(cells: DataFrame, group: str, gap: int = 0) -> DataFrame:
    """SRC22: regions of touching cells of a sheet: ``(group, top, left, bottom, right, cells)``.

    Cells ``(group, row, col)`` within ``gap + 1`` of each other, in four
    directions, belong together; a merged cell (columns ``height``, ``width``)
    stands for every place it covers. Runs of a row are found first and only
    runs are linked, so the graph has a node a run.
    """
    own = cells
    if {"height", "width"} <= set(cells.columns):
        over = lambda c, n: F.explode(F.sequence(F.col(c), F.col(c) + F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) - 1))
        own = cells.withColumn("row", over("row", F.col("height"))).withColumn("col", over("col", F.col("width")))
    along = Window.partitionBy(group, "row").orderBy("col")
    fresh = F.coalesce((F.col("col") - F.lag("col").over(along) > gap + 1).cast("int"), F.lit(1))
    numbered = own.select(group, "row", "col").distinct().withColumn("fresh", fresh)
    run = F.max(F.when(F.col("fresh") == 1, F.col("col"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    runs = cut_lineage(numbered.withColumn("id", F.concat_ws(":", F.lpad("row", 9, "0"), F.lpad(run, 9, "0"))).drop("fresh"))
    links = runs.select(group, F.col("id").alias("a"), F.col("id").alias("b")).distinct()
    for k in range(1, gap + 2):
        below = runs.select(group, (F.col("row") - k).alias("row"), "col", F.col("id").alias("b"))
        links = links.unionByName(runs.join(below, [group, "row", "col"]).select(group, F.col("id").alias("a"), "b").distinct())
    labels = components(links, [group], "a", "b")
    sizes = runs.groupBy(group, "id").agg(F.min("row").alias("row"), F.min("col").alias("left"), F.max("col").alias("right"), F.count("*").alias("cells"))
    return sizes.join(labels.withColumnRenamed("node", "id"), [group, "id"]).groupBy(group, "component").agg(F.min("row").alias("top"), F.min("left").alias("left"), F.max("row").alias("bottom"), F.max("right").alias("right"), F.sum("cells").alias("cells")).drop("component")
