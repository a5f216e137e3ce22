"""Parent-child rows to full hierarchies by pointer doubling (problem 5).

Every node holds a pointer to an ancestor and the number of links to it. A
round joins the pointers with themselves, so the distance a pointer spans
doubles; a node is resolved once its pointer is a root. A chain of depth d
needs about log2(d) rounds, whatever the number of nodes.

A round that resolves no node proves that the rest never ends: were there a
node of greater depth, one of its ancestors would have had just the depth
that this round resolves.

What is resolved is written once and set aside; a round reads it but rewrites
pending nodes only. Where the pending nodes are counted to be few, they are
broadcast to the others, so late rounds shuffle nothing.

Defined results for odd input: rows with a null or blank id are no nodes; rows
delivered again count once; where an id occurs with several parents the
smallest parent counts; an empty table gives an empty result; columns other
than the id and the parent are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.session import cut_lineage

OUTER_BLANKS = r"(?U)^\s+|\s+$"


def link_key(c: Column) -> Column:
    """Ids compare in lower case without outer blanks; a blank one is null."""
    key = F.lower(F.regexp_replace(c, OUTER_BLANKS, ""))
    return F.when(key != "", key)


def tree_nodes(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """``(node, label, parent)``, one row a node; a parent that names no node is null."""
    nodes = (
        rows.select(link_key(F.col(id_col)).alias("node"), F.col(id_col).alias("label"), link_key(F.col(parent_col)).alias("parent"))
        .where("node is not null")
        .groupBy("node")
        .agg(F.min("label").alias("label"), F.min("parent").alias("parent"))
    )
    nodes = cut_lineage(nodes)
    # a parent of many children is one row here, so the join's right side has unique keys; nodes without a parent are spread
    known = nodes.select(F.col("node").alias("key"), F.lit(True).alias("exists"))
    keyed = nodes.withColumn("key", F.coalesce("parent", F.concat(F.lit("\x00"), "node")))
    return keyed.join(known, "key", "left").select("node", "label", F.when(F.col("exists"), F.col("parent")).alias("parent"))


#: Pending rows (times the length of their paths) that are broadcast at most.
BROADCAST_ROWS = 200_000


def resolve_links(rows: DataFrame, id_col: str, parent_col: str, with_path: bool = False, whole_cycles: bool = False) -> DataFrame:
    """Root and depth of every node: ``(node, label, root, depth, at, lowest[, path])``.

    ``root`` is null and ``depth`` -1 where the chain never ends. ``path`` (with
    ``with_path``) holds the labels from the root down to the node. With
    ``whole_cycles`` doubling goes on until every endless pointer has gone
    around its cycle; then ``at`` is a node on the cycle and ``lowest`` the
    smallest node that the pointer has passed.
    """
    nodes = tree_nodes(rows, id_col, parent_col)
    is_root = F.col("parent").isNull()
    state = nodes.select(
        "node",
        "label",
        F.coalesce("parent", "node").alias("at"),
        F.when(is_root, 0).otherwise(1).cast("long").alias("depth"),
        is_root.alias("done"),
        F.when(is_root, F.col("label")).alias("root"),
        F.coalesce("parent", "node").alias("lowest"),
        *([F.array("label").alias("path")] if with_path else []),
    )
    cores = rows.sparkSession.sparkContext.defaultParallelism
    written = cut_lineage(state)
    settled, active = [written.where("done")], written.where("not done")
    pending, span, stuck = active.count(), 1, False
    while pending and not (stuck and (not whole_cycles or span >= pending)):
        everything = active
        for part in settled:
            everything = everything.unionByName(part)
        ahead = everything.select(
            F.col("node").alias("at"),
            F.col("at").alias("next_at"),
            F.col("depth").alias("more"),
            F.col("done").alias("ends"),
            F.col("root").alias("found"),
            F.col("lowest").alias("low"),
            *([F.col("path").alias("head")] if with_path else []),
        )
        few = pending * (span if with_path else 1) <= BROADCAST_ROWS
        moved = (F.broadcast(active.drop("root", "done")) if few else active.drop("root", "done")).join(ahead, "at").select(
            "node",
            "label",
            F.col("next_at").alias("at"),
            (F.col("depth") + F.col("more")).alias("depth"),
            F.col("ends").alias("done"),
            F.col("found").alias("root"),
            F.least("lowest", "low").alias("lowest"),
            *([F.concat("head", "path").alias("path")] if with_path else []),
        )
        # a pending node has exactly one node ahead, so the number of rows is known
        written = cut_lineage(moved.coalesce(max(cores, pending // BROADCAST_ROWS)))
        settled.append(written.where("done"))
        active = written.where("not done")
        left = active.count()
        stuck, pending, span = left == pending, left, span * 2
    columns = ["node", "label", "root", "depth", "at", "lowest", *(["path"] if with_path else [])]
    out = active.withColumn("root", F.lit(None).cast("string")).withColumn("depth", F.lit(-1).cast("long"))
    if with_path:
        out = out.withColumn("path", F.lit(None).cast("array<string>"))
    out = out.select(columns)
    for part in settled:
        out = out.unionByName(part.select(columns))
    return out


def roots_and_depths(rows: DataFrame, id_col: str = "section_id", parent_col: str = "parent_section_id") -> DataFrame:
    """``(section_id, root_section_id, depth)``; '' and -1 where the chain never ends."""
    found = resolve_links(rows, id_col, parent_col)
    return found.select(F.col("label").alias("section_id"), F.coalesce("root", F.lit("")).alias("root_section_id"), F.col("depth").cast("int").alias("depth"))


def full_paths(rows: DataFrame, id_col: str = "section_id", parent_col: str = "parent_section_id") -> DataFrame:
    """Each node with the ids from its root down to itself; the path of an endless chain is null."""
    found = resolve_links(rows, id_col, parent_col, with_path=True)
    return found.select(
        F.col("label").alias("section_id"),
        F.coalesce("root", F.lit("")).alias("root_section_id"),
        F.col("depth").cast("int").alias("depth"),
        "path",
    )


def descendants(rows: DataFrame, id_col: str = "section_id", parent_col: str = "parent_section_id") -> DataFrame:
    """Every pair of a node and one of its descendants, with the number of links between them."""
    found = resolve_links(rows, id_col, parent_col, with_path=True).where("depth > 0")
    pairs = found.select(F.col("label").alias("descendant_id"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("at", "section_id"))
    return pairs.select("section_id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def circular_links(rows: DataFrame, id_col: str = "section_id", parent_col: str = "parent_section_id") -> DataFrame:
    """Nodes whose chain never ends: ``(section_id, cycle_id, on_cycle)``.

    ``cycle_id`` is the smallest id (as compared) on the cycle that the chain
    runs into; ``on_cycle`` tells the cycle's own nodes from those that lead
    to it. Both follow from pointers that have gone around at least once.
    """
    endless = cut_lineage(resolve_links(rows, id_col, parent_col, whole_cycles=True).where("depth = -1"))
    on_cycle = endless.select(F.col("at").alias("node")).distinct()
    own = endless.join(on_cycle, "node", "left_semi").select(F.col("node").alias("at"), F.col("lowest").alias("cycle_id"))
    return endless.select("label", "node", "at").join(own, "at").select(
        F.col("label").alias("section_id"), "cycle_id", "node"
    ).join(on_cycle.withColumn("on_cycle", F.lit(True)), "node", "left").select("section_id", "cycle_id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
