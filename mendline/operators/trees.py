"""Lineage trees as shared structures: every subtree is kept once, and only the rows that are asked for are unfolded.

The tree of a root repeats a node for every path that leads to it, so it can be exponentially larger than the graph. But the subtree of a node
is the same wherever it stands. ``layout`` keeps for each step the size of the subtree it leads to and its distance from the node's own
row in pre-order: a table as large as the edges. ``page`` then unfolds a range of rows: a subtree that lies outside of the range is not entered.
``lineage.tree`` unfolds everything, which is for those who want that.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendline.functions.scale import cut, cut_counted, grows, looked_up
from mendline.operators.closure import MOST_EDGES, by_piece, pieces, strong_parts

#: Rows of a tree that can be numbered; larger subtrees count as so many.
MOST_ROWS = 10**37
_SIZE = "decimal(38,0)"


def _sizes_in_task(child: np.ndarray, parent: np.ndarray, block: int, bits: int) -> pa.RecordBatch:
    """Rows of the subtree of every node that leads to no cycle."""
    nodes, ends = np.unique(np.concatenate((child, parent)), return_inverse=True)
    n, m = len(nodes), len(child)
    steps: list[list[int]] = [[] for _ in range(n)]
    for c, p in zip(ends[:m].tolist(), ends[m:].tolist()):
        steps[c].append(p)
    sizes: list[int | None] = [None] * n
    for part in strong_parts(n, steps):  # what a part leads to comes before it
        v = part[0]
        below = [sizes[w] for w in steps[v]]
        if len(part) == 1 and v not in steps[v] and None not in below:
            sizes[v] = min(MOST_ROWS, 1 + sum(below))
    values = pa.array([None if s is None else Decimal(s) for s in sizes], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(nodes), values], names=["node", "size"])


def _sizes_by_level(steps: DataFrame) -> DataFrame:
    """The same in rounds, one for each level; nodes that lead to a cycle get no row."""
    ends = steps.select(F.col("parent").alias("node")).distinct().join(steps.select(F.col("child").alias("node")), "node", "left_anti")
    known, new = cut_counted(ends.select("node", F.lit(1).cast(_SIZE).alias("size")))
    degree = cut(steps.groupBy("child").agg(F.count(F.lit(1)).alias("degree")))
    while new:
        met = steps.join(looked_up(known.withColumnRenamed("node", "parent")), "parent").groupBy("child").agg(
            F.count(F.lit(1)).alias("found"), F.least(F.lit(Decimal(MOST_ROWS)), 1 + F.sum("size")).cast(_SIZE).alias("size")
        )
        ready = met.join(grows(degree), "child").filter(F.col("found") == F.col("degree"))
        fresh, new = cut_counted(ready.select(F.col("child").alias("node"), "size").join(grows(known), "node", "left_anti"))
        known = cut(known.unionByName(fresh)) if new else known
    return known


def layout(edges: DataFrame, upstream: bool = True, most_edges: int = MOST_EDGES) -> DataFrame:
    """``(node, next, size, next_size, offset)``: for each step the rows of the node's subtree, those of the subtree of ``next``, and how many rows
    after the node's own the latter begins. Siblings go by name.

    Nodes that lead to a cycle have no subtree of their own, as what is shown depends on the path: their sizes and offsets are null.
    """
    here, there = ("child", "parent") if upstream else ("parent", "child")
    sized, ids = pieces(edges.select(F.col(here).alias("child"), F.col(there).alias("parent")), most_edges)
    zero = F.lit(0).cast("long")
    small = sized.filter(F.col("m") <= most_edges).select("part", zero.alias("block"), zero.alias("bits"), "child", "parent")
    sizes = by_piece(small, _sizes_in_task, f"node long, size {_SIZE}")
    large = sized.filter(F.col("m") > most_edges)
    if not large.isEmpty():
        sizes = sizes.unionByName(_sizes_by_level(cut(large.select("child", "parent"))))
    sizes = cut(sizes)
    own = sizes.select(F.col("node").alias("child"), "size")
    below = sizes.select(F.col("node").alias("parent"), F.col("size").alias("next_size"))
    steps = sized.join(looked_up(own), "child", "left").join(looked_up(below), "parent", "left")
    # Numbers were given in the order of the names. The running sum is over the steps out of one node.
    before = Window.partitionBy("child").orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.when(F.col("size").isNotNull(), 1 + F.coalesce(F.try_sum("next_size").over(before), F.lit(Decimal(0)))).cast(_SIZE)
    placed = steps.withColumn("offset", offset)
    name = lambda end, alias: looked_up(ids.select(F.col("id").alias(end), F.col("name").alias(alias)))
    return placed.join(name("child", "node"), "child").join(name("parent", "next"), "parent").select(
        "node", "next", "size", "next_size", "offset"
    )


def sizes(placed: DataFrame) -> DataFrame:
    """``(node, size)``: rows of the tree of every node of a layout; null where it leads to a cycle."""
    own, below = placed.select("node", "size"), placed.select(F.col("next").alias("node"), F.col("next_size").alias("size"))
    return own.unionByName(below).distinct()


def page(placed: DataFrame, roots: DataFrame, first: int = 1, rows: int = 100) -> DataFrame:
    """``(root, rank, node, depth, path)``: the rows numbered ``first`` to ``first + rows - 1`` of the tree of each of ``roots(root)``.

    Rows are numbered from 1 in pre-order, siblings by name. ``placed`` comes from ``layout``. A root that is no node has no rows, nor has one that
    leads to a cycle: ``lineage.tree`` unfolds it. What is held at a time is the part of a level that leads to the rows asked for.
    """
    low, high = Decimal(first), Decimal(first + rows)
    steps = cut(placed.filter("offset is not null").select("node", "next", "next_size", "offset"))
    start = roots.select("root").distinct().join(grows(sizes(placed).withColumnRenamed("node", "root")), "root").filter("size is not null")
    meets = (F.col("rank") < F.lit(high)) & (F.col("rank") + F.col("size") > F.lit(low))
    frontier, n = cut_counted(
        start.select("root", F.lit(Decimal(1)).cast(_SIZE).alias("rank"), F.col("root").alias("node"), "size", F.lit(0).alias("depth"), F.array("root").alias("path")).filter(meets)
    )
    shown, depth = frontier, 0
    while n:
        depth += 1
        below = frontier.drop("size").join(grows(steps), "node").select(
            "root",
            (F.col("rank") + F.col("offset")).cast(_SIZE).alias("rank"),
            F.col("next").alias("node"),
            F.col("next_size").alias("size"),
            F.lit(depth).alias("depth"),
            F.concat("path", F.array("next")).alias("path"),
        )
        frontier, n = cut_counted(below.filter(meets))
        shown = shown.unionByName(frontier)
    return shown.filter((F.col("rank") >= F.lit(low)) & (F.col("rank") < F.lit(high))).select("root", "rank", "node", "depth", "path")
