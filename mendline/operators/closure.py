"""How many nodes each node reaches, counted exactly without the pairs.

A graph falls apart into its weak components, and most lineage graphs into many small ones. The edges of a component go to one task, which
finds its strongly connected parts, walks them in topological order and merges bitmaps of the nodes reached: a table of
pairs is never made, and a long chain takes one pass. A component whose bitmaps would be large is solved in several tasks, each for
the bits of its own block of nodes. Components above ``MOST_EDGES`` edges are beyond one task; their pairs are found by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendline.functions.graph import components
from mendline.functions.scale import cut, global_rank, grows, looked_up

#: Edges of a component that one task takes, and bits that it holds for all its nodes together (64 MB).
MOST_EDGES = 200_000
MOST_BITS = 1 << 29
_COUNTS = ("up", "up_within", "down", "direct_up", "direct_down")


def strong_parts(n: int, steps: list[list[int]]) -> list[list[int]]:
    """Strongly connected parts of the nodes 0..n-1, each after all that it leads to."""
    index, low, held, on, out = [-1] * n, [0] * n, [], bytearray(n), []
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        todo = [(root, 0)]
        while todo:
            v, at = todo.pop()
            if not at:
                index[v] = low[v] = count
                count += 1
                held.append(v)
                on[v] = 1
            for at in range(at, len(steps[v])):
                w = steps[v][at]
                if index[w] < 0:
                    todo += [(v, at + 1), (w, 0)]
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(held.pop())
                        on[part[-1]] = 0
                    out.append(part)
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
    return out


def _reached(steps: list[list[int]], bit: list[int]) -> list[int]:
    """For each node the number of nodes with a bit that it reaches by at least one step."""
    parts = strong_parts(len(steps), steps)
    of = [0] * len(steps)
    for p, nodes in enumerate(parts):
        for v in nodes:
            of[v] = p
    sets, counts = [], [0] * len(steps)
    for p, nodes in enumerate(parts):
        own = found = 0
        for v in nodes:
            own |= bit[v]
        for q in {of[w] for v in nodes for w in steps[v]}:
            found |= own if q == p else sets[q][0] | sets[q][1]
        sets.append((own, found))
        for v in nodes:
            counts[v] = found.bit_count()
    return counts


def _reached_within(steps: list[list[int]], bit: list[int], depth: int) -> list[int]:
    found = [0] * len(steps)
    for _ in range(depth):
        found = [_union(bit[w] | found[w] for w in ws) for ws in steps]
    return [x.bit_count() for x in found]


def _union(sets: Iterator[int]) -> int:
    out = 0
    for s in sets:
        out |= s
    return out


def _solve(child: np.ndarray, parent: np.ndarray, block: int, bits: int, depth: int) -> tuple[np.ndarray, list[list[int]]]:
    nodes, ends = np.unique(np.concatenate((child, parent)), return_inverse=True)
    n, m = len(nodes), len(child)
    ups, downs = [[] for _ in range(n)], [[] for _ in range(n)]
    for c, p in zip(ends[:m].tolist(), ends[m:].tolist()):
        ups[c].append(p)
        downs[p].append(c)
    first = block * bits
    bit = [1 << (v - first) if first <= v < first + bits else 0 for v in range(n)]
    up = _reached(ups, bit)
    within = up if depth < 0 else _reached_within(ups, bit, depth)
    direct = lambda steps: [len(x) if not block else 0 for x in steps]
    return nodes, [up, within, _reached(downs, bit), direct(ups), direct(downs)]


def _in_tasks(edges: DataFrame, depth: int, kind: str = "bigint") -> DataFrame:
    """(node, counts) for rows (part, block, bits, child, parent)."""
    names = ["node", *_COUNTS]

    def solve(child: np.ndarray, parent: np.ndarray, block: int, bits: int) -> pa.RecordBatch:
        nodes, counts = _solve(child, parent, block, bits, depth)
        return pa.RecordBatch.from_arrays([pa.array(nodes), *(pa.array(c, pa.int64()) for c in counts)], names=names)

    return by_piece(edges, solve, f"node {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))


def by_piece(edges: DataFrame, solve, schema: str) -> DataFrame:
    """``solve(child, parent, block, bits)`` for all rows (part, block, bits, child, parent) of a part and block together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def close():
            return solve(*(np.concatenate(x) for x in zip(*held)), *current[1:])

        for b in batches:
            if not b.num_rows:
                continue
            part, block, bits, child, parent = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            starts = np.concatenate(([0], np.nonzero(np.diff(part) | np.diff(block))[0] + 1, [b.num_rows]))
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                key = (int(part[s]), int(block[s]), int(bits[s]))
                if held and key != current:
                    yield close()
                    held = []
                current = key
                held.append((child[s:e], parent[s:e]))
        if held:
            yield close()

    ordered = edges.repartition("part", "block").sortWithinPartitions("part", "block")
    return ordered.select("part", "block", "bits", "child", "parent").mapInArrow(run, schema)


def _by_pairs(edges: DataFrame, depth: int, all_pairs) -> DataFrame:
    pairs = cut(all_pairs(edges))
    near, inside = F.col("depth") == 1, F.lit(True) if depth < 0 else F.col("depth") <= depth
    up = pairs.groupBy(F.col("root").alias("node")).agg(
        F.count(F.lit(1)).alias("up"), F.count_if(inside).alias("up_within"), F.count_if(near).alias("direct_up")
    )
    down = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("down"), F.count_if(near).alias("direct_down"))
    zero = F.lit(0).cast("long")
    return up.select("node", "up", "up_within", zero.alias("down"), "direct_up", zero.alias("direct_down")).unionByName(
        down.select("node", zero.alias("up"), zero.alias("up_within"), "down", zero.alias("direct_up"), "direct_down")
    )


def pieces(edges: DataFrame, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """``(part, m, child, parent)``: the distinct edges by numbers, with the weak component they lie in and its number of edges; and
    ``(name, id)`` of the nodes. Null ends are no nodes. Components above ``most_edges`` edges may hold most of them, so their edges stay where they are."""
    known = edges.select("child", "parent").filter("child is not null and parent is not null").distinct()
    names = known.select(F.explode(F.array("child", "parent")).alias("name")).distinct()
    ids = cut(global_rank(names, [F.col("name")], "id"))
    by_id = lambda end: looked_up(ids.select(F.col("name").alias(end), F.col("id").alias(f"{end}_id")))
    steps = known.join(by_id("child"), "child").join(by_id("parent"), "parent")
    steps = cut(steps.select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent")))
    part = components(steps, "child", "parent")
    placed = steps.join(looked_up(part.withColumnRenamed("node", "child")), "child", "left").select(
        F.coalesce("component", "child").alias("part"), "child", "parent"
    )
    placed = cut(placed)
    sizes = cut(placed.groupBy("part").agg(F.count(F.lit(1)).alias("m")))
    large = F.broadcast(sizes.filter(F.col("m") > most_edges))  # a row for every ``most_edges`` edges at most
    small = placed.join(large, "part", "left_anti").join(grows(sizes.filter(F.col("m") <= most_edges)), "part")
    return cut(small.unionByName(placed.join(large, "part"))), ids


def counts(edges: DataFrame, all_pairs, depth: int = -1, most_edges: int = MOST_EDGES, most_bits: int = MOST_BITS) -> DataFrame:
    """``(node, up, up_within, down, direct_up, direct_down)`` for every node of ``edges(child, parent)``.

    up: nodes reached from child to parent, up_within: by at most ``depth`` steps (-1: any), down: nodes that reach it, direct: distinct
    neighbours. A node on a cycle reaches itself. Null ends are no nodes; repeated edges count once. ``all_pairs`` finds the
    ``(root, node, depth)`` of components that are too large for a task.
    """
    sized, ids = pieces(edges, most_edges)
    nodes = F.col("m") + 1  # no more, as the part hangs together
    bits = F.greatest(F.lit(64), F.floor(F.lit(most_bits) / nodes)).cast("long")
    small = sized.filter(F.col("m") <= most_edges).withColumn("bits", bits)
    blocks = small.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((nodes - 1) / F.col("bits")))))
    found = _in_tasks(blocks, depth)
    large = sized.filter(F.col("m") > most_edges)
    if not large.isEmpty():
        found = found.unionByName(_by_pairs(large.select("child", "parent"), depth, all_pairs))
    total = found.groupBy(F.col("node").alias("id")).agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return total.join(grows(ids), "id").select(F.col("name").alias("node"), *_COUNTS)


def counts_in_parts(edges: DataFrame, all_pairs, depth: int = -1, most_edges: int = MOST_EDGES) -> DataFrame:
    """``counts`` of ``edges(part, child, parent)`` of many graphs that share no nodes, a number ``part`` for each; edges are distinct.

    A part is solved in one task as it is; larger ones than ``most_edges`` go through ``counts``.
    """
    sizes = edges.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    large = cut(sizes.filter(F.col("m") > most_edges))
    none = F.lit(0).cast("long")
    whole = edges.select("part", none.alias("block"), F.lit(2 * most_edges).cast("long").alias("bits"), "child", "parent")
    if large.isEmpty():
        return _in_tasks(whole, depth, edges.schema["child"].dataType.simpleString())
    found = _in_tasks(whole.join(large, "part", "left_anti"), depth, edges.schema["child"].dataType.simpleString())
    return found.unionByName(counts(edges.join(large, "part", "left_semi").select("child", "parent"), all_pairs, depth, most_edges))
