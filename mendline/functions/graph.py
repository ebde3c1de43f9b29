"""Connected components of an edge table by alternating star contractions.

Each round moves every node's larger neighbours to its smallest one (large star), then the smaller ones (small star).
Edges never grow beyond those of the round before plus one per node; rounds grow with the logarithm of the diameter. No edge
reaches the driver: the end is seen from a count and a checksum that the write of a round computes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mendline.functions.scale import cut, looked_up, parts


def _checked(df: DataFrame) -> tuple[DataFrame, tuple]:
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
    return done.coalesce(parts(seen.get["n"])), (seen.get["n"], seen.get["s"])


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """edges (u, v) with u > v, distinct; ``n`` of them, about. Small graphs go on in few tasks, as each task of a shuffle writes files."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if large:  # a smaller end without neighbours below it stays
        below = least.withColumnRenamed("u", "v")
        moved = edges.join(looked_up(below), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
    else:
        met = edges.join(looked_up(least), "u")
        moved = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter("u > v").coalesce(parts(n)).distinct().coalesce(parts(n))


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """``(node, component)``: the smallest node reachable over edges of either direction, for every node with an edge to another one.

    Nodes are of any type that has an order. Null ends and loops are left out; repeated edges count once; no edges give no rows.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current, state = _checked(ends.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct())
    for _ in range(most_rounds):
        if not state[0]:
            break
        before = state
        current, state = _checked(_star(_star(current, True, state[0]), False, state[0]))
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    least = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)
