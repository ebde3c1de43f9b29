"""Connected components of an edge table by alternating star contractions.

Each round moves every node's larger neighbours to its smallest one (large star), then the smaller ones (small star).
Edges never grow beyond those of the round before plus one per node; rounds grow with the logarithm of the diameter. No edge
reaches the driver: the end is seen from a count and a checksum that the write of a round computes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendline.llm.common import cut_with


def _checks(df: DataFrame) -> tuple[DataFrame, tuple]:
    done, seen = cut_with(
        df,
        n=F.count(F.lit(1)),
        s=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
    )
    return done, (seen["n"], seen["s"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v, distinct."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    if large:
        moved = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another.

    Null ends and loops are left out; repeated edges count once; no edges give no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    found = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter(
        x.isNotNull() & y.isNotNull() & (F.col("u") > F.col("v"))
    )
    current, state = _checks(found.distinct())
    for _ in range(most_rounds):
        if not state[0]:
            break
        before = state
        current, state = _checks(_star(_star(current, True), False))
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return (
        current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )
