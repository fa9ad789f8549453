"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over rows (u, v), u > v.

    large: each vertex links its larger neighbours to the least of itself and all neighbours.
    small: each vertex links its smaller neighbours and itself to the least of them.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = (
            edges.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
        )
    return out.where("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node that it reaches.

    Nodes without an edge are not listed. Null ends and loops are left out; repeated edges count once. Every round's edges
    go to the checkpoint folder; only one row, a count and a checksum, comes to the driver.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.expr("xxhash64(u, v) % 1000000007"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = cut(_star(_star(now, True), False))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
