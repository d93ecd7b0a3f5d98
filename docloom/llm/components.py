"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

No neighbourhood is gathered: each step is an aggregate and a join, and every step's edges are written to the shared
folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours larger than a node move to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none itself; edges are (larger, smaller)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def connected_components(edges: DataFrame, tmp: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that an edge names, a table of ``tmp``; the component is the smallest node reachable.

    ``edges``: two integer columns. Loops and repeated edges are allowed; without edges the result is empty.
    """
    now = tmp.store(edges.toDF("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        before = now
        now = tmp.store(_small_star(_large_star(now)))
        tmp.drop(before)
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = tmp.store(leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    tmp.drop(now)
    return out
