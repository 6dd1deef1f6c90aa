"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscope.llm.common import merged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least node among them and it: larger neighbours, or smaller ones and the node."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = edges.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(u, v) edges -> (id, component), the smallest id reachable, for every node with an edge.

    Each round halves the distance to the root, so rounds grow with the logarithm of a component's width. Only aggregates and
    equi-joins; each round is written to the shared folder. An empty edge table gives no rows; loops and nulls are dropped.
    """
    edges = merged(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        edges = merged(_star(_star(edges, True), False), "stars")
        # a fixed point has one edge per node that is not a root, straight to its root
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
