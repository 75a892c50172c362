"""Connected components of a large edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvote.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Large star: every neighbour above a node is tied to the node's smallest neighbour. Small
    star: every neighbour below a node, and the node, are tied to the smallest. Repeated until
    every tree is a star, which is looked for before each round, so that none runs on edges that
    are final. Both are a minimum that combines before its shuffle and a join that adaptive
    execution splits where a node is hot. Each round's edges are a written table; the driver sees
    the number of nodes that are in no star only.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = materialize(
        edges.select(high.alias("u"), low.alias("v")).filter("u <> v").distinct(), "component-edges"
    )
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now = materialize(small, "component-edges")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either the ``v`` of its edges or the ``u`` of a single one."""
    ends = F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )).alias("e")
    nodes = edges.select(ends).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return not nodes.filter("up > 1 OR (up > 0 AND down > 0)").count()
