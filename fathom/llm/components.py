"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (u, v); the component is its smallest node. Isolated nodes do not occur.

    Each round is two aggregations with partial minima; the edges are written once a round, so the plan stays
    flat, and those of the round before are removed. The number of rounds grows with the logarithm of the longest
    path. An empty edge list gives no row.
    """
    e = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    old = _sum(e)
    while True:
        # large star: every larger neighbour of a node is hung on the smallest node around it
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node and the node itself are hung on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = materialize(new, "cc")
        release(e)
        e, before = new, old
        old = _sum(e)
        if old == before:
            roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _sum(e: DataFrame) -> tuple:
    """A fingerprint of the edges, whatever their order."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
