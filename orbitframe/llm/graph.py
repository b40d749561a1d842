"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, loose


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()


def _least(sides: DataFrame) -> DataFrame:
    """u, v with m, the least of u and all its neighbours; a join that AQE can split, not a window, so that hubs don't gather in a task."""
    return sides.join(loose(sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u"), "u")


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node of it, for each node of edges(a, b); numbers without nulls.

    Rounds grow with the logarithm of the longest path.  Each round's edges, at most as many as before,
    are cut off by a reliable checkpoint, and the round before's is removed.
    """
    now = durable(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        met = _least(down)
        small = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(met.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, now = now, durable(small.where("a != b").distinct())
        forget(before)
        new = _state(now)
        if new == state:
            break
        state = new
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
