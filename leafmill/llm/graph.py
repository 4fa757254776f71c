"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component: the smallest node reachable.

    Alternates large-star and small-star steps: each node's larger (smaller)
    neighbours are hung on its smallest neighbour, which needs O(log^2 n) rounds and
    keeps the edge count from growing. A round is one min-aggregation with map-side
    combine and one equi-join that AQE can split on a hub, written to the
    shared folder.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while _unsettled(now):
        large = _star(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v > u")
        small = scratch.save(_star(large, "v < u", own=True), "stars")
        scratch.drop(now)
        now = small
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _star(pairs: DataFrame, keep: str, own: bool = False) -> DataFrame:
    """One star step over directed pairs (u, v): pairs kept by ``keep`` hang v on the minimum of u."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = pairs.where(keep).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if own:
        hung = hung.union(low.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def _unsettled(stars: DataFrame) -> bool:
    """Whether some node hangs on two nodes, or on one that itself hangs on another."""
    twice = stars.groupBy("u").count().where("count > 1").select("u")
    chained = stars.select(F.col("v").alias("u")).distinct().join(stars.select("u").distinct(), "u")
    return not twice.union(chained).isEmpty()
