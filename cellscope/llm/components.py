"""Connected components of a graph given as edges, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def star_step(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges (a, b). The large star hangs a node's larger
    neighbours, the small star its smaller neighbours and the node itself, on
    the least of all of them; both keep the components."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if larger else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = near.where("b > a") if larger else near
    hung = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        hung = hung.unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b: longs) with the least
    node of its component. Each round is stored, so a lost executor costs at
    most one round; the number of rounds grows with the logarithm of the
    longest chain."""
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                                  F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        after = stored(star_step(star_step(current, True), False), "edges")
        # Done when every node hangs on one root and no root on any node.
        state = after.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                                                            F.lit(0).cast("decimal(38,0)")).alias("sum")).first()
        release(current)
        current = after
        if before == tuple(state):
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = tuple(state)
