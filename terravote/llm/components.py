"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node's (large: greater; small: not greater) neighbours are hung on the least of them."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = (both if large else both.filter(F.col("b") < F.col("a"))).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("n", "m").alias("m"))
    side = both.filter(F.col("b") > F.col("a")) if large else both.filter(F.col("b") < F.col("a"))
    hung = side.join(least, side["a"] == least["n"]).select(F.col("b").alias("x"), "m")
    if not large:
        hung = hung.unionByName(least.select(F.col("n").alias("x"), "m"))
    return hung.filter(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component.

    Every round is two shuffles of the remaining edges, written to the shared folder.  It ends when no edge changes, after
    a number of rounds that grows with the logarithm of the number of nodes.
    """
    edges = saved(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    mark = None
    for _ in range(rounds):
        edges = saved(_stars(_stars(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(now)
    raise RuntimeError("components did not settle")
