"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(
        F.col("b").alias("a"), F.col("m").alias("b")
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) \
        .filter("a > b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        linked.select("a", F.col("m").alias("b"))
    ).filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that is not a root itself.

    Each round is stored in the shared folder, which cuts the lineage; the rounds end when
    the edge list no longer changes, and then every edge points at its root.
    """
    current = materialize(edges.select("a", "b").distinct(), "star")
    before = None
    while True:
        current = materialize(_small_star(_large_star(current)), "star")
        state = tuple(current.agg(
            F.count("*"), F.expr("bit_xor(xxhash64(a, b))")
        ).first())
        if state == before or not state[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
