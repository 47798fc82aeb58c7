"""Connected components of a graph whose edges are a table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.skew import splittable_lookup
from clickloom.session import stored


def _hooked(edges: DataFrame, larger: bool) -> DataFrame:
    """One step: at every node, neighbours on one side are linked to the least neighbour.

    The least comes from a partial aggregate, and the join that follows is split by Spark where a
    node has very many neighbours.
    """
    if larger:  # neighbours above the node go to the least of all its neighbours and itself
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # the node and its neighbours below it go to the least of those
        sides = edges
    least = sides.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    moved = splittable_lookup(sides, least, ["a"], "a")
    if larger:
        return moved.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    down = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return down.unionByName(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of whole numbers: every node that has one and the least node it reaches.

    Each round works on the edges alone and is written to the shared folder, so that neither the
    plan nor what a lost executor must repeat grows with the number of rounds.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(now.filter("a > b").distinct(), "edges")
    mark = None
    while True:
        after = _hooked(_hooked(now, larger=True), larger=False)
        after = stored(after.filter("a > b").distinct(), "edges")
        seen = after.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == mark:
            roots = after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return roots.unionByName(
                after.select(F.col("a").alias("node"), F.col("b").alias("root"))
            )
        now, mark = after, tuple(seen)
