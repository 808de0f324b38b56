"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so no vertex's neighbours are gathered in one place; the edge table is
checkpointed after each pair of steps, and its size doesn't grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """edges: (a, b) longs. Returns (v, root) for every vertex that isn't the least of its component, and their number; root is the least."""
    e, n = C.counted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # done when every vertex has one edge to a vertex without any
        roots = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = roots.where("n > 1").select("u").unionByName(e.select(F.col("v").alias("u")).join(C.sized(e.select("u"), n), "u", "left_semi"))
        if open_.isEmpty():
            return e.select(F.col("u").alias("v"), F.col("v").alias("root")), n
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(C.sized(least, 2 * n), "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(C.sized(least, n), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, n = C.counted(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
