"""Connected components as DataFrame joins (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its larger (or its not larger) neighbours to the smallest of them and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # a > b in every edge, so all neighbours seen from a are smaller
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        out = both.join(least, "u").select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b"))
    return out.filter("a > b").distinct()


def components(edges: DataFrame, *, name: str = "components") -> DataFrame:
    """(node, root): for each node of the edges (a, b) the smallest node that it is connected with.

    Every round is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), name)
    mark = None
    while True:
        now = keep(_star(_star(now, True), False), name)
        # done when every node has one edge, and that to a root
        stats = now.agg(F.count(F.lit(1)), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if stats == mark:
            break
        mark = stats
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
