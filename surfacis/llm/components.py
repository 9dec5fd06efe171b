"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected(edges: DataFrame) -> DataFrame:
    """Components of edges (u, v): one row (id, component) for each id of an edge, component the smallest id reachable.

    Each round every vertex hands its neighbours to the smallest one (min() combines before the shuffle,
    the join back on a hot hub is one that AQE splits), so hubs shrink instead of being listed in one task.
    Rounds grow with the logarithm of the longest chain. Nulls and self-links are dropped, repeats merge.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stage(e, "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    hubs = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(hubs)


def _stars(e: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour at most, which has none."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    seen = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.where("down > 1 OR (down > 0 AND up > 0)").isEmpty()
