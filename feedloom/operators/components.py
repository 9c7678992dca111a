"""Connected components of an edge table by alternating stars.

Each round is two aggregations and joins on the edges (large-star, then small-star, Kiveris et al. 2014); it ends when no edge
changes.  A hub with very many neighbours is aggregated before the shuffle, and its edges are joined, so that adaptive execution can
split them.  Nothing but two numbers a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).collect()[0])


def resolve(edges: DataFrame) -> DataFrame:
    """(node, component) from edges (u, v), for all nodes but each component's smallest, which is its name.  Runs until nothing changes."""
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, before = _mark(e), None
    while seen[0] and seen != before:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, seen = seen, _mark(e)
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
