"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop, fresh_path, keep


def _least(pairs: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours v."""
    return pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour greater than a node goes to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    return down.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for the nodes of edges (u, v), longs; loops and repeated edges are allowed.

    Rounds go on until a pair of stars changes nothing: about the logarithm of the longest path. Only counts and a hash
    sum come to the driver. A node with very many neighbours is split by the join and pre-aggregated by the minimum.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "stars")
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "", path)
    state = None
    while True:
        new_path = fresh_path(spark, "stars")
        stars = keep(small_star(large_star(now)), "", new_path)
        new = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(spark, path)
        now, path = stars, new_path
        if new == state:
            break
        state = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
