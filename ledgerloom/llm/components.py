"""Connected components of a link table by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour v of u is linked to the least of u and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and every smaller neighbour of u are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is a centre or has exactly one edge, to its centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf")).union(edges.select("v", F.lit(0)))
    per = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("least"))
    return not per.filter("leaf > 1 OR (leaf = 1 AND least = 0)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (u, v); component is the least node reachable.

    A node of any degree is a partial aggregate and one side of a join on its key, which Spark splits; nothing is gathered by node."""
    edges = materialize(links.filter("u != v").select("u", "v"), "links")
    while True:
        edges = materialize(_small_star(_large_star(edges)).distinct(), "links")
        if _are_stars(edges):
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
