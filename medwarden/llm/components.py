"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medwarden.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # Every smaller neighbour, and the node itself, hangs on the smallest one.
    return (
        down.join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .filter(F.col("u") != F.col("v"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v): root is the smallest reachable.

    Each step is written to the shared folder; only two numbers of a step reach the driver. Minima
    are combined before the shuffle and joined back one row a node, so a node of many links is a
    skewed join at most, never a collected list.
    """
    edges = stage(edges.filter(F.col("u") != F.col("v")).distinct(), "edges")
    seen = None
    while True:
        edges = stage(_small_star(_large_star(edges)).distinct(), "stars")
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
