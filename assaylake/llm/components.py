"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v, as _large_star() gives them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Every node is either the centre of a star or has one edge, to a centre."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    mixed = ends.groupBy("n").agg(F.sum("below").alias("below"), F.sum("above").alias("above")).filter("below > 1 or (below = 1 and above > 0)")
    return mixed.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, root), root the smallest node reachable; one row a node that has an edge to another.

    Null ends and self-loops are ignored, repeated pairs count once, an empty input gives an empty table. Partial
    aggregation comes before every shuffle and the joins are plain equi-joins of two shuffled sides, so that a node
    with very many edges is split at run time.
    """
    edges = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars_only(edges):
        edges = saved(_small_star(saved(_large_star(edges))))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct()
