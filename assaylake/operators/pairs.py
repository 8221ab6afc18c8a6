"""Joins of runs, variants and covered locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def membership_pairs(arrays: DataFrame, array: str, rows: DataFrame, member: str, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Distinct (left_id, right_id) with equal keys whose member is in the array: exploded to an equi-join, never compared pair by pair.

    Both sides are made distinct before the join, so that a repeated location costs one row; a hot location is split
    by adaptive execution, as both sides are plainly shuffled.
    """
    left = arrays.select(*keys, left_id, F.explode(array).alias("_m")).distinct()
    right = rows.select(*keys, right_id, F.col(member).alias("_m")).distinct()
    return left.join(right, [*keys, "_m"]).select(left_id, right_id).distinct()


def variant_pairs(reports: DataFrame, key: list[str], variant: str, value: str) -> DataFrame:
    """Every ordered pair of one key's different variants with both values; null variants take no part."""
    a = reports.select(*key, F.col(variant).alias("variant_a"), F.col(value).alias("value_a"))
    b = reports.select(*key, F.col(variant).alias("variant_b"), F.col(value).alias("value_b"))
    return a.join(b, key).filter("variant_a <> variant_b")


def against_baseline(rows: DataFrame, keys: list[str], variant: str, baseline: str, value: str) -> DataFrame:
    """Rows with their key's baseline value and the difference; keys without a baseline vanish."""
    base = rows.filter(F.col(variant) == baseline).select(*keys, F.col(value).alias("baseline"))
    return rows.join(base, keys).withColumn("diff", F.col(value) - F.col("baseline"))


def full_pairing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, in_left, in_right) over both sides' distinct keys."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    return a.join(b, keys, "full").select(*keys, F.coalesce("_l", F.lit(False)).alias("in_left"), F.coalesce("_r", F.lit(False)).alias("in_right"))


def child_extension(parents: DataFrame, children: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """Parents with their children's count and sums, zero where there are none; children are aggregated before the join."""
    grouped = children.groupBy(key).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    return parents.join(grouped, key, "left").select(*[parents[c] for c in parents.columns], F.coalesce("_n", F.lit(0)).alias("children"), *[F.coalesce(f"_{n}", F.lit(0)).alias(n) for n in sums])


def fan_out_statistics(values: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """Average and exact median of a value that a join repeats ``weight`` times, without making the product."""
    counted = values.groupBy(*group, value).agg(F.sum(weight).alias("_w"))
    return counted.groupBy(*group).agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("mean"), F.expr(f"percentile(`{value}`, 0.5, _w)").alias("median"))


def represented_parents(children: DataFrame, parent: str, child: str, covered: DataFrame) -> DataFrame:
    """Parents every one of whose children is in ``covered`` (parent, child)."""
    hit = covered.select(parent, child).distinct().withColumn("_hit", F.lit(1))
    return children.select(parent, child).distinct().join(hit, [parent, child], "left").groupBy(parent).agg(F.count("*").alias("children"), F.count("_hit").alias("_hits")).filter("children = _hits").drop("_hits")
