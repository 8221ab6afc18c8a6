"""First and latest rows, top-k, Pareto fronts and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .digests import ordered_digest


def first_per_key(df: DataFrame, keys: list[str], order: list[str], latest: bool = False) -> DataFrame:
    """One row per key, the first (or latest) by order: a partial aggregate of a struct, so no key's rows meet unreduced."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if latest else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def top_k(counts: DataFrame, n: str, tie: list[str], k: int) -> DataFrame:
    """The k largest counts, ties by the given columns, with the total over all rows."""
    total = counts.agg(F.sum(n).cast("long").alias("total"))
    return counts.orderBy(F.desc(n), *tie).limit(k).crossJoin(F.broadcast(total))


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def share_of_group(df: DataFrame, group: list[str], sub: list[str]) -> DataFrame:
    """Counts per group and sub-group with their percentage of the group; the window runs over aggregated rows only."""
    counts = df.groupBy(*group, *sub).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*group)), 2))


def pareto_front(points: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Points whose y is strictly above every point before them in (x, -y) order; equal points stay together.

    Only the best y of each x can be on the front, so the window sees one row for each x of a group.
    """
    best = points.groupBy(*group, x).agg(F.max(y).alias(y))
    before = F.max(y).over(Window.partitionBy(*group).orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col(y) > F.col("_b"))).drop("_b")
    return points.join(front, [*group, x, y], "left_semi")


def hash_sample(population: DataFrame, strata: list[str], identity: str, n: int, seed: str) -> DataFrame:
    """n rows a stratum by the order of MD5(seed, identity): the same at every run and on every cluster.

    A stratum's candidates are first cut to n in every one of 64 slices of the hash, so a large stratum is not sorted by one task.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.col(identity).cast("string")).cast("binary"))
    keyed = population.withColumn("_h", key).withColumn("_slice", F.substring("_h", -2, 2))
    local = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_slice").orderBy("_h", identity))).filter(F.col("_r") <= n)
    return local.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", identity))).filter(F.col("_r") <= n).drop("_h", "_slice", "_r")


def population_digest(df: DataFrame, identity: list[str]) -> DataFrame:
    """One row (n, sha256): the digest of all identities in their order. A repeated identity is an error."""
    return ordered_digest(df, [], identity, F.to_json(F.array(*[F.col(c).cast("string") for c in identity])))


def stratified_sample(population: DataFrame, strata: list[str], identity: str, allocation: DataFrame, seed: str) -> DataFrame:
    """Rows drawn without replacement by the order of SHA-256(seed, identity), as many a stratum as ``allocation`` (strata, wanted) says.

    A stratum with fewer rows than wanted, and a repeated identity, are errors at the call. A stratum's candidates are first cut in each
    of 256 slices of the hash, so that a large stratum is not sorted by one task.
    """
    drawn = F.sha2(F.concat(F.lit(seed + ":"), F.col(identity).cast("string")), 256)
    keyed = population.join(allocation, strata).withColumn("_h", drawn).withColumn("_slice", F.substring("_h", -2, 2))
    sizes = population.groupBy(*strata).agg(F.count("*").alias("_size"), F.countDistinct(identity).alias("_ids"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_h", identity))
    few = keyed.withColumn("_r", rank(*strata, "_slice")).filter("_r <= wanted").withColumn("_r", rank(*strata)).filter("_r <= wanted")
    wrong = (F.coalesce("_size", F.lit(0)) < F.col("wanted")) | (F.coalesce("_ids", F.lit(0)) < F.coalesce("_size", F.lit(0)))
    if bad := allocation.join(sizes, strata, "left").filter(wrong).select(*strata).first():
        raise ValueError(f"too few rows or a repeated identity in stratum {tuple(bad)}")
    return few.select(*population.columns)
