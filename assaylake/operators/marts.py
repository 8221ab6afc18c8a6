"""Composite operators: signals, effects, improvements, ledgers, outcome precedence, adjudication, statistics rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two digits; null where the whole is zero."""
    return F.round(F.try_divide(part * 100.0, whole), 2)


def signals(base: DataFrame, key: str, evidence: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """One row per base row: every evidence frame is aggregated by key before it is joined; absent evidence counts as 0."""
    for frame, measures in evidence:
        counted = frame.groupBy(key).agg(*(c.alias(n) for n, c in measures.items()))
        base = base.join(counted, key, "left").fillna(0, list(measures))
    return base


def effects(before: DataFrame, after: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Before, after, difference and percentage of change of each measure; groups that are absent on one side count as 0."""
    sides = [d.groupBy(*keys).agg(*(F.sum(m).alias(f"{m}_{s}") for m in measures)) for d, s in ((before, "before"), (after, "after"))]
    both = sides[0].join(sides[1], keys, "full").fillna(0, [f"{m}_{s}" for m in measures for s in ("before", "after")])
    for m in measures:
        delta = F.col(f"{m}_after") - F.col(f"{m}_before")
        both = both.withColumns({f"{m}_delta": delta, f"{m}_pct": percent(delta, F.col(f"{m}_before"))})
    return both


def improvement(counts: DataFrame, keys: list[str], variant: str, baseline: str, value: str) -> DataFrame:
    """Absolute and relative improvement on the baseline variant of the same keys; a missing or zero baseline gives 0."""
    base = counts.filter(F.col(variant) == baseline).select(*keys, F.col(value).alias("_base"))
    joined = counts.filter(F.col(variant) != baseline).join(base, keys, "left")
    known = F.col("_base") > 0
    absolute = F.when(known, F.col(value) - F.col("_base")).otherwise(0)
    return joined.select(*keys, variant, value, absolute.alias("absolute"), F.coalesce(F.when(known, percent(F.col(value) - F.col("_base"), F.col("_base"))), F.lit(0.0)).alias("relative"))


def missing_cells(rows: DataFrame, key: str, variant: str, variants: list[str]) -> DataFrame:
    """(key, variant): cells of the matrix of known keys and expected variants that have no row."""
    expected = rows.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, variants))).alias(variant))
    return expected.join(rows.select(key, variant), [key, variant], "left_anti")


def ledger(tasks: DataFrame, key: str, stage: str, failed: Column, required: list[str]) -> DataFrame:
    """(key, status, first_failed): failed at the first required stage with a failure, else complete if all were reached, else not_reached."""
    place = reduce(lambda c, s: c.when(F.col(stage) == s[1], s[0]), enumerate(required), F.when(F.lit(False), -1))
    seen = tasks.withColumn("_at", place).filter("_at is not null")
    folded = seen.groupBy(key).agg(F.countDistinct("_at").alias("_n"), F.min(F.when(failed, F.col("_at"))).alias("_first"))
    every = tasks.select(key).distinct().join(folded, key, "left")
    status = F.when(F.col("_first").isNotNull(), "failed").when(F.col("_n") == len(required), "complete").otherwise("not_reached")
    return every.select(key, status.alias("status"), F.try_element_at(F.array(*map(F.lit, required)), F.col("_first") + 1).alias("first_failed"))


def outcome_precedence(rows: DataFrame, keys: list[str], outcome: str, order: list[str]) -> DataFrame:
    """(keys, outcome): the first outcome of ``order`` that any row of the key shows, else unobserved."""
    flags = rows.groupBy(*keys).agg(*(F.bool_or(F.coalesce(F.col(outcome) == o, F.lit(False))).alias(f"_{i}") for i, o in enumerate(order)))
    first = F.coalesce(*(F.when(F.col(f"_{i}"), o) for i, o in enumerate(order)), F.lit("unobserved"))
    return flags.select(*keys, first.alias(outcome))


def adjudicate(decisions: DataFrame, key: str, label: str, confidence: str) -> DataFrame:
    """(key, label, confidence, reviews): the label where all agree, with the highest confidence; disputed otherwise, unreviewed without labels."""
    agg = decisions.groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.max(F.when(F.col(label).isNotNull(), F.col(confidence))).alias("_c"), F.count(label).alias("reviews"))
    same = F.col("_lo") == F.col("_hi")
    verdict = F.when(F.col("reviews") == 0, "unreviewed").when(same, F.col("_lo")).otherwise("disputed")
    return agg.select(key, verdict.alias(label), F.when(same, F.col("_c")).alias(confidence), "reviews")


def statistics_rows(rows: DataFrame, name: str, measures: list[str]) -> DataFrame:
    """The rows, then a total, a mean and a median row, all as doubles; one pass makes all three."""
    once = rows.agg(*(F.struct(F.sum(m).cast("double").alias("total"), F.avg(m).alias("mean"), F.median(m).alias("median")).alias(m) for m in measures))
    named = F.explode(F.array(*(F.struct(F.lit(k).alias(name), *(F.round(F.col(f"{m}.{k}"), 2).alias(m) for m in measures)) for k in ("total", "mean", "median"))))
    return rows.select(F.col(name).cast("string").alias(name), *(F.col(m).cast("double").alias(m) for m in measures)).union(once.select(named.alias("_r")).select("_r.*"))


def crossed_references(reports: DataFrame, owners: DataFrame, key: str, variant: str) -> DataFrame:
    """(variant, owner_variant, n): report rows of one variant that refer to an entity of another; empty where variants are isolated."""
    owned = owners.select(key, F.col(variant).alias("owner_variant"))
    return reports.join(owned, key).filter(F.col(variant) != F.col("owner_variant")).groupBy(variant, "owner_variant").agg(F.count("*").alias("n"))
