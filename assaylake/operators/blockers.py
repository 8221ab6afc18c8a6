"""Reject chains: which rule stops an entity first, which stand behind it, and first-cause attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reject_chain(decisions: DataFrame, entity: str, name: str, order: list[str]) -> DataFrame:
    """(entity, name, position): each entity's rejecting rules in order."""
    return decisions.select(entity, name, F.row_number().over(Window.partitionBy(entity).orderBy(*order)).alias("position"))


def blocker_summary(chain: DataFrame, entity: str, name: str) -> DataFrame:
    """Per rule: entities where it is first, rejections in all, and those shadowed by an earlier one."""
    return chain.groupBy(name).agg(F.count_if(F.col("position") == 1).alias("first_rejects"), F.count("*").alias("total_rejects"), F.count_if(F.col("position") > 1).alias("shadowed"))


def first_two(chain: DataFrame, entity: str, name: str) -> DataFrame:
    """(first, second, n): entities by their first and second blocker."""
    at = lambda p: F.max(F.when(F.col("position") == p, F.col(name)))
    pairs = chain.groupBy(entity).agg(at(1).alias("first"), at(2).alias("second"))
    return pairs.filter("second is not null").groupBy("first", "second").agg(F.count("*").alias("n"))


def multi_blocker_rate(chain: DataFrame, entity: str) -> DataFrame:
    """One row: entities, those with more than one blocker, and their percentage."""
    sizes = chain.groupBy(entity).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("entities"), F.count_if(F.col("n") > 1).alias("multi")).withColumn("multi_pct", F.round(F.try_divide(F.col("multi") * 100.0, F.col("entities")), 2))


def blocker_combos(decisions: DataFrame, entity: str, name: str, k: int) -> DataFrame:
    """The k most frequent sets of rules per entity, as 'A+B'; ties by text."""
    combos = decisions.groupBy(entity).agg(F.array_join(F.array_sort(F.collect_set(name)), "+").alias("combo"))
    return combos.groupBy("combo").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combo").limit(k)


def sole_blocked(decisions: DataFrame, entity: str, name: str) -> DataFrame:
    """(entity, name) of entities that exactly one rule blocks."""
    return decisions.groupBy(entity).agg(F.countDistinct(name).alias("_n"), F.min(name).alias(name)).filter("_n = 1").drop("_n")


def first_cause(entities: DataFrame, entity: str, evidence: list[tuple[str, DataFrame]], otherwise: str = "UNKNOWN") -> DataFrame:
    """(entity, cause): the label of the first evidence frame, by priority, that holds the entity.

    The evidence is folded into one small row per entity before the only join, so many sources cost one shuffle each
    of their ids, not one of the entities.
    """
    seen = None
    for rank, (_, frame) in enumerate(evidence):
        keyed = frame.select(entity).withColumn("_rank", F.lit(rank))
        seen = keyed if seen is None else seen.unionByName(keyed)
    best = seen.groupBy(entity).agg(F.min("_rank").alias("_rank"))
    labels = F.array(*[F.lit(label) for label, _ in evidence])
    return entities.select(entity).join(best, entity, "left").select(entity, F.coalesce(F.get(labels, F.col("_rank")), F.lit(otherwise)).alias("cause"))


def with_shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts with their total and percentage of it; the total is one row, joined by broadcast."""
    total = counts.agg(F.sum(n).alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.round(F.try_divide(F.col(n) * 100.0, F.col("total")), 2))


def verdicts(decisions: DataFrame, entity: str, decision: str, code: str, order: list[str]) -> DataFrame:
    """(entity, excluded, code): excluded when any rule rejects; the code of the first rejecting rule."""
    rejects: Column = F.col(decision) == "REJECT"
    return decisions.groupBy(entity).agg(F.bool_or(rejects).alias("excluded"), F.min_by(F.col(code), F.when(rejects, F.struct(*order))).alias("code"))
