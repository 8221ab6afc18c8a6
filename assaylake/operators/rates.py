"""Outcome counts and rates per variant, against a baseline variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent


def outcome_counts(reports: DataFrame, keys: list[str], status: str, outcomes: dict[str, list[str]]) -> DataFrame:
    """Rows per key group: total, and one count for each named set of status values. One aggregation, summed before its shuffle."""
    return reports.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(status).isin(values)).alias(name) for name, values in outcomes.items()])


def outcome_rates(reports: DataFrame, variant: str, keys: list[str], status: str, outcomes: dict[str, list[str]], baseline: str, on_zero: float | None = None) -> DataFrame:
    """outcome_counts() by keys and variant, each count's percentage of the total, and its difference to the baseline variant's.

    Groups whose keys have no baseline row disappear; null keys never find one (plain equality).
    """
    counts = outcome_counts(reports, [*keys, variant], status, outcomes)
    rates = counts.select("*", *[percent(F.col(n), F.col("total"), on_zero).alias(f"{n}_pct") for n in outcomes])
    base = rates.filter(F.col(variant) == baseline).select(*keys, *[F.col(f"{n}_pct").alias(f"_base_{n}") for n in outcomes])
    joined = rates.join(base, keys) if keys else rates.crossJoin(F.broadcast(base.limit(1)))  # without keys the baseline is one row
    return joined.select(*keys, variant, "total", *outcomes, *[f"{n}_pct" for n in outcomes], *[F.round(F.col(f"{n}_pct") - F.col(f"_base_{n}"), 2).alias(f"{n}_diff") for n in outcomes])


#: The statuses of mutation reports that have their own figures, and the figures that are also related to covered mutants.
MUTATION_STATUSES = {"survived": "SURVIVED", "killed": "KILLED", "timed_out": "TIMED_OUT", "memory_error": "MEMORY_ERROR", "run_error": "RUN_ERROR"}
MUTATION_FIGURES = ["covered", "uncovered", "survived", "detected", "killed", "timed_out", "memory_error", "run_error"]
OF_COVERED = MUTATION_FIGURES[2:]


def mutation_rates(reports: DataFrame, keys: list[str], baseline: str = "INITIAL", variant: str = "variant_name") -> DataFrame:
    """Per keys and variant: total; each figure's count, its percentage of all mutants and, for OF_COVERED, of the covered ones; and all their differences to the baseline variant.

    One aggregation; the baseline is joined from its few rows. Without covered mutants their percentages are null. Groups without a
    baseline row disappear. Reports have status and is_detected.
    """
    counted = reports.groupBy(*keys, variant).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "NO_COVERAGE").alias("uncovered"), F.count_if("is_detected").alias("detected"), *[F.count_if(F.col("status") == s).alias(n) for n, s in MUTATION_STATUSES.items()]
    )
    counted = counted.withColumn("covered", F.col("total") - F.col("uncovered"))
    rates = counted.select("*", *[percent(F.col(n), F.col("total")).alias(f"{n}_pct") for n in MUTATION_FIGURES], *[percent(F.col(n), F.col("covered")).alias(f"{n}_of_covered_pct") for n in OF_COVERED])
    shares = [*[f"{n}_pct" for n in MUTATION_FIGURES], *[f"{n}_of_covered_pct" for n in OF_COVERED]]
    base = rates.filter(F.col(variant) == baseline).select(*keys, *[F.col(n).alias(f"_{n}") for n in MUTATION_FIGURES + shares])
    joined = rates.join(base, keys) if keys else rates.crossJoin(F.broadcast(base.limit(1)))  # without keys the baseline is one row
    differences = [*[(F.col(n) - F.col(f"_{n}")).alias(f"{n}_diff") for n in MUTATION_FIGURES], *[F.round(F.col(n) - F.col(f"_{n}"), 2).alias(f"{n}_diff") for n in shares]]
    return joined.select(*keys, variant, "total", *MUTATION_FIGURES, *shares, *differences)
