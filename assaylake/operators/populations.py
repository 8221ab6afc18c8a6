"""Nested populations, partitions into mechanisms, and complete report skeletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested_funnel(entities: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(stage, position, entering, surviving, excluded): an entity survives a stage only if it survived all before it. One aggregation."""
    alive, sums = F.lit(True), [F.count("*").alias("_0")]
    for i, (_, holds) in enumerate(stages, 1):
        alive = alive & F.coalesce(holds, F.lit(False))
        sums.append(F.count_if(alive).alias(f"_{i}"))
    one = entities.agg(*sums)
    rows = F.array(*[F.struct(F.lit(name).alias("stage"), F.lit(i + 1).alias("position"), F.col(f"_{i}").alias("entering"), F.col(f"_{i + 1}").alias("surviving"), (F.col(f"_{i}") - F.col(f"_{i + 1}")).alias("excluded")) for i, (name, _) in enumerate(stages)])
    return one.select(F.inline(rows))


def mechanism_partition(entities: DataFrame, mechanisms: list[tuple[str, Column]]) -> DataFrame:
    """(mechanism, n): each entity's one mechanism; none is UNEXPLAINED and more than one AMBIGUOUS, so that the counts always add up."""
    found = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in mechanisms]))
    label = F.when(F.size(found) == 1, F.element_at(F.when(F.size(found) == 1, found), 1)).when(F.size(found) == 0, F.lit("UNEXPLAINED")).otherwise(F.lit("AMBIGUOUS"))
    return entities.groupBy(label.alias("mechanism")).agg(F.count("*").alias("n"))


def with_flag(df: DataFrame, keys: list[str], other: DataFrame, name: str) -> DataFrame:
    """EXISTS as a column: distinct keys, left join, false where missing."""
    return df.join(other.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def survivors(df: DataFrame, keys: list[str], *failures: DataFrame) -> DataFrame:
    """Rows whose keys are in none of the failure frames."""
    for f in failures:
        df = df.join(f.select(*keys).distinct(), keys, "left_anti")
    return df


def on_skeleton(skeleton: DataFrame, counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Every skeleton row with its count, 0 where there is none."""
    return skeleton.join(counts, keys, "left").withColumn(n, F.coalesce(F.col(n), F.lit(0)))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of the given column values per row value, and the total over all values."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))


def eligible(projects: DataFrame, flag: Column, excluded: list, failures: DataFrame, key: str = "project_id") -> DataFrame:
    """(key): flagged entities that are on no exclusion list and have no row among the failures."""
    kept = projects.filter(F.coalesce(flag, F.lit(False)))
    kept = kept.filter(~F.col(key).isin(excluded)) if excluded else kept
    return kept.select(key).join(failures.select(key).distinct(), key, "left_anti")


def excluded_projects(failures: DataFrame, coverage: DataFrame, patterns: list[str], stage: str, stage_pattern: str) -> DataFrame:
    """(project_id): a failure text matches a family, or matches ``stage_pattern`` in one stage, or coverage rows exist and none covers anything.

    failures: (project_id, stage, info); coverage: (project_id, instruction_covered, branch_covered, line_covered).
    """
    text = F.col("info").rlike("|".join(f"(?:{p})" for p in patterns)) | ((F.col("stage") == stage) & F.col("info").rlike(stage_pattern))
    by_text = failures.filter(text).select("project_id")
    covered = F.coalesce(F.greatest("instruction_covered", "branch_covered", "line_covered") > 0, F.lit(False))
    by_coverage = coverage.groupBy("project_id").agg(F.bool_or(covered).alias("_any")).filter("not _any").select("project_id")
    return by_text.union(by_coverage).distinct()


def included(children: DataFrame, *parents: tuple[DataFrame, str]) -> DataFrame:
    """Included rows whose every parent is included too; parents: (frame with its key and is_included, key)."""
    out = children.filter("is_included")
    for frame, key in parents:
        out = out.join(frame.filter("is_included").select(key).distinct(), key, "left_semi")
    return out


def equivalence_members(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(member, representative, class_size): each row with the smallest member of its class; classes stay rows and are never one value."""
    classes = rows.groupBy(*keys).agg(F.min(member).alias("representative"), F.count("*").alias("class_size"))
    same = [rows[k].eqNullSafe(classes[k]) for k in keys]
    return rows.join(classes, same).select(rows[member], "representative", "class_size")


def first_seen_order(rows: DataFrame, group: str, ordinal: str) -> DataFrame:
    """(group, first_seen): groups by the smallest ordinal of their rows."""
    return rows.groupBy(group).agg(F.min(ordinal).alias("first_seen"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's columns; a repeated key on the right, and a key that the right lacks, are errors."""
    rest = [c for c in right.columns if c not in keys]
    single = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    joined = left.join(single, keys, "left")
    named = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    checked = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no row for "), named)).cast("long")).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated "), named)).cast("long")).otherwise(F.lit(0))
    return joined.withColumn("_n", checked).filter("_n = 0").select(*left.columns, "_r.*")


def suffix_join(paths: DataFrame, names: DataFrame, path: str, name: str) -> DataFrame:
    """Rows whose path ends in the name: by the last segment, as an equi-join."""
    return paths.withColumn("_last", F.substring_index(F.rtrim(F.col(path), F.lit("/")), "/", -1)).join(names.withColumn("_last", F.substring_index(F.col(name), "/", -1)), "_last").filter(F.rtrim(F.col(path), F.lit("/")).endswith(F.col(name))).drop("_last")
