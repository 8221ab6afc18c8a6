"""Runtime marts: phases, stages, variants and their shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a pivot may have.
MOST_COLUMNS = 1000


def variant_dimension(projects: DataFrame, config: str = "configuration") -> DataFrame:
    """(project_id, variant, tries): a JSON object of variants exploded, each with the fewest tries that it names."""
    entries = projects.select(F.col("id").alias("project_id"), F.explode(F.from_json(config, "map<string,string>")).alias("variant", "_config"))
    return entries.groupBy("project_id", "variant").agg(F.min(F.get_json_object("_config", "$.tries").cast("int")).alias("tries"))


def runtime_by_group(tasks: DataFrame, keys: list[str], stage: str, runtime: str, groups: dict[str, list[str]], shared: list[str], variant: str = "variant") -> DataFrame:
    """(*keys, variant, stage_group, runtime): sums by named groups of stages; groups in ``shared`` have the variant SHARED. Other stages are left out."""
    name = F.lit(None).cast("string")
    for label, stages in groups.items():
        name = F.when(F.col(stage).isin(stages), label).otherwise(name)
    grouped = tasks.withColumn("stage_group", name).filter("stage_group is not null").withColumn("_v", F.when(F.col("stage_group").isin(shared), "SHARED").otherwise(F.col(variant)))
    return grouped.groupBy(*keys, F.col("_v").alias("variant"), "stage_group").agg(F.sum(runtime).alias("runtime"))


def with_shared(runtimes: DataFrame, keys: list[str], value: str = "runtime", variant: str = "variant") -> DataFrame:
    """Rows of each variant with the value of the key's SHARED row beside it and their sum; without a SHARED row it counts as 0."""
    shared = runtimes.filter(F.col(variant) == "SHARED").groupBy(*keys).agg(F.sum(value).alias("shared"))
    own = runtimes.filter(F.col(variant) != "SHARED")
    return own.join(shared, keys, "left").withColumn("shared", F.coalesce("shared", F.lit(0))).withColumn("with_shared", F.col(value) + F.col("shared"))


def phase_columns(phases: DataFrame, phase: str, step: str) -> list[str]:
    """Phase names by their largest step, then name: the columns of the pivot. More than MOST_COLUMNS are an error; a long form has no such end."""
    rows = phases.groupBy(phase).agg(F.max(step).alias("_s")).orderBy("_s", phase).limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} phases: name the columns")
    return [r[0] for r in rows]


def phase_pivot(phases: DataFrame, keys: list[str], phase: str, step: str, runtime: str, columns: list[str] | None = None) -> DataFrame:
    """(*keys, a column for each phase, total): summed runtimes, phases in the order of their largest step; null where a key has none."""
    columns = columns or phase_columns(phases, phase, step)
    wide = phases.groupBy(*keys).agg(*[F.sum(F.when(F.col(phase) == c, F.col(runtime))).alias(c) for c in columns], F.sum(runtime).alias("total"))
    return wide


def phase_shares(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(*keys, phase, runtime, pct of the key's total) of the pivot's phases that have a runtime."""
    rows = F.array(*[F.struct(F.lit(c).alias("phase"), F.col(c).alias("runtime")) for c in columns])
    long = wide.select(*keys, "total", F.inline(rows)).filter("runtime is not null")
    return long.select(*keys, "phase", "runtime", F.round(F.try_divide(F.col("runtime") * 100.0, F.col("total")), 2).alias("pct"))


def phase_means(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Means of the phase columns by coarser keys, such as project and budget."""
    return wide.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def runtime_comparison(tests: DataFrame, generalizations: DataFrame, variants: DataFrame) -> DataFrame:
    """(project_id, generalization_id, variant, test_runtime, runtime, per_try): a generalization beside its test; per_try is the surplus divided by the variant's tries.

    tests: (test_id, runtime); generalizations: (generalization_id, project_id, test_id, variant, runtime); variants: variant_dimension().
    """
    joined = generalizations.join(tests.select("test_id", F.col("runtime").alias("test_runtime")), "test_id").join(variants, ["project_id", "variant"])
    return joined.select("project_id", "generalization_id", "variant", "test_runtime", "runtime", F.try_divide((F.col("runtime") - F.col("test_runtime")).cast("double"), F.col("tries")).alias("per_try"))


def overhead(comparison: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n, mean_test, mean_generalized, ratio, mean_per_try): ratio of means, not mean of ratios."""
    means = comparison.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("test_runtime").alias("_t"), F.avg("runtime").alias("_g"), F.avg("per_try").alias("_p"))
    return means.select(*keys, "n", F.round("_t", 4).alias("mean_test"), F.round("_g", 4).alias("mean_generalized"), F.round(F.try_divide("_g", "_t"), 4).alias("ratio"), F.round("_p", 4).alias("mean_per_try"))


def stage_rows(runtimes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, variant, stage_group, runtime, share): SHARED groups repeated on every variant of their key, each row's share of its variant's total."""
    own = runtimes.filter("variant <> 'SHARED'")
    shared = runtimes.filter("variant = 'SHARED'").drop("variant").join(own.select(*keys, "variant").distinct(), keys)
    every = own.select(*keys, "variant", "stage_group", "runtime").unionByName(shared.select(*keys, "variant", "stage_group", "runtime"))
    total = F.sum("runtime").over(Window.partitionBy(*keys, "variant"))
    return every.withColumn("share", F.round(F.try_divide(F.col("runtime") * 100.0, total), 2))


def in_hours(seconds: Column, whole: Column) -> list[Column]:
    """hours and the percentage of ``whole``, both to two places."""
    return [F.round(seconds / 3600.0, 2).alias("hours"), F.round(F.try_divide(seconds * 100.0, whole), 2).alias("pct")]


def efficiency(runtimes: DataFrame, validation: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, variant, runtime, with_validation, detected, per_second): tool runtime with shared parts, with the validation's added, and detected mutants by second.

    runtimes: with_shared() rows; validation: (*keys, variant, validation); detected: (*keys, variant, detected). Each is one row a key and variant.
    """
    on = [*keys, "variant"]
    joined = runtimes.select(*on, F.col("with_shared").alias("runtime")).join(validation, on, "left").join(detected, on, "left").fillna(0, ["validation", "detected"])
    whole = F.col("runtime") + F.col("validation")
    return joined.select(*on, "runtime", whole.alias("with_validation"), "detected", F.round(F.try_divide(F.col("detected").cast("double"), whole), 6).alias("per_second"))


def pareto_points(points: DataFrame, group: list[str], x: str, y: str, x_tolerance: float = 0.1, y_tolerance: float = 0.001) -> DataFrame:
    """Points with is_pareto_optimal: on the front (y strictly above all before in x order), or within the tolerances of a point of the front.

    The front is one row for each of its x of a group; it is joined on the cells of a grid of the tolerances' size and the
    neighbouring ones, never pair by pair.
    """
    best = points.groupBy(*group, x).agg(F.max(y).alias(y))
    before = F.max(y).over(Window.partitionBy(*group).orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col(y) > F.col("_b")))
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    cell = lambda c, t: F.floor(F.col(c) / t)
    near = front.select(*group, F.col(x).alias("_fx"), F.col(y).alias("_fy"), F.explode(steps).alias("_dx"), cell(x, x_tolerance).alias("_cx"), cell(y, y_tolerance).alias("_cy"))
    near = near.withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.explode(F.transform(steps, lambda d: F.col("_cy") + d))).drop("_dx")
    placed = points.withColumns({"_cx": cell(x, x_tolerance), "_cy": cell(y, y_tolerance)})
    close = (F.abs(F.col(x) - F.col("_fx")) <= x_tolerance) & (F.abs(F.col(y) - F.col("_fy")) <= y_tolerance)
    names = [f"_g{i}" for i in range(len(group))]
    near = near.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], "_fx", "_fy", *[F.col(c).alias(f"_n{c}") for c in ("_cx", "_cy")])
    meets = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names, strict=True)] + [F.col("_cx") == F.col("_n_cx"), F.col("_cy") == F.col("_n_cy")]
    hit = placed.join(near, meets).filter(close).select(*group, F.col(x).alias("_hx"), F.col(y).alias("_hy")).distinct()
    on = [F.col(f"p.{g}").eqNullSafe(F.col(f"h.{g}")) for g in group] + [F.col(f"p.{x}") == F.col("h._hx"), F.col(f"p.{y}") == F.col("h._hy")]
    return points.alias("p").join(hit.alias("h"), on, "left").select("p.*", F.col("h._hx").isNotNull().alias("is_pareto_optimal"))
