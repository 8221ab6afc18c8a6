"""Invariant checks, reconciliation and result comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def checks(df: DataFrame, invariants: list[tuple[str, Column]]) -> DataFrame:
    """(name, violations, holds) for row-wise invariants; one pass over the data. A null result counts as a violation."""
    one = df.agg(*[F.count_if(~F.coalesce(holds, F.lit(False))).alias(f"_{i}") for i, (_, holds) in enumerate(invariants)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"_{i}").alias("violations"), (F.col(f"_{i}") == 0).alias("holds")) for i, (name, _) in enumerate(invariants)])))


def all_checks(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def unknown_categories(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """(column, n) of values outside the allowed list; empty when the set is closed."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(allowed)).groupBy(column).agg(F.count("*").alias("n"))


def result_diff(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(keys, column, left, right) where two results differ: missing rows, and values beyond the tolerance (numbers) or unequal."""
    if left.columns != right.columns:
        raise ValueError("columns differ")
    kinds = dict(left.dtypes)
    values = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    found = []
    for c in values:
        x, y = F.col("_a")[c], F.col("_b")[c]
        same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)) if kinds[c] in ("double", "float") else x.eqNullSafe(y)
        found.append(F.when(F.col("_a").isNull() | F.col("_b").isNull() | ~same, F.struct(F.lit(c).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right"))))
    return a.join(b, keys, "full").select(*keys, F.inline(F.array_compact(F.array(*found))))


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side) of keys on one side only."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def require_closed(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """The rows; a value outside the list, or null, is an error when it is read."""
    known = F.when(F.col(column).isin(allowed), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column} "), F.coalesce(F.col(column), F.lit("null")))).cast("string"))
    return df.withColumn(column, known)


def tolerant(df: DataFrame, columns: list[str], build, note_schema: str = "note string") -> DataFrame:
    """build(df) where all columns are there, else one row that names the missing ones."""
    missing = sorted(set(columns) - set(df.columns))
    if not missing:
        return build(df)
    return df.sparkSession.range(1).select(F.lit(f"skipped, missing: {', '.join(missing)}").alias(note_schema.split()[0]))


def issues(found: list[tuple[str, DataFrame]], evidence: list[str]) -> DataFrame:
    """(issue, evidence): one row for each offending row of each class of issues, with the named columns as JSON where a frame has them."""
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("issue"), F.to_json(F.struct(*[c for c in evidence if c in rows.columns])).alias("evidence")) for name, rows in found])


def share_budget(counts: DataFrame, keys: list[str], bucket: str, n: str, generic: list[str], most_pct: float) -> DataFrame:
    """(*keys, generic_pct, holds): the share of generic buckets is at most a percentage."""
    sums = counts.groupBy(*keys).agg(F.sum(F.when(F.col(bucket).isin(generic), F.col(n)).otherwise(0)).alias("_g"), F.sum(n).alias("_n"))
    return sums.select(*keys, F.round(F.try_divide(F.col("_g") * 100.0, F.col("_n")), 2).alias("generic_pct")).withColumn("holds", F.coalesce(F.col("generic_pct") <= most_pct, F.lit(True)))


def run_comparability(left: DataFrame, right: DataFrame) -> DataFrame:
    """(kind, name, left, right, severity) of differences of two runs' facts (kind, name, value): tool versions and table shapes block, other kinds warn."""
    a, b = (x.select("kind", "name", F.col("value").alias(s)) for x, s in ((left, "left"), (right, "right")))
    joined = a.join(b, ["kind", "name"], "full").filter(~F.col("left").eqNullSafe(F.col("right")))
    return joined.withColumn("severity", F.when(F.col("kind").isin("tool_version", "table_shape"), "block").otherwise("warn"))


def completeness(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, problem): keys that some sources have and others lack, and keys that a source has twice."""
    first = next(iter(sources.values())).select(key).limit(0)
    every = reduce(DataFrame.union, [first, *(f.select(key) for f in sources.values())]).distinct()
    out = []
    for name, frame in sources.items():
        counted = frame.groupBy(key).agg(F.count("*").alias("_n"))
        out.append(every.join(counted, key, "left_anti").select(key, F.lit(f"missing in {name}").alias("problem")))
        out.append(counted.filter("_n > 1").select(key, F.lit(f"repeated in {name}").alias("problem")))
    return reduce(DataFrame.union, out)


def expected_count(df: DataFrame, key: str, expected: int) -> DataFrame:
    """One row (actual, expected, holds) of distinct keys."""
    return df.agg(F.countDistinct(key).alias("actual")).select("actual", F.lit(expected).cast("long").alias("expected"), (F.col("actual") == expected).alias("holds"))


def rerun_idempotent(before: DataFrame, after: DataFrame, keys: list[str], resumed: Column) -> DataFrame:
    """(*keys, rows_before, rows_after, holds): counts by keys such as project and stage stay, but for the resumed ones, which may grow."""
    a, b = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((before, "rows_before"), (after, "rows_after")))
    joined = a.join(b, keys, "full").fillna(0, ["rows_before", "rows_after"])
    return joined.withColumn("holds", F.when(resumed, F.col("rows_after") >= F.col("rows_before")).otherwise(F.col("rows_after") == F.col("rows_before")))


def registry_findings(present: DataFrame, registered: DataFrame, name: str) -> DataFrame:
    """(name, finding): unregistered where only present, missing where only registered; names on both sides give no row."""
    p, r = present.select(name).distinct().withColumn("_p", F.lit(True)), registered.select(name).distinct().withColumn("_r", F.lit(True))
    return p.join(r, name, "full").filter("_p is null or _r is null").select(name, F.when(F.col("_r").isNull(), "unregistered").otherwise("missing").alias("finding"))


#: The largest share of a generic bucket, and the generic bucket of each table's codes.
GENERIC_SHARE = 0.3
GENERIC = {"task_diagnostic": "OTHER_COMPILE_FAILURE", "extraction_summary": "UNCAUGHT_EXCEPTION_PATH", "assertion_semantics": "UNKNOWN", "filter_result": "<none>"}


def telemetry_integrity(tables: dict[str, DataFrame | None], budget: float = GENERIC_SHARE) -> DataFrame:
    """(invariant, actual, expected, holds) of the telemetry writers: totals that must agree, and shares of generic codes within a budget.

    Tables by name: assertion, resolution, assertion_semantics (semantic_kind), generalization, lifecycle (generated_source_created,
    final_usable), outcomes, task_diagnostic (stage, reason_code), extraction_summary (failure_counts: a JSON object of
    counts), filter_result (decision, reason_code). A table that is absent (None) gives a row with its name and nulls. Every
    table is counted once, and only these one-row counts meet.
    """
    c, zero = F.col, F.lit(0).cast("long")
    of = lambda *cols: F.coalesce(F.sum(F.when(reduce(lambda a, b: a & b, cols), 1)), zero)
    built, rejected = c("stage").startswith("BUILD_"), c("decision") == "REJECT"
    counted = {
        "assertion": {"n": F.count("*")}, "resolution": {"n": F.count("*")}, "generalization": {"n": F.count("*")}, "outcomes": {"n": F.count("*")},
        "assertion_semantics": {"n": F.count("*"), "generic": of(c("semantic_kind") == GENERIC["assertion_semantics"])},
        "lifecycle": {"n": F.count("*"), "unsourced": of(~c("generated_source_created")), "usable": of(c("final_usable"))},
        "task_diagnostic": {"n": of(built), "generic": of(built, c("reason_code") == GENERIC["task_diagnostic"])},
        "filter_result": {"n": of(rejected), "generic": of(rejected, c("reason_code").isNull() | (c("reason_code") == GENERIC["filter_result"]))},
    }
    frames = []
    for name, figures in counted.items():
        if tables.get(name) is not None:
            frames.append(tables[name].agg(*[f.alias(f"{name}_{k}") for k, f in figures.items()]))
    if tables.get("extraction_summary") is not None:
        causes = tables["extraction_summary"].select(F.explode(F.from_json("failure_counts", "map<string,bigint>")).alias("cause", "k"))
        frames.append(causes.agg(F.coalesce(F.sum("k"), zero).alias("extraction_summary_n"), F.coalesce(F.sum(F.when(c("cause") == GENERIC["extraction_summary"], c("k"))), zero).alias("extraction_summary_generic")))
    if not frames:
        raise ValueError("no table is given")
    whole = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)  # one row each
    number = lambda x: x.cast("double")
    rules = [
        ("resolution total (== assertions)", ["resolution", "assertion"], lambda: (c("resolution_n"), c("assertion_n"), c("resolution_n") == c("assertion_n"))),
        ("assertion_semantics total (== assertions)", ["assertion_semantics", "assertion"], lambda: (c("assertion_semantics_n"), c("assertion_n"), c("assertion_semantics_n") == c("assertion_n"))),
        ("lifecycle rows only for generated sources (0 unsourced)", ["lifecycle"], lambda: (c("lifecycle_unsourced"), zero, c("lifecycle_unsourced") == 0)),
        ("lifecycle rows within generalizations (<=)", ["lifecycle", "generalization"], lambda: (c("lifecycle_n"), c("generalization_n"), c("lifecycle_n") <= c("generalization_n"))),
        ("outcome rows cover final_usable (>=)", ["outcomes", "lifecycle"], lambda: (c("outcomes_n"), c("lifecycle_usable"), c("outcomes_n") >= c("lifecycle_usable"))),
    ]

    def share(name):
        actual = F.coalesce(F.try_divide(number(c(f"{name}_generic")), c(f"{name}_n")), F.lit(0.0))
        return lambda: (actual, F.lit(budget), actual <= budget)

    rules += [(f"generic budget: {name} {code} share", [name], share(name)) for name, code in GENERIC.items()]
    rows = []
    for invariant, needed, values in rules:
        lost = [n for n in needed if tables.get(n) is None]
        actual, expected, holds = (F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("boolean")) if lost else values()
        text = f"(skipped: no table {lost[0]}) {invariant}" if lost else invariant
        rows.append(F.struct(F.lit(text).alias("invariant"), number(actual).alias("actual"), number(expected).alias("expected"), holds.alias("holds")))
    return whole.select(F.inline(F.array(*rows)))
