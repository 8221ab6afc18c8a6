"""Tables by level, variant, mutator and cohort: exclusions, failures, detection and improvements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import excluded_by, ordered_rules, percent, simple_name, variant_name

LEVELS = ["1-TEST", "2-ASSERTION", "3-GENERALIZATION"]
SHARED = "SHARED"
#: What an extraction failure's text holds, in the order in which it decides, and what readers call it; "=" texts are the whole message.
EXTRACTION_CAUSES = [
    ("PATH_CONDITION_TOO_LARGE", "PC size limit exceeded"), ("SEARCH_DEPTH_LIMIT", "Depth limit exceeded"), ("EXECUTION_TIMEOUT", "Execution timeout"), ("NATIVE_MODEL_GAP", "Incomplete native peers"), ("TARGET_NOT_ENTERED", "Target not entered (unreachable)"), ("TARGET_NOT_EXITED", "Target not exited"),
    ("java.lang.NoSuchMethodException!!", "NoSuchMethodException"), ("java.lang.ArithmeticException: !!!div by 0", "ArithmeticException: div by 0"), ("java.lang.RuntimeException: NEWARRAY: symbolic array length", "RuntimeException: symbolic array length"),
    ("at gov.nasa.jpf.vm.NamedFields.setLongValue(NamedFields.java:158)", "ArrayIndexOutOfBoundsException (setLongValue)"), ("at gov.nasa.jpf.vm.NamedFields.setDoubleValue(NamedFields.java:164)", "ArrayIndexOutOfBoundsException (setDoubleValue)"),
    ("at gov.nasa.jpf.vm.FunctionObjectFactory.getFunctionObject(FunctionObjectFactory.java:28)", "NullPointerException (getFunctionObject)"), ("at gov.nasa.jpf.vm.GenericHeap.queueMark(GenericHeap.java:557)", "NullPointerException (queueMark)"),
    ("java.lang.OutOfMemoryError: Java heap spac", "OutOfMemoryError: Java heap space"), ("java.lang.OutOfMemoryError: GC overhead limit exceeded", "OutOfMemoryError: GC overhead"), ("org.opentest4j.AssertionFailedError", "AssertionFailedError"), ("gov.nasa.jpf.vm.NoUncaughtExceptionsProperty", "NoUncaughtExceptionsProperty"),
    ("=java.lang.ArrayIndexOutOfBoundsException\n", "ArrayIndexOutOfBoundsException (simple)"), ("=java.lang.NullPointerException\n", "NullPointerException (simple)"),
]
OTHER = "Other failures"


def exclusions(tests: DataFrame, assertions: DataFrame, generalizations: DataFrame, projects: DataFrame) -> DataFrame:
    """(variant, level, is_included, excluded_by, count) of all entities of projects to be generalized; tests and assertions are SHARED by the variants.

    Entities: project_id, is_included, exclusion_info, generalizations also variant; projects: id, use_test_generalization.
    """
    frames = [(tests, F.lit(None).cast("string")), (assertions, F.lit(None).cast("string")), (generalizations, F.col("variant"))]
    rows = reduce(DataFrame.union, [f.select("project_id", F.coalesce(v, F.lit(SHARED)).alias("variant"), F.lit(level).alias("level"), "is_included", "exclusion_info") for level, (f, v) in zip(LEVELS, frames, strict=True)])
    chosen = rows.join(projects.filter("use_test_generalization").select(F.col("id").alias("project_id")), "project_id", "left_semi")
    return chosen.groupBy("variant", "level", "is_included", excluded_by(F.col("exclusion_info")).alias("excluded_by")).agg(F.count("*").alias("count"))


def filtering(decisions: DataFrame, generalizations: DataFrame, projects: DataFrame) -> DataFrame:
    """(variant, level, filter_name, total, accept, reject, defer): decisions (project_id, level, entity_id, filter_name, decision) under the filters' simple names."""
    level = ordered_rules([(F.col("level") == n, label) for n, label in zip(("test", "assertion", "generalization"), LEVELS, strict=True)])
    own = generalizations.select(F.col("id").alias("entity_id"), F.lit("generalization").alias("level"), "variant")
    rows = decisions.join(projects.filter("use_test_generalization").select(F.col("id").alias("project_id")), "project_id", "left_semi").join(own, ["level", "entity_id"], "left")
    counts = [F.count_if(F.col("decision") == d.upper()).alias(d) for d in ("accept", "reject", "defer")]
    return rows.groupBy(F.coalesce("variant", F.lit(SHARED)).alias("variant"), level.alias("level"), simple_name(F.col("filter_name")).alias("filter_name")).agg(F.count("*").alias("total"), *counts)


def extraction_cause(info: Column) -> Column:
    """What readers call an extraction failure, by the first marker that holds; no later one is looked for."""
    rules = [(info == m[1:] if m.startswith("=") else info.contains(m), label) for m, label in EXTRACTION_CAUSES]
    return ordered_rules([(F.coalesce(c, F.lit(False)), label) for c, label in rules], OTHER)


def extraction_causes(tasks: DataFrame, stage: str = "EXECUTE_JPF") -> DataFrame:
    """(error_category, count) of failed tasks (status, stage, info) of the extraction stage."""
    failed = tasks.filter((F.col("status") == "FAILED") & (F.col("stage") == stage))
    return failed.groupBy(extraction_cause(F.col("info")).alias("error_category")).agg(F.count("*").alias("count"))


def test_failures(reports: DataFrame) -> DataFrame:
    """(variant, failure_type, count) of test reports (stage, variant, result, failure_type) that did not pass."""
    rows = reports.filter("result <> 'PASSED'")
    return rows.groupBy(variant_name(F.col("stage"), F.col("variant")).alias("variant"), simple_name(F.col("failure_type")).alias("failure_type")).agg(F.count("*").alias("count"))


def mutator_statistics(rates: DataFrame, shares: DataFrame, variants: list[str], baseline: str = "INITIAL") -> DataFrame:
    """(mutator, total_mutants, percent, min_percent, max_percent, detected_<variant> ..., detected_diff_<variant> ...), of every mutator with baseline mutants.

    rates: mutator, variant, total, covered, detected; shares: project_id, mutator, total of the baseline. Detected is the
    percentage of covered mutants, 0 without any; a variant without rows is null.
    """
    initial = rates.filter(F.col("variant") == baseline)
    whole = initial.agg(F.sum("total").alias("_all"))
    head = initial.groupBy("mutator").agg(F.sum("total").alias("total_mutants")).crossJoin(F.broadcast(whole)).select("mutator", "total_mutants", (F.col("total_mutants") * 100.0 / F.col("_all")).alias("percent"))
    by_project = shares.groupBy("project_id").agg(F.sum("total").alias("_p"))
    bounds = shares.join(by_project, "project_id").withColumn("_s", F.col("total") / F.col("_p") * 100).groupBy("mutator").agg(F.min("_s").alias("min_percent"), F.max("_s").alias("max_percent"))
    found = F.coalesce(F.try_divide(F.col("detected") * 100.0, F.col("covered")), F.lit(0.0))
    wide = rates.groupBy("mutator").agg(*[F.max(F.when(F.col("variant") == v, found)).alias(f"detected_{v.lower()}") for v in [baseline, *variants]])
    joined = head.join(bounds, "mutator").join(wide, "mutator")
    return joined.select("*", *[(F.col(f"detected_{v.lower()}") - F.col(f"detected_{baseline.lower()}")).alias(f"detected_diff_{v.lower()}") for v in variants])


def project_mutation_coverage(mutations: DataFrame, tests: DataFrame, variant: str = "INITIAL") -> DataFrame:
    """(project_id, mutants, covered, uncovered, tests, included_tests, classes, included_classes): each table is aggregated before they meet."""
    m = mutations.filter(F.col("variant_name") == variant).groupBy("project_id").agg(F.count("*").alias("mutants"), F.count_if(F.col("status") != "NO_COVERAGE").alias("covered"), F.count_if(F.col("status") == "NO_COVERAGE").alias("uncovered"))
    t = tests.groupBy("project_id").agg(F.count("*").alias("tests"), F.count_if("is_included").alias("included_tests"), F.countDistinct("class_name").alias("classes"), F.countDistinct(F.when(F.col("is_included"), F.col("class_name"))).alias("included_classes"))
    counts = ["tests", "included_tests", "classes", "included_classes"]
    return m.join(t, "project_id", "left").fillna(0, counts)


def with_mutant_percent(comparison: DataFrame, project: str = "project_id") -> DataFrame:
    """A detection comparison with detected as yes or no, and each row's percentage of its project's mutants."""
    totals = comparison.groupBy(project).agg(F.sum("count").alias("_t"))
    named = F.when(F.col("is_detected"), "yes").otherwise("no")
    return comparison.join(totals, project).withColumns({"detected": named, "mutant_percent": percent(F.col("count"), F.col("_t"))}).drop("_t", "is_detected")


def headline_improvements(rows: DataFrame, cohorts: dict[str, list], variants: list[str], project: str = "project_id", baseline: str = "INITIAL") -> DataFrame:
    """(cohort, min_pp, max_pp) over the generalized variants of each cohort's projects (project, variant, detected_pct, improvement).

    The rows must be the whole matrix of declared projects and variants: repeated, missing and undeclared pairs, and
    missing values, are errors at the call.
    """
    spark = rows.sparkSession
    declared = spark.createDataFrame([(c, p) for c, ps in cohorts.items() for p in ps], f"cohort string, {project} {dict(rows.dtypes)[project]}")
    expected = declared.select(project).distinct().crossJoin(F.broadcast(spark.createDataFrame([(v,) for v in variants], "variant string")))  # the declared matrix
    pair = F.concat_ws("/", F.col(project).cast("string"), "variant")
    counted = rows.groupBy(project, "variant").agg(F.count("*").alias("_n"), F.count_if(F.col("detected_pct").isNull() | F.col("improvement").isNull()).alias("_null"))
    both = counted.join(expected.withColumn("_e", F.lit(True)), [project, "variant"], "full")
    problem = F.when(F.col("_n") > 1, "repeated").when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "undeclared").when(F.col("_null") > 0, "without values")
    found = both.select(problem.alias("problem"), pair.alias("pair")).filter("problem is not null").orderBy("problem", "pair").limit(10).collect()
    if found:
        raise ValueError("the matrix differs from the cohorts: " + "; ".join(f"{r.problem} {r.pair}" for r in found))
    chosen = rows.filter(F.col("variant") != baseline).join(F.broadcast(declared), project)
    return chosen.groupBy("cohort").agg(F.round(F.min("improvement"), 2).alias("min_pp"), F.round(F.max("improvement"), 2).alias("max_pp"))


def in_project_order(rows: DataFrame, groups: list[list], project: str, variant: str | None = None, own_group: dict[str, int] | None = None) -> DataFrame:
    """Rows sorted by their project's group, its place in the group, the project's name and the rest of the order given by ``variant``.

    ``groups`` lists project names in their order; ``own_group`` sends a variant's rows to another group. Undeclared projects come last.
    """
    place = {p: (g, i) for g, ps in enumerate(groups) for i, p in enumerate(ps)}
    maps = [F.create_map(*[F.lit(x) for p, at in place.items() for x in (p, at[k])]) for k in (0, 1)]
    group = F.coalesce(F.try_element_at(maps[0], F.col(project)), F.lit(len(groups)))
    if variant and own_group:
        group = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in own_group.items() for x in kv]), F.col(variant)), group)
    within = F.coalesce(F.try_element_at(maps[1], F.col(project)), F.lit(2**31 - 1))
    return rows.orderBy(group, within, project, *([variant] if variant else []))


def efficiency_points(original: DataFrame, initial: DataFrame, generalized: DataFrame, group: list[str]) -> DataFrame:
    """(*group, point, kind, runtime, detected, per_second): the three classes of points of a runtime-detection plot, for pareto_points().

    Each frame has the group, point (such as a budget or variant), runtime and detected; detected per second is null without time.
    """
    frames = [("original", original), ("initial", initial), ("generalized", generalized)]
    rows = reduce(DataFrame.unionByName, [f.select(*group, "point", F.lit(k).alias("kind"), F.col("runtime").cast("double").alias("runtime"), F.col("detected").cast("double").alias("detected")) for k, f in frames])
    return rows.withColumn("per_second", F.round(F.try_divide("detected", "runtime"), 6))


def first_diagnostics(failures: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Project failures (id: the failed task) with the code and detail of the task's first diagnostic (task_id, id, reason_code, detail); a missing one is null."""
    first = diagnostics.groupBy(F.col("task_id").alias("id")).agg(F.min_by(F.struct("reason_code", "detail"), F.col("id")).alias("_d"))
    return failures.join(first, "id", "left").select(*failures.columns, "_d.reason_code", "_d.detail")
