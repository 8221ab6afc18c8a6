"""Cohort tables on odd rows."""

import pytest
from pyspark.sql import functions as F

from assaylake.operators import cohorts, runtimes


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_extraction_causes(spark):
    """The first marker of the list decides, wherever it stands; whole messages only as a whole."""
    texts = {
        "x SEARCH_DEPTH_LIMIT then PATH_CONDITION_TOO_LARGE": "PC size limit exceeded", "TARGET_NOT_EXITED": "Target not exited", "java.lang.NullPointerException\n": "NullPointerException (simple)", "java.lang.NullPointerException": "Other failures", "a java.lang.NullPointerException\n": "Other failures",
        "java.lang.OutOfMemoryError: Java heap space": "OutOfMemoryError: Java heap space", "at gov.nasa.jpf.vm.GenericHeap.queueMark(GenericHeap.java:557) gov.nasa.jpf.vm.NoUncaughtExceptionsProperty": "NullPointerException (queueMark)", "gov.nasa.jpf.vm.NoUncaughtExceptionsProperty org.opentest4j.AssertionFailedError": "AssertionFailedError", "": "Other failures", None: "Other failures",
    }
    df = spark.createDataFrame([(t,) for t in texts], "info string")
    assert {r.info: r.c for r in df.select("info", cohorts.extraction_cause(F.col("info")).alias("c")).collect()} == texts
    tasks = df.selectExpr("info", "'FAILED' as status", "'EXECUTE_JPF' as stage").union(df.selectExpr("info", "'SUCCEEDED'", "'EXECUTE_JPF'")).union(df.selectExpr("info", "'FAILED'", "'ANALYZE_JPF'"))
    assert dict(rows_of(cohorts.extraction_causes(tasks)))["Other failures"] == 4


def test_extraction_markers_are_not_sought_again_for_each_rule(spark):
    """A scan for all markers was made again by each of the rules that asked for its result."""
    tasks = spark.createDataFrame([("FAILED", "EXECUTE_JPF", "x")], "status string, stage string, info string")
    plan = cohorts.extraction_causes(tasks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 1


def test_headline_refuses_another_matrix(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "project string, variant string, detected_pct double, improvement double")
    whole = [(p, v, 50.0, {"INITIAL": 0.0, "N": 1.255, "I": float(len(p))}[v]) for p in ("a", "bb") for v in ("INITIAL", "N", "I")]
    run = lambda *x: cohorts.headline_improvements(rows(*x), {"one": ["a"], "two": ["bb"]}, ["INITIAL", "N", "I"], "project")
    assert [(c, lo, hi) for c, lo, hi in rows_of(run(*whole))] == [("one", 1.0, pytest.approx(1.26, abs=0.011)), ("two", pytest.approx(1.26, abs=0.011), 2.0)]
    for bad, problem in ((whole[1:], "missing a/INITIAL"), ([*whole, whole[0]], "repeated a/INITIAL"), ([*whole, ("c", "N", 1.0, 1.0)], "undeclared c/N"), ([*whole[1:], ("a", "INITIAL", None, 0.0)], "without values a/INITIAL")):
        with pytest.raises(ValueError, match=problem):
            run(*bad)


def test_project_order(spark):
    df = spark.createDataFrame([("z", "V"), ("b", "V"), ("a", "W"), ("c", "V"), ("a", "V"), ("y", "V")], "p string, v string")
    assert [tuple(r) for r in cohorts.in_project_order(df, [["c", "a"], ["b"]], "p", "v").collect()] == [("c", "V"), ("a", "V"), ("a", "W"), ("b", "V"), ("y", "V"), ("z", "V")]
    assert [tuple(r) for r in cohorts.in_project_order(df, [["c", "a"], ["b"]], "p", "v", {"W": 9}).collect()][-1] == ("a", "W")
    assert cohorts.in_project_order(df.filter("1 = 0"), [["c"]], "p").count() == 0


def test_three_classes_of_points(spark):
    frame = lambda *x: spark.createDataFrame(list(x), "g long, point string, runtime long, detected long")
    points = cohorts.efficiency_points(frame((1, "o", 10, 5)), frame((1, "i", 0, 1)), frame((1, "n", 20, 5), (1, "m", 30, 9)), ["g"])
    assert rows_of(points.select("point", "kind", "per_second")) == [("i", "initial", None), ("m", "generalized", 0.3), ("n", "generalized", 0.25), ("o", "original", 0.5)]
    best = runtimes.pareto_points(points, ["g"], "runtime", "detected")
    assert {r.point: r.is_pareto_optimal for r in best.collect()} == {"i": True, "o": True, "n": False, "m": True}


def test_mutator_statistics(spark):
    rates = spark.createDataFrame([("A", "INITIAL", 4, 4, 1), ("A", "V", 4, 4, 3), ("B", "INITIAL", 4, 0, 0), ("C", "V", 9, 9, 9)], "mutator string, variant string, total long, covered long, detected long")
    shares = spark.createDataFrame([(1, "A", 3), (1, "B", 1), (2, "A", 1), (2, "B", 3)], "project_id long, mutator string, total long")
    assert rows_of(cohorts.mutator_statistics(rates, shares, ["V"])) == [("A", 4, 50.0, 25.0, 75.0, 25.0, 75.0, 50.0), ("B", 4, 50.0, 25.0, 75.0, 0.0, None, None)]


def test_exclusions_keep_projects_to_generalize(spark):
    entity = "project_id long, is_included boolean, exclusion_info string"
    tests = spark.createDataFrame([(1, False, "Excluded by A{x}"), (1, True, None), (2, False, "Excluded by A{x}")], entity)
    own = spark.createDataFrame([(1, None, "odd", "V"), (1, None, "odd", None)], entity + ", variant string")
    projects = spark.createDataFrame([(1, True), (2, None)], "id long, use_test_generalization boolean")
    assert rows_of(cohorts.exclusions(tests, tests.filter("1 = 0"), own, projects)) == [("SHARED", "1-TEST", False, "A", 1), ("SHARED", "1-TEST", True, None, 1), ("SHARED", "3-GENERALIZATION", None, None, 1), ("V", "3-GENERALIZATION", None, None, 1)]
