"""Failure codes and causes, by value."""

import pytest
from pyspark.sql import functions as F

from assaylake.operators import failures as X

STATE = "java.lang.IllegalStateException"
WRAPPED = ("java.lang.RuntimeException", "wrapped")


def uncaught(text):
    return (STATE, f"Identified 1 error(s) during JPF execution:\n{X.UNCAUGHT}\n\n--\n{text}")


CASES = [
    ("EXECUTE_JPF", [WRAPPED, (X.UNSUPPORTED, "SpecialIntegerExpression")], None, "UNSUPPORTED_BYTECODE"),
    ("EXECUTE_JPF", [(X.ABORTED, "PATH_CONDITION_TOO_LARGE")], None, "PC_SIZE_LIMIT"),
    ("EXECUTE_JPF", [WRAPPED, (X.ABORTED, "NATIVE_MODEL_GAP")], None, "MISSING_NATIVE_PEER"),
    ("EXECUTE_JPF", [(X.ABORTED, "something else")], None, "LISTENER_BUG"),
    ("EXECUTE_JPF", [(STATE, "no native peer here")], None, "MISSING_NATIVE_PEER"),
    ("EXECUTE_JPF", [uncaught("java.lang.UnsatisfiedLinkError: cannot find native x\n\tat y")], None, "MISSING_NATIVE_PEER"),
    ("EXECUTE_JPF", [uncaught("java.lang.UnsupportedOperationException\n\tat org.mockito.cglib.core.X(Y.java:41)")], None, "UNSUPPORTED_MOCKING"),
    ("EXECUTE_JPF", [uncaught("org.jsoup.helper.ValidationException: String must not be empty")], None, "UNCAUGHT_EXCEPTION_PATH"),
    ("EXECUTE_JPF", [uncaught("java.lang.AssertionError: expected:<3>")], None, "JPF_DIVERGENT_ASSERTION"),
    ("EXECUTE_JPF", [uncaught("org.junit.ComparisonFailure: expected:<l>")], None, "JPF_DIVERGENT_ASSERTION"),
    ("EXECUTE_JPF", [uncaught("java.lang.ClassNotFoundException: class not found: a.B")], None, "MISSING_JPF_MODEL_CLASS"),
    ("EXECUTE_JPF", [uncaught("java.lang.NoSuchMethodError: a.B.c(L)[B")], None, "MISSING_JPF_MODEL_METHOD"),
    ("EXECUTE_JPF", [(STATE, "UNSUPPORTED_TERM: x")], None, "UNSUPPORTED_BYTECODE"),
    ("EXECUTE_JPF", [(STATE, "TARGET_NOT_ENTERED")], None, "NO_INPUT_SPEC"),
    ("EXECUTE_JPF", [(STATE, "TARGET_NOT_EXITED")], None, "NO_OUTPUT_SPEC"),
    ("ANALYZE_JPF", [(X.NO_ASSERTION, None)], None, "NO_INPUT_SPEC"),
    ("BUILD_PROJECT_GENERALIZED", [(STATE, "Source option 5 is no longer supported.")], None, "GENERATED_SOURCE_LEVEL_TOO_NEW"),
    ("BUILD_PROJECT_INSTRUMENTED", [(STATE, "invalid target release: 9")], None, "OTHER_COMPILE_FAILURE"),
    ("BUILD_PROJECT_INSTRUMENTED", [(STATE, "package org.example.missing does not exist")], None, "MISSING_DEPENDENCY"),
    ("BUILD_PROJECT_INSTRUMENTED", [(STATE, "Test compiled path 'target/test-classes' does not exist.")], None, "TEST_COMPILE_OUTPUT_MISSING"),
    ("BUILD_PROJECT_GENERALIZED", [(STATE, None)], None, "OTHER_COMPILE_FAILURE"),
    ("COLLECT_JUNIT_REPORTS_GENERALIZED", [(STATE, "Report directory 'target/x' does not exist.")], None, "MISSING_REPORT_FILE"),
    ("COLLECT_JUNIT_REPORTS_GENERALIZED", [(STATE, "Unable to identify test report path for a")], None, "MISSING_REPORT_FILE"),
    ("COLLECT_JUNIT_REPORTS_ORIGINAL", [(STATE, "Failed to identify matching test case report for a.t")], None, "FOUND_REPORT_NO_MATCHING_TESTCASE"),
    ("COLLECT_JUNIT_REPORTS_ORIGINAL", [(STATE, "odd")], None, "UNSUPPORTED_REPORT_LAYOUT"),
    ("EXECUTE_TESTS_GENERALIZED", [(STATE, "Command execution timeout exceeded.")], None, "SUITE_TIMEOUT"),
    ("COLLECT_PIT_DATA_INITIAL", [WRAPPED, (STATE, "Command execution timeout exceeded.")], None, "EXECUTION_TIMEOUT"),
    ("EXECUTE_JPF", [(STATE, "Command execution timeout exceeded.")], None, "LISTENER_BUG"),
    ("COLLECT_PIT_DATA_INITIAL", [(STATE, "boom")], "No tests found", "LISTENER_BUG"),
    ("COLLECT_PIT_DATA_INITIAL", [(X.COMMAND, "exit 1")], "BUILD FAILURE MINION_DIED No tests found", "MINION_DIED"),
    ("COLLECT_PIT_DATA_INITIAL", [WRAPPED, (X.COMMAND, "exit 1")], "X does not have a no-args constructor", "PLUGIN_UNUSABLE"),
    ("COLLECT_PIT_DATA_INITIAL", [(X.COMMAND, "exit 1")], "3 tests did not pass without mutation", "SUITE_NOT_GREEN"),
    ("COLLECT_PIT_DATA_INITIAL", [(X.COMMAND, "exit 1")], "No tests found", "NO_TESTS_FOUND"),
    ("COLLECT_JACOCO_DATA_INITIAL", [(STATE, "Report file a does not exist")], None, "REPORT_ABSENT"),
    ("EXECUTE_JPF", None, None, "LISTENER_BUG"),
    (None, [], "", "LISTENER_BUG"),
]


def test_codes(spark):
    rows = [(i, stage, chain, output) for i, (stage, chain, output, _) in enumerate(CASES)]
    got = X.with_failure_code(spark.createDataFrame(rows, f"id int, stage string, chain {X.CHAIN}, output string"))
    assert {r.id: r.reason_code for r in got.collect()} == {i: c[3] for i, c in enumerate(CASES)}
    assert got.columns == ["id", "stage", "chain", "output", "reason_code", "detail"]
    assert got.filter("id = 0").first().detail == '{"throwable_type":"java.lang.RuntimeException","message":"wrapped"}'


def test_markers_overlap(spark):
    """Markers inside one another, overlapping ones and special characters; one long text is one scan."""
    marks = ["does not exist", " does not exist", "ab", "abc", "bcd", "a.c", "(s)"]
    texts = ["x does not exist", "abcd", "aXc a.c error(s)", None, "", "ab" * 200_000 + "cd"]
    want = [{"does not exist", " does not exist"}, {"ab", "abc", "bcd"}, {"a.c", "(s)"}, set(), set(), {"ab", "abc", "bcd"}]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.markers_in(F.col("t"), marks).alias("m")).collect()
    assert {r.i: set(r.m) for r in got} == dict(enumerate(want))


def test_output_of_logs(spark):
    failures = spark.createDataFrame([(1, "e1", "o1"), (2, None, "o1"), (3, "none", None)], "id int, error_path string, output_path string")
    logs = spark.createDataFrame([("e1", "oops"), ("o1", "No tests found")], "path string, text string")
    assert {r.id: r.output for r in X.with_output(failures, logs).collect()} == {1: "oops\nNo tests found", 2: "No tests found", 3: None}


@pytest.mark.parametrize(
    "stage,code,ceiling,present,seconds,want",
    [
        ("EXECUTE_TESTS_ORIGINAL", "EXECUTION_TIMEOUT", True, True, 300.0, ("1 + 2", "timeout exceeded (300 seconds per original test suite)")),
        ("EXECUTE_TESTS_ORIGINAL", None, True, True, None, ("1 + 2", "timeout exceeded (per original test suite)")),
        ("EXECUTE_TESTS_ORIGINAL", None, False, True, 2.0, ("1 + 2", "JUnit execution error during test execution")),
        ("EXECUTE_TESTS_GENERALIZED", "SUITE_TIMEOUT", True, True, 1800.5, ("4", "timeout exceeded (1800.5 seconds per generalized test suite)")),
        ("COLLECT_PIT_DATA_INITIAL", "MINION_DIED", True, True, 3600.0, ("5", "timeout exceeded (3600 seconds during PIT mutation testing for the initial test suite)")),
        ("ANALYZE_JPF", "NO_INPUT_SPEC", False, True, None, ("?", "UNCODED")),
        ("SOME_FUTURE_STAGE", "NEW_CODE", False, True, None, ("?", "UNCODED")),
        (None, None, None, None, None, ("?", "UNCODED")),
        ("BUILD_PROJECT_GENERALIZED", "OTHER_COMPILE_FAILURE", False, True, None, ("?", "UNCODED")),
        ("EXECUTE_TESTS_GENERALIZED", "LISTENER_BUG", False, True, None, ("?", "UNCODED")),
        ("FILTER_GENERALIZATIONS", None, False, True, None, ("?", "UNCODED")),
        ("BUILD_SPOON_MODEL", None, False, True, None, ("1 + 2", "Spoon execution error during test analysis")),
        ("COLLECT_JACOCO_DATA_ORIGINAL", None, False, False, None, ("5", "JaCoCo outputs not found for the original test suite")),
        ("COLLECT_JACOCO_DATA_ORIGINAL", None, False, True, None, ("5", "JaCoCo execution error while measuring the original test suite")),
        ("COLLECT_PIT_DATA_INITIAL", "PIT_REPORT_PERSISTENCE_FAILURE", False, True, None, ("5", "failed to persist PIT reports for the initial test suite")),
        ("COLLECT_PIT_DATA_GENERALIZED", "LISTENER_BUG", False, False, None, ("5", "PIT execution error for the generalized test suite")),
        ("COLLECT_PIT_DATA_GENERALIZED", "SUITE_NOT_GREEN", False, True, None, ("5", "generalized test suite has failing tests before mutation")),
        ("COLLECT_PIT_DATA_GENERALIZED", None, False, False, None, ("5", "PIT reports not found for the generalized test suite")),
        ("RESTORE_ORIGINAL_BUILD", None, False, True, None, ("5", "build restore failed")),
        ("BUILD_PROJECT_INSTRUMENTED", "OTHER_COMPILE_FAILURE", False, True, None, ("3", "instrumented project compilation failed")),
        ("COLLECT_JUNIT_REPORTS_ORIGINAL", "UNSUPPORTED_REPORT_LAYOUT", False, True, None, ("1 + 2", "unsupported JUnit report layout")),
    ],
)
def test_causes(spark, stage, code, ceiling, present, seconds, want):
    row = spark.createDataFrame([(stage, code, ceiling, present, seconds)], "s string, c string, a boolean, p boolean, t double")
    assert tuple(row.select(X.failure_cause(*[F.col(x) for x in "scapt"]).alias("c")).first().c) == want


def test_terminal_failures(spark):
    rows = [(1, "p", "FAILED", "EXECUTE_JPF", None, 5, 10, True), (2, "p", "FAILED", "EXECUTE_TESTS_INITIAL", None, 10, 10, True), (3, "p", "SUCCEEDED", "COLLECT_PIT_DATA_INITIAL", None, 1, 10, True), (4, "q", "FAILED", "RESTORE_ORIGINAL_BUILD", None, None, None, None), (5, "r", "SUCCEEDED", "EXECUTE_JPF", None, 1, 1, True)]
    tasks = spark.createDataFrame(rows, "id int, project_id string, status string, stage string, reason_code string, runtime int, timeout int, artifact_present boolean")
    got = X.terminal_failures(tasks, ["project_id"])
    assert {(r.project_id, r.failure_stage, r.cause) for r in got.collect()} == {("p", "3", "timeout exceeded (10 seconds per initial test suite)"), ("q", "5", "build restore failed")}
    assert [(r.failure_stage, r.n, r.stage_total) for r in X.cause_table(got).collect()] == [("3", 1, 1), ("5", 1, 1)]


# Exclusion evidence


def evidence_of(spark, results, tests=(), assertions=(), generalizations=(), life=(), tasks=()):
    from assaylake.operators import evidence as V

    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    r = frame(results, "id long, project_id long, test_id long, assertion_id long, generalization_id long, filter_name string, decision string, reason_code string")
    entity = "id long, project_id long, is_included boolean, exclusion_info string"
    rows = V.entities(frame(tests, entity), frame(assertions, entity), frame(generalizations, entity + ", variant string"), frame(life, "generalization_id long, generated_filter_passed boolean, generated_source_created boolean, final_failure_stage string"), frame([(1,)], "project_id long"), "V")
    return V, r, rows, V.mechanism_candidates(rows, r, frame(tasks, "test_id long, assertion_id long, generalization_id long, status string"))


def test_mechanisms(spark):
    tests = [(1, 1, True, None), (2, 1, False, "INHERITED_METHOD_NOT_FLATTENABLE: x"), (3, 1, False, None), (4, 1, False, "Excluded by A{b}"), (5, 1, None, None), (6, 9, True, None), (7, 1, True, None), (8, 1, False, None)]
    assertions = [(1, 1, True, None), (2, 1, False, "UNCOMPILABLE_INSTRUMENTED_WRAPPER"), (3, 1, True, None)]
    generalizations = [(1, 1, None, None, "V"), (2, 1, None, "ORACLE_NOT_WIDENABLE: y", "V"), (3, 1, None, None, "V"), (4, 1, None, None, "W")]
    life = [(1, True, True, None), (3, False, True, "EXECUTE_TESTS_GENERALIZED")]
    results = [(1, 1, 3, None, None, "a.filter.XFilter", "REJECT", "R"), (2, 1, 1, None, None, "a.filter.XFilter", "ACCEPT", None), (3, 1, 8, None, None, "GeneratedTestValidator", "REJECT", "UNCOMPILABLE_GENERALIZED_TEST")]
    tasks = [(7, None, None, "FAILED"), (3, None, None, "FAILED"), (1, 3, None, "FAILED"), (1, 1, 9, "FAILED"), (1, None, None, "SUCCEEDED")]
    V, _, _, found = evidence_of(spark, results, tests, assertions, generalizations, life, tasks)
    got = {(r.level, r.entity_id): r.mechanism for r in V.mechanism_partition(found).collect()}
    assert got == {
        ("Test", 1): "included", ("Test", 2): "inherited_test_inlining_limit", ("Test", 3): "filter_rejection", ("Test", 4): "task_exception", ("Test", 5): None, ("Test", 7): "task_exception", ("Test", 8): "build_quarantine",
        ("Assertion", 1): "included", ("Assertion", 2): "build_quarantine", ("Assertion", 3): "task_exception", ("Generalization", 1): "included", ("Generalization", 2): "generation_gate", ("Generalization", 3): "task_exception",
    }
    assert {(r.level, r.included, r.filtered, r.failed) for r in V.collapsed(V.mechanism_partition(found)).collect()} == {("Test", 1, 1, 4), ("Assertion", 1, 0, 2), ("Generalization", 1, 1, 1)}
    assert {r.level: (r.total, r.unclassified) for r in V.mechanism_table(V.mechanism_partition(found)).collect()} == {"Test": (7, 1), "Assertion": (3, 0), "Generalization": (3, 0)}


def test_double_mechanism_is_an_error(spark):
    V, r, rows, found = evidence_of(spark, [(1, 1, 1, None, None, "a.filter.XFilter", "REJECT", "R")], tests=[(1, 1, True, None), (2, 1, False, None)])
    with pytest.raises(Exception, match="multiply classified entity: Test:1:included,filter_rejection"):
        V.mechanism_partition(found).collect()
    none = spark.createDataFrame([], "entity_id long, declaring_type string, class_name string")
    issues = V.evidence_issues(r, rows, found, none, spark.createDataFrame([("Test", 1, "a.filter.XFilter"), ("Test", 2, "a.filter.XFilter")], "level string, entity_id long, filter_name string"))
    assert sorted(tuple(x) for x in issues.collect()) == [("incomplete proactive filter decision", "Test:a.filter.XFilter:2"), ("multiply classified entity", "Test:1:included,filter_rejection"), ("unclassified entity", "Test:2:")]
    with pytest.raises(ValueError, match="incomplete proactive filter decision=Test:a.filter.XFilter:2; multiply"):
        V.require_evidence(issues)
    V.require_evidence(issues.filter("1 = 0"))


def test_issues_of_filter_results(spark):
    results = [(1, 1, 1, 2, None, "a.filter.XFilter", "ACCEPT", None), (2, 1, None, None, None, "a.filter.XFilter", "ACCEPT", None), (3, 1, 1, None, None, "odd", None, None), (4, 1, 1, None, None, "GeneratedTestValidator", "ACCEPT", None), (5, 1, 1, None, None, "a.filter.XFilter", "REJECT", None)]
    V, r, rows, found = evidence_of(spark, results, assertions=[(7, 1, False, "NEW: x")], tests=[(1, 1, False, "ORACLE_NOT_WIDENABLE"), (2, 1, False, "INHERITED_METHOD_NOT_FLATTENABLE"), (3, 1, False, "INHERITED_METHOD_NOT_FLATTENABLE")], generalizations=[(9, 1, None, "ORACLE_NOT_WIDENABLE", "V")], life=[(9, False, True, None)])
    methods = spark.createDataFrame([(1, None, "A"), (2, "P", "A"), (3, "A", "A")], "entity_id long, declaring_type string, class_name string")
    issues = V.evidence_issues(r, rows, found, methods, spark.createDataFrame([], "level string, entity_id long, filter_name string"))
    got = {tuple(x) for x in issues.collect()}
    assert got >= {
        ("invalid filter-result identity", "filter_result:1"), ("invalid filter-result identity", "filter_result:2"), ("invalid filter-result decision", "filter_result:3:<null>"), ("unknown filter-result producer", "filter_result:3:odd"),
        ("invalid build-quarantine verdict", "filter_result:4:ACCEPT:<null>"), ("missing filter-result rejection reason", "filter_result:5:a.filter.XFilter"), ("unparsed test method path", "Test:1"), ("inherited-method exclusion without inherited path", "Test:3"),
        ("pre-emission rejection created source", "Generalization:9:ORACLE_NOT_WIDENABLE"), ("unknown typed exclusion code", "Assertion:7:NEW"), ("typed exclusion code at invalid level", "Test:1:ORACLE_NOT_WIDENABLE"), ("multiply classified entity", "Test:1:filter_rejection,build_quarantine"),
    }
