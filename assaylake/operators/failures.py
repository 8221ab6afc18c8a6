"""Why tasks failed: stable codes from exception chains and captured command output, and readers' causes by stage.

A text is read once: one pattern of all markers, as a look-ahead, gives the set of markers that it holds, and the rules
ask that set. Rules are rows of a table, the first that holds decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import STAGES, ordered_rules

CHAIN = "array<struct<type string, message string>>"

# Exception types, codes and the texts that tools print.
WRAPPERS = ["java.lang.RuntimeException", "gov.nasa.jpf.JPFListenerException"]
ABORTED, UNSUPPORTED, NATIVE_PEER, NO_ASSERTION, COMMAND = "teralizer.jpf.ExtractionAborted", "teralizer.transformer.UnsupportedSpfTermException", "gov.nasa.jpf.JPFNativePeerException", "teralizer.processing.NoGeneralizableAssertionException", "teralizer.util.ConsoleCommandException"
ABORT_REASONS = {"PATH_CONDITION_TOO_LARGE": "PC_SIZE_LIMIT", "SEARCH_DEPTH_LIMIT": "SEARCH_DEPTH_LIMIT", "EXECUTION_TIMEOUT": "EXECUTION_TIMEOUT", "NATIVE_MODEL_GAP": "MISSING_NATIVE_PEER"}
MOCKING = ["org.mockito.", "org.powermock.", "org.easymock.", "org.jmock.", "mockit."]
UNCAUGHT = "gov.nasa.jpf.vm.NoUncaughtExceptionsProperty"
UNCAUGHT_TYPES = {
    "java.lang.UnsatisfiedLinkError": "MISSING_NATIVE_PEER", "java.lang.ClassNotFoundException": "MISSING_JPF_MODEL_CLASS", "java.lang.NoSuchMethodError": "MISSING_JPF_MODEL_METHOD",
    "java.lang.AssertionError": "JPF_DIVERGENT_ASSERTION", "org.junit.ComparisonFailure": "JPF_DIVERGENT_ASSERTION",
}
MEASURED = [f"{what}_{side}" for what in ("EXECUTE_TESTS", "COLLECT_JACOCO_DATA", "COLLECT_PIT_DATA") for side in ("ORIGINAL", "INITIAL", "GENERALIZED")]
BUILDS, REPORTS = ["BUILD_PROJECT_INSTRUMENTED", "BUILD_PROJECT_GENERALIZED"], ["COLLECT_JUNIT_REPORTS_ORIGINAL", "COLLECT_JUNIT_REPORTS_GENERALIZED"]


@dataclass(frozen=True)
class Rule:
    """A code, and what it asks for: stages, the type of the unwrapped exception, and for each named text sets of markers, one of which must be held whole."""

    code: str
    stages: tuple = ()
    types: tuple = ()
    said: tuple = ()  # anywhere in the chain
    first: tuple = ()  # in the outermost message
    printed: tuple = ()  # in the captured output
    uncaught: tuple = ()  # type of the uncaught exception


def _any(*markers: str) -> tuple:
    return tuple((m,) for m in markers)


#: In this order. A set such as ("a", "b") asks for both markers.
RULES = [
    *[Rule(code, types=(ABORTED,), said=_any(reason)) for reason, code in ABORT_REASONS.items()],
    Rule("LISTENER_BUG", types=(ABORTED,)),
    Rule("UNSUPPORTED_BYTECODE", types=(UNSUPPORTED,)),
    Rule("MISSING_NATIVE_PEER", types=(NATIVE_PEER,)),
    Rule("MISSING_NATIVE_PEER", said=_any("native peer")),
    Rule("NO_INPUT_SPEC", types=(NO_ASSERTION,)),
    Rule("GENERATED_SOURCE_LEVEL_TOO_NEW", stages=("BUILD_PROJECT_GENERALIZED",), said=_any("Source option", "release version", "invalid target release")),
    Rule("OTHER_COMPILE_FAILURE", stages=("BUILD_PROJECT_INSTRUMENTED",), said=_any("Source option", "release version", "invalid target release")),
    Rule("TEST_COMPILE_OUTPUT_MISSING", stages=tuple(BUILDS), said=(("compiled path", "does not exist"),)),
    Rule("MISSING_DEPENDENCY", stages=tuple(BUILDS), said=(("package ", " does not exist"),)),
    Rule("OTHER_COMPILE_FAILURE", stages=tuple(BUILDS)),
    Rule("MISSING_REPORT_FILE", stages=tuple(REPORTS), said=(("Unable to identify test report path",), ("Report directory", "does not exist"))),
    Rule("FOUND_REPORT_NO_MATCHING_TESTCASE", stages=tuple(REPORTS), said=_any("Failed to identify matching test case report")),
    Rule("UNSUPPORTED_REPORT_LAYOUT", stages=tuple(REPORTS)),
    Rule("SUITE_TIMEOUT", stages=("EXECUTE_TESTS_GENERALIZED",), said=_any("Command execution timeout exceeded")),
    Rule("EXECUTION_TIMEOUT", stages=tuple(MEASURED), said=_any("Command execution timeout exceeded")),
    Rule("UNSUPPORTED_BYTECODE", first=_any("UNSUPPORTED_TERM")),
    Rule("NO_INPUT_SPEC", first=_any("TARGET_NOT_ENTERED")),
    Rule("NO_OUTPUT_SPEC", first=_any("TARGET_NOT_EXITED")),
    *[Rule("UNSUPPORTED_MOCKING", said=(("Identified", "error(s) during JPF execution", m),)) for m in MOCKING],
    *[Rule(code, said=(("Identified", "error(s) during JPF execution"),), uncaught=(kind,)) for kind, code in UNCAUGHT_TYPES.items()],
    Rule("UNCAUGHT_EXCEPTION_PATH", said=(("Identified", "error(s) during JPF execution"),)),
    Rule("MINION_DIED", printed=_any("MINION_DIED", "Could not find or load main class")),
    Rule("PLUGIN_UNUSABLE", printed=_any("does not have a no-args constructor", "mutationCoverage failed: null")),
    Rule("SUITE_NOT_GREEN", printed=_any("did not pass without mutation")),
    Rule("NO_TESTS_FOUND", printed=_any("No tests found")),
    Rule("REPORT_ABSENT", said=(("Report file", "does not exist"),)),
    Rule("LISTENER_BUG"),
]


def markers_in(text: Column, markers: list[str]) -> Column:
    """The set of the markers that a text holds, by one scan; overlapping ones are all found. Null holds none."""
    kept = sorted(dict.fromkeys(markers), key=lambda m: (-len(m), m))  # of two that start alike the longer one is found, and holds the shorter
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?=({'|'.join(map(re.escape, kept))}))"), F.lit(1)))
    inside = {m: [x for x in kept if x != m and x.startswith(m)] for m in kept}
    shorter = [F.when(F.arrays_overlap(found, F.array(*map(F.lit, longer))), F.array(F.lit(m))).otherwise(F.array().cast("array<string>")) for m, longer in inside.items() if longer]
    return F.array_distinct(F.concat(found, *shorter)) if shorter else found


def with_failure_code(failures: DataFrame) -> DataFrame:
    """Failures with reason_code and detail, a JSON object with the type and message of the outermost exception.

    failures: stage, chain (CHAIN, outermost exception first) and output (what a failed command printed, or null). The
    unwrapped exception is the first of the chain that is no plain wrapper, or the last. Output counts only where the chain
    has a failed command. A null or empty chain has no exception; with no rule but the last its code is LISTENER_BUG.
    """
    names = {"said": "_said", "first": "_first", "printed": "_printed"}
    wanted = {n: [m for r in RULES for markers in getattr(r, n) for m in markers] for n in names}
    chain = F.coalesce("chain", F.array().cast(CHAIN))
    rows = failures.withColumn("_chain", chain)
    inner = F.try_element_at(F.filter("_chain", lambda x: ~F.coalesce(x["type"].isin(WRAPPERS), F.lit(False))), F.lit(1))
    command = F.exists("_chain", lambda x: F.coalesce(x["type"] == COMMAND, F.lit(False)))
    kinds = F.transform("_chain", lambda x: F.regexp_extract(F.coalesce(x["message"], F.lit("")), re.escape(UNCAUGHT) + r"(?:\s+|--(?=\s*(?:\n|$)))*([^:\s]+)", 1))
    rows = rows.withColumns(
        {
            "_type": F.coalesce(inner, F.try_element_at("_chain", F.lit(-1)))["type"],
            "_said": markers_in(F.array_join(F.transform("_chain", lambda x: F.coalesce(x["message"], F.lit(""))), "\n\0\n"), wanted["said"]),
            "_first": markers_in(F.try_element_at("_chain", F.lit(1))["message"], wanted["first"]),
            "_printed": markers_in(F.when(command, F.col("output")), wanted["printed"]),
            "_uncaught": F.try_element_at(F.filter(kinds, lambda k: k != ""), F.lit(1)),
        }
    )

    def holds(rule: Rule) -> Column:
        asked = F.lit(True)
        if rule.stages:
            asked &= F.coalesce(F.col("stage").isin(list(rule.stages)), F.lit(False))
        if rule.types:
            asked &= F.coalesce(F.col("_type").isin(list(rule.types)), F.lit(False))
        if rule.uncaught:
            asked &= F.coalesce(F.col("_uncaught").isin(list(rule.uncaught)), F.lit(False))
        for name, column in names.items():
            if sets := getattr(rule, name):
                one = F.lit(False)
                for markers in sets:
                    one |= F.size(F.array_except(F.array(*map(F.lit, markers)), F.col(column))) == 0
                asked &= one
        return asked

    outer = F.try_element_at("_chain", F.lit(1))
    detail = F.to_json(F.struct(outer["type"].alias("throwable_type"), outer["message"].alias("message")))
    coded = rows.withColumns({"reason_code": ordered_rules([(holds(r), r.code) for r in RULES]), "detail": detail})
    return coded.drop("_chain", "_type", "_said", "_first", "_printed", "_uncaught")


def with_output(failures: DataFrame, logs: DataFrame) -> DataFrame:
    """Failures (error_path, output_path) with ``output``: the texts of both captured files, errors first, where there are any. logs: (path, text), one row a file."""
    text = lambda name: logs.select(F.col("path").alias(f"{name}_path"), F.col("text").alias(f"_{name}"))
    both = failures.join(text("error"), "error_path", "left").join(text("output"), "output_path", "left")
    return both.withColumn("output", F.nullif(F.concat_ws("\n", "_error", "_output"), F.lit(""))).drop("_error", "_output")


# Causes for readers. Stage groups and the causes' wording.
GROUPS = {"1 + 2": ("SETUP_PROJECT", "ADD_DEPENDENCIES", "BUILD_PROJECT_ORIGINAL", "BUILD_SPOON_MODEL", "EXECUTE_TESTS_ORIGINAL", "COLLECT_JUNIT_REPORTS_ORIGINAL", "FILTER_TESTS_ORIGINAL", "ANALYZE_TESTS", "FILTER_TESTS", "FILTER_ASSERTIONS")}
GROUPS["3"] = STAGES[STAGES.index("ADD_JPF_INSTRUMENTATION") : STAGES.index("CLEANUP_GENERALIZATION")]
GROUPS["4"] = STAGES[STAGES.index("CLEANUP_GENERALIZATION") : STAGES.index("RESTORE_ORIGINAL_BUILD")]
GROUPS["5"] = STAGES[STAGES.index("RESTORE_ORIGINAL_BUILD") :]
SUITES = {"ORIGINAL": "original test suite", "INITIAL": "initial test suite", "GENERALIZED": "generalized test suite"}
UNCODED = "UNCODED"
#: (stage, code or None, cause); a stage's rows in order, after its timeout. {} is the suite.
CAUSES = [
    ("EXECUTE_TESTS_ORIGINAL", None, "JUnit execution error during test execution"),
    ("BUILD_SPOON_MODEL", None, "Spoon execution error during test analysis"),
    ("COLLECT_JUNIT_REPORTS_ORIGINAL", "MISSING_REPORT_FILE", "JUnit report directory not found"),
    ("COLLECT_JUNIT_REPORTS_ORIGINAL", "UNSUPPORTED_REPORT_LAYOUT", "unsupported JUnit report layout"),
    ("COLLECT_JUNIT_REPORTS_ORIGINAL", None, "JUnit report collection error"),
    ("ADD_JPF_INSTRUMENTATION", None, "Spoon execution error during test instrumentation"),
    ("BUILD_PROJECT_INSTRUMENTED", None, "instrumented project compilation failed"),
    ("EXECUTE_TESTS_INITIAL", None, "JUnit execution error during initial test execution"),
    ("COLLECT_JUNIT_REPORTS_INITIAL", None, "JUnit reports not found"),
    ("RESTORE_ORIGINAL_BUILD", None, "build restore failed"),
    ("RESTORE_GENERALIZED_BUILD", None, "build restore failed"),
]
PIT_CAUSES = [
    ("PIT_MAPPING_FAILURE", "failed to import PIT reports for the {}"), ("PIT_REPORT_PERSISTENCE_FAILURE", "failed to persist PIT reports for the {}"), ("MINION_DIED", "PIT coverage minion exited for the {}"), ("PLUGIN_UNUSABLE", "PIT plugin cannot run for the {}"),
    ("SUITE_NOT_GREEN", "{} has failing tests before mutation"), ("NO_TESTS_FOUND", "PIT found no tests in the {}"), ("LISTENER_BUG", "PIT execution error for the {}"),
]
#: What a tool without outputs, and one with outputs, is said to have done; what its timeout is said of.
TOOLS = {"COLLECT_JACOCO_DATA": ("JaCoCo outputs not found for the {}", "JaCoCo execution error while measuring the {}", "during JaCoCo coverage collection for the {}"), "COLLECT_PIT_DATA": ("PIT reports not found for the {}", "PIT execution error for the {}", "during PIT mutation testing for the {}")}


def stage_group(stage: Column) -> Column:
    """The reported group of an internal stage; null for others."""
    return ordered_rules([(stage.isin(list(members)), group) for group, members in GROUPS.items()])


def timeout_cause(seconds: Column, subject: str) -> Column:
    """``timeout exceeded (300 seconds per …)``; without a known time only the subject."""
    whole = seconds == F.floor(seconds)
    shown = F.when(whole, F.floor(seconds).cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", seconds), r"\.?0+$", ""))
    return F.when(seconds.isNull(), f"timeout exceeded ({subject})").otherwise(F.concat(F.lit("timeout exceeded ("), shown, F.lit(f" seconds {subject})")))


def failure_cause(stage: Column, code: Column, at_ceiling: Column, artifact_present: Column, seconds: Column) -> Column:
    """A struct (stage, cause) of a project's final failure; ("?", UNCODED) for every signal that is not enumerated."""
    ceiling, absent = F.coalesce(at_ceiling, F.lit(False)), ~F.coalesce(artifact_present, F.lit(True))
    rules: list[tuple[Column, Column]] = []
    for s, suite in SUITES.items():
        rules.append(((stage == f"EXECUTE_TESTS_{s}") & ceiling, timeout_cause(seconds, f"per {suite}")))
    for tool, (missing, wrong, subject) in TOOLS.items():
        for s, suite in SUITES.items():
            here = stage == f"{tool}_{s}"
            rules.append((here & ceiling, timeout_cause(seconds, subject.format(suite))))
            rules += [(here & (code == c), F.lit(cause.format(suite))) for c, cause in (PIT_CAUSES if tool == "COLLECT_PIT_DATA" else [])]
            rules += [(here & absent, F.lit(missing.format(suite))), (here, F.lit(wrong.format(suite)))]
    rules += [((stage == s) & (F.lit(True) if c is None else code == c), F.lit(cause)) for s, c, cause in CAUSES]
    cause = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, label in rules:
        cause = cause.when(F.coalesce(condition, F.lit(False)), label)
    return F.struct(F.when(cause.isNotNull(), stage_group(stage)).otherwise("?").alias("stage"), F.coalesce(cause, F.lit(UNCODED)).alias("cause"))


def terminal_failures(tasks: DataFrame, key: list[str], ceiling_share: float = 0.99) -> DataFrame:
    """(*key, stage, reason_code, at_ceiling, artifact_present, timeout_seconds, failure_stage, cause): each key's last failed task with its cause.

    tasks: id, status, stage, reason_code, runtime and timeout (seconds), artifact_present. A task is at its ceiling when its code is a
    timeout, or its runtime reaches ``ceiling_share`` of the timeout.
    """
    fields = ["stage", "reason_code", "runtime", "timeout", "artifact_present"]
    last = tasks.filter("status = 'FAILED'").groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), "id")).alias("_t")).select(*key, "_t.*")
    at = F.coalesce(F.col("reason_code").isin("SUITE_TIMEOUT", "EXECUTION_TIMEOUT") | (F.col("runtime") >= F.col("timeout") * ceiling_share), F.lit(False))
    rows = last.select(*key, "stage", "reason_code", at.alias("at_ceiling"), "artifact_present", F.col("timeout").cast("double").alias("timeout_seconds"))
    found = failure_cause(F.col("stage"), F.col("reason_code"), F.col("at_ceiling"), F.col("artifact_present"), F.col("timeout_seconds"))
    return rows.withColumn("_c", found).select(*rows.columns, F.col("_c.stage").alias("failure_stage"), F.col("_c.cause").alias("cause"))


def cause_table(failures: DataFrame) -> DataFrame:
    """(failure_stage, cause, n, stage_total): causes by group, ordered by the group's place, falling count and cause."""
    counts = failures.groupBy("failure_stage", "cause").agg(F.count("*").alias("n"))
    totals = failures.groupBy("failure_stage").agg(F.count("*").alias("stage_total"))
    place = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("failure_stage"))
    return counts.join(totals, "failure_stage").orderBy(place, F.desc("n"), "cause")
