"""Report files to typed tables: mutation, line-coverage and test XML, coverage and statistics CSV, ledgers.

Schemas are explicit and never inferred. A report's step, stage, variant and project stand in its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import matched
from ..operators.quality import require_columns
from ..scratch import saved

MUTATION = """_detected boolean, _status string, _numberOfTestsRun int, sourceFile string, mutatedClass string, mutatedMethod string, methodDescription string,
lineNumber int, mutator string, indexes struct<index: array<int>>, blocks struct<block: array<int>>, killingTest string, description string"""
BLOCK = "_classname string, _method string, _number int, tests struct<test: array<struct<_name: string, _VALUE: string>>>"
TESTCASE = "_classname string, _name string, _time double, failure struct<_message: string, _type: string, _VALUE: string>, error struct<_message: string, _type: string, _VALUE: string>, skipped struct<_message: string, _VALUE: string>"
COVERAGE = "`GROUP` string, PACKAGE string, CLASS string, INSTRUCTION_MISSED int, INSTRUCTION_COVERED int, BRANCH_MISSED int, BRANCH_COVERED int, LINE_MISSED int, LINE_COVERED int, COMPLEXITY_MISSED int, COMPLEXITY_COVERED int, METHOD_MISSED int, METHOD_COVERED int"


def path_fields(path: Column) -> list[Column]:
    """step, stage, variant and project_id of a path like .../project-id-7/12-STAGE.VARIANT.name.xml; null where absent."""
    name = F.substring_index(path, "/", -1)
    return [
        matched(name, r"^(\d+)-").cast("int").alias("step"),
        matched(name, r"^\d+-([A-Z0-9_]+)").alias("stage"),
        matched(name, r"^\d+-[A-Z0-9_]+\.([A-Z0-9_]+)\.").alias("variant"),
        matched(path, r"project-id-(\d+)/").cast("long").alias("project_id"),
    ]


def split_class(name: Column) -> tuple[Column, Column]:
    """(package, class): split at the last dot; no dot means no package."""
    simple = F.substring_index(name, ".", -1)
    package = F.when(F.length(name) > F.length(simple), F.expr("1")).isNotNull()
    return F.when(package, F.substring(name, F.lit(1), F.length(name) - F.length(simple) - 1)), simple


#: Names of tests as engine paths, with a qualified or a display name before them; groups are the class and the method.
ENGINE_PATH = r"(?U)\A[\w$.]+\.[^/]+/\[(?:class|runner):([\w$.]+)\](?:/\[(?:method|property|test|test-template):([\w$]+)\(.*?\)\])?(?:/\[test-template-invocation:.*\])?\z"
DISPLAY_PATH = r"(?U)\A\s[\w$]+(?:[ _][\w$]+)*\.[^/]+/\[class:([\w$.]+)\](?:/\[property:([\w$]+)\(.*?\)\])?(?:/\[test-template-invocation:.*\])?\z"


def test_identity(name: Column) -> list[Column]:
    """test_class (qualified), test_package ('' without one), test_simple_class, test_method and test_qualified_method of an engine path.

    A class alone has null methods; a name that neither pattern matches wholly gives nulls.
    """
    part = lambda i: F.when(name.rlike(ENGINE_PATH), matched(name, ENGINE_PATH, i)).otherwise(matched(name, DISPLAY_PATH, i))
    cls, method = part(1), part(2)
    simple = F.substring_index(cls, ".", -1)
    package = F.when(F.instr(cls, ".") > 1, F.substring(cls, F.lit(1), F.length(cls) - F.length(simple) - 1)).when(cls.isNotNull(), "")
    return [cls.alias("test_class"), package.alias("test_package"), simple.alias("test_simple_class"), method.alias("test_method"), F.concat(cls, F.lit("."), method).alias("test_qualified_method")]


def name_ids(entities: DataFrame, name: str, keys: list[str] = ()) -> DataFrame:
    """(*keys, name, id): the smallest id of each qualified name, such as by project, and by variant for generalizations."""
    return entities.groupBy(*keys, name).agg(F.min("id").alias("id"))


def with_ids(rows: DataFrame, tests: DataFrame, generalizations: DataFrame, keys: list[str], variant_keys: list[str]) -> DataFrame:
    """Rows of test_identity() with test_id and generalization_id by qualified method name; names that are neither keep nulls.

    tests: name_ids() by ``keys``; generalizations: by ``variant_keys``; both with the column test_qualified_method.
    """
    out = rows.join(tests.withColumnRenamed("id", "test_id"), [*keys, "test_qualified_method"], "left")
    return out.join(generalizations.withColumnRenamed("id", "generalization_id"), [*variant_keys, "test_qualified_method"], "left")


def unattributed(mutations: DataFrame) -> DataFrame:
    """One row: detected mutants, and those whose killing test is neither a known test nor a known generalization."""
    return mutations.agg(F.count_if("is_detected").alias("detected"), F.count_if(F.col("is_detected") & F.col("test_id").isNull() & F.col("generalization_id").isNull()).alias("unattributed"))


def report_name(name: Column) -> Column:
    """Spaces before the first bracket become underscores; a bracket in front counts as none."""
    at = F.instr(name, "(")
    return F.when(at > 1, F.concat(F.replace(F.substring(name, F.lit(1), at - 1), F.lit(" "), F.lit("_")), F.substring(name, at, F.length(name)))).otherwise(F.replace(name, F.lit(" "), F.lit("_")))


def match_reports(expected: DataFrame, reports: DataFrame, expected_name: str, reported: str, keys: list[str] = ()) -> DataFrame:
    """Pairs of expected names and reports whose normalized name equals it or is what follows one of its dots.

    Joined by the method's name and then filtered, so that no two sides are compared row by row.
    """
    method = lambda c: F.substring_index(F.substring_index(c, "(", 1), ".", -1)
    left = expected.withColumn("_m", method(F.col(expected_name)))
    right = reports.withColumn("_n", report_name(F.col(reported))).withColumn("_m", method(F.col("_n")))
    same = (F.col(expected_name) == F.col("_n")) | F.col(expected_name).endswith(F.concat(F.lit("."), F.col("_n")))
    return left.join(right, [*keys, "_m"]).filter(same).drop("_m", "_n")


def test_records(tests: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """One row per test: test cases with a valid class and method name, none of an inner class, and none that say 'No tests found'.

    Names lose their argument lists; of several cases of a test one with a recorded outcome other than passed comes first,
    then the first by path.
    """
    word = r"[\p{L}_$\p{Sc}][\p{L}\p{N}_$\p{Sc}]*"
    plain = F.regexp_replace(F.col("test_name"), r"\(.*", "")
    usable = tests.withColumn("method_name", plain).filter(
        F.col("class_name").rlike(rf"\A{word}(\.{word})*\z") & ~F.col("class_name").contains("$") & F.col("method_name").rlike(rf"\A{word}\z") & ~F.coalesce(F.col("failure_message").startswith("No tests found"), F.lit(False))
    )
    rank = F.struct(F.col("result") == "PASSED", F.col(path), F.col("test_name"))
    rest = [c for c in usable.columns if c not in (*keys, "class_name", "method_name")]
    return usable.groupBy(*keys, "class_name", "method_name").agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*keys, "class_name", "method_name", "_r.*")


def _xml(spark: SparkSession, path, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema).load(path).withColumn("_path", F.col("_metadata.file_path"))


def read_mutations(spark: SparkSession, path) -> DataFrame:
    """One row a mutant; indexes and blocks are sorted before they become JSON, as they are part of its identity."""
    package, name = split_class(F.col("mutatedClass"))
    json = lambda c: F.to_json(F.array_sort(F.coalesce(c, F.array().cast("array<int>"))))
    raw = _xml(spark, path, "mutation", MUTATION)
    return raw.select(
        *path_fields(F.col("_path")), F.col("_detected").alias("is_detected"), F.col("_status").alias("status"), F.col("_numberOfTestsRun").alias("tests_run"), package.alias("package_name"), name.alias("class_name"),
        F.col("mutatedMethod").alias("method_name"), F.col("methodDescription").alias("method_description"), F.col("lineNumber").alias("line_number"), "mutator",
        json(F.col("indexes.index")).alias("indexes"), json(F.col("blocks.block")).alias("blocks"), F.nullif(F.col("killingTest"), F.lit("")).alias("killing_test"), *test_identity(F.col("killingTest")),
    )


def read_line_coverage(spark: SparkSession, path) -> DataFrame:
    """One row a (block, test); blocks without tests give none. The method is split at its first bracket."""
    package, name = split_class(F.col("_classname"))
    rows = _xml(spark, path, "block", BLOCK).withColumn("_test", F.explode("tests.test"))
    method = F.substring_index("_method", "(", 1)
    return rows.select(*path_fields(F.col("_path")), package.alias("covered_package"), name.alias("covered_class"), method.alias("covered_method"), F.expr("substring(_method, length(substring_index(_method, '(', 1)) + 1)").alias("covered_description"), F.col("_number").alias("covered_block"), F.col("_test._name").alias("test_name"), *test_identity(F.col("_test._name")))


def read_tests(spark: SparkSession, path) -> DataFrame:
    """One row a test case; a later child wins: passed, then failed, skipped, error."""
    result = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("skipped").isNotNull(), "SKIPPED").when(F.col("failure").isNotNull(), "FAILED").otherwise("PASSED")
    why = F.coalesce(F.col("error"), F.col("failure"))
    rows = _xml(spark, path, "testcase", TESTCASE)
    return rows.select(*path_fields(F.col("_path")), F.col("_classname").alias("class_name"), F.col("_name").alias("test_name"), F.regexp_replace("_name", r"\(.*", "").alias("method_name"), F.col("_time").alias("runtime"), result.alias("result"), why["_type"].alias("failure_type"), why["_message"].alias("failure_message"))


def best_reports(tests: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: one with a recorded outcome, then one with a failure, else the smallest by its columns."""
    rank = F.struct(F.col("result").isNull(), F.col("failure_type").isNull(), F.to_json(F.struct(*tests.columns)))
    rest = [c for c in tests.columns if c not in keys]
    return tests.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def read_coverage_csv(spark: SparkSession, path) -> DataFrame:
    """Strict: a header with these names, quoted fields, one column count; anything else is an error."""
    rows = spark.read.schema(COVERAGE).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("columnPruning", False).option("escape", '"').csv(path)
    return rows.withColumn("_path", F.col("_metadata.file_path")).select(*[F.col(c).alias(c.lower()) for c in rows.columns if c != "GROUP"], *path_fields(F.col("_path")))


def read_statistics_csv(spark: SparkSession, path) -> DataFrame:
    """Required columns by name, whatever others there are; values are trimmed."""
    rows = require_columns(spark.read.option("header", True).csv(path), ["TARGET_CLASS", "criterion", "Coverage", "Total_Goals", "Covered_Goals"])
    return rows.select(F.trim("TARGET_CLASS").alias("class_name"), F.trim("criterion").alias("criterion"), F.trim("Coverage").cast("double").alias("coverage"), F.trim("Total_Goals").cast("int").alias("total_goals"), F.trim("Covered_Goals").cast("int").alias("covered_goals"))


def ledger_progress(spark: SparkSession, path) -> DataFrame:
    """One row of counts: attempts, done (exit 0), capped (124), other."""
    rows = spark.read.option("sep", "\t").schema("n long, root_path string, exit_code int").csv(path).filter("n is not null")
    return rows.agg(F.count("*").alias("attempts"), F.count_if(F.col("exit_code") == 0).alias("done"), F.count_if(F.col("exit_code") == 124).alias("capped"), F.count_if(~F.col("exit_code").isin(0, 124)).alias("other"))


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line_no from 0, value) of text files of any size: lines are counted by split and the splits' counts summed, so that no file is one task's."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), "value", F.monotonically_increasing_id().alias("_id"))
    lines = saved(raw)
    splits = lines.groupBy("file", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))  # a row a split
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "_at", (before - F.col("_first")).alias("_shift"))
    return lines.join(starts, ["file", "_at"]).select("file", (F.col("_id") + F.col("_shift")).alias("line_no"), "value")


def unescaped(value: Column) -> Column:
    r"""Undoes \n \r \t \\ and \uXXXX; before any other character the backslash goes; a \u without four hex digits and a backslash at the end are errors."""
    stop = lambda p: F.raise_error(F.concat(F.lit("malformed escape in "), value)).cast("string")  # noqa: E731, ARG005
    parts = F.regexp_extract_all(value, F.lit(r"(\\u[0-9a-fA-F]{4}|\\[\s\S]?|[^\\]+)"), F.lit(1))

    def undo(p: Column) -> Column:
        return (
            F.when(~p.startswith("\\"), p).when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\t", "\t").when((p == "\\") | (p == "\\u"), stop(p))
            .when((F.length(p) == 6) & p.startswith("\\u"), F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE")).otherwise(F.substring(p, 2, 1))
        )

    return F.when(value.contains("\\"), F.array_join(F.transform(parts, undo), "")).otherwise(value)


def read_value_log(spark: SparkSession, path) -> DataFrame:
    """(file, trial_index, parameter_name, value): a line a trial, a tab-separated name=value a parameter; empty lines are no trials but count; a cell without = is an error."""
    cells = numbered_lines(spark, path).filter("value <> ''").select("file", F.col("line_no").alias("trial_index"), F.explode(F.split("value", "\t")).alias("cell"))
    at = F.instr("cell", "=")
    checked = F.when(at == 0, F.raise_error(F.concat(F.lit("no = in "), F.col("cell"))).cast("string")).otherwise(F.expr("substring(cell, instr(cell, '=') + 1)"))
    return cells.select("file", "trial_index", F.expr("substring(cell, 1, instr(cell, '=') - 1)").alias("parameter_name"), unescaped(checked).alias("value"))


def read_phase_log(spark: SparkSession, path, pattern: str, finish: str, timestamp_format: str) -> DataFrame:
    """(file, step, phase, seconds): each line that ``pattern`` matches (1: time, 2: phase) starts a phase, which lasts to the next one; a line that ``finish`` matches (1: time) ends the last.

    A last phase that nothing ends is left out; steps are numbered from 1.
    """
    lines = numbered_lines(spark, path)
    phase, end = matched(F.col("value"), pattern, 2), matched(F.col("value"), finish, 1)
    at = F.to_timestamp(F.coalesce(matched(F.col("value"), pattern, 1), end), timestamp_format)
    events = lines.select("file", "line_no", phase.alias("phase"), at.alias("at")).filter("at is not null")
    w = Window.partitionBy("file").orderBy("line_no")
    spans = events.withColumn("seconds", (F.unix_micros(F.lead("at").over(w)) - F.unix_micros("at")) / 1e6).filter("phase is not null and seconds is not null")
    return spans.select("file", F.row_number().over(w).alias("step"), "phase", "seconds")


def import_outcomes(runs: DataFrame, reports: DataFrame, generalizations: DataFrame) -> DataFrame:
    """(execution_id, generalization_id, diagnostic_kind, message): every generalization of the latest run of its (project_id, variant) with its latest report there.

    Without a report the kind is DIAGNOSTIC_MISSING. NUL characters go from messages. Ids are the order of lateness;
    runs have kind JUNIT or others, which are not read.
    """
    latest = runs.filter("kind = 'JUNIT'").groupBy("project_id", "variant").agg(F.max("execution_id").alias("execution_id"))
    last = reports.groupBy("execution_id", "generalization_id").agg(F.max_by(F.struct("diagnostic_kind", "message"), "report_id").alias("_r"))
    every = generalizations.select(F.col("id").alias("generalization_id"), "project_id", "variant").join(latest, ["project_id", "variant"])
    joined = every.join(last, ["execution_id", "generalization_id"], "left")
    return joined.select("execution_id", "generalization_id", F.coalesce("_r.diagnostic_kind", F.lit("DIAGNOSTIC_MISSING")).alias("diagnostic_kind"), F.regexp_replace("_r.message", r"\x00", "").alias("message"))

