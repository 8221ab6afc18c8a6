"""Effects on the published fixture's shape, ingest edge cases, error paths, and the fold as a stream."""

import pytest
from pyspark.sql import functions as F


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_effects_of_a_generalized_suite(spark):
    """4 tests, 6 assertions, 5 generalizations, 5 mutants in two runs: one test keeps an unrepresented assertion, one kill is no news."""
    from assaylake.operators import coverage as C

    tests = frame(spark, "id long, project_id long, line_count int, is_included boolean", *[(-101 - i, -100, 10 * i + 10, True) for i in range(4)])
    assertions = frame(spark, "id long, test_id long", (-201, -101), (-202, -102), (-203, -102), (-204, -103), (-205, -103), (-206, -104))
    own = [(-301, -101, -201), (-302, -102, -202), (-303, -102, -203), (-304, -103, -204), (-305, -104, -206)]
    generalizations = frame(spark, "id long, test_id long, assertion_id long, line_count int", *[(*g, i + 3) for i, g in enumerate(own)])
    runs = [(t, None, "ORIGINAL", float(i + 1)) for i, t in enumerate((-101, -102, -103, -104))] + [(None, g[0], "IMPROVED_10_TRIES", (i + 1) / 10) for i, g in enumerate(own)]
    junit = frame(spark, "test_id long, generalization_id long, variant string, runtime double", *runs)
    rows = []
    for n in range(1, 6):
        killed = n == 5
        rows.append((-500 - 2 * n, -100, "ORIGINAL", "KILLED" if killed else "SURVIVED", killed, n, -104 if killed else None, None))
        rows.append((-500 - 2 * n - 1, -100, "IMPROVED_10_TRIES", "KILLED", True, n, None, -300 - n))
    reports = frame(spark, "id long, project_id long, variant_name string, status string, is_detected boolean, mutation_id long, killing_test_id long, killing_generalization_id long", *rows)
    changes = C.killing_entities(C.status_changes(reports, ["ORIGINAL", "INITIAL"], "ORIGINAL"), tests, generalizations, junit)
    runtimes = junit.filter("test_id is not null").select("test_id", "variant", "runtime")
    r = C.generalization_effects(changes, generalizations, assertions, tests, runtimes, junit.filter("generalization_id is not null")).first()
    assert (r.project_id, r.a_variant, r.b_variant, r.killed_mutations) == (-100, "ORIGINAL", "IMPROVED_10_TRIES", 4)
    assert (r.tests_before, r.added_tests, r.removed_tests, r.tests_after, r.tests_delta, r.tests_delta_pct) == (4, 4, 2, 6, 2, 50.0)
    assert (r.lines_before, r.added_lines, r.removed_lines, r.lines_after) == (100, 18, 30, 88)
    assert [round(x, 4) for x in (r.runtime_before, r.added_runtime, r.removed_runtime, r.runtime_after)] == [10.0, 1.0, 3.0, 8.0]


def test_empty_blocks_and_null_places(spark):
    """A report without blocks keeps an empty list and gives no location; a place with a null part is never found."""
    from assaylake.operators import coverage as C

    place = "package_name string, class_name string, method_name string, method_description string"
    mutations = frame(spark, f"id long, {place}, blocks string", (1, "p", "A", "m", "()V", "[2,1]"), (2, "p", "A", "m", "()V", "[]"), (3, "p", "A", None, "()V", "[1]"))
    coverage = frame(spark, f"id long, {place}, block int", (9, "p", "A", "m", "()V", 1))
    places = C.locations(coverage, mutations)
    assert places.count() == 3
    at = {(r.method_name, r.block): r.location_id for r in places.collect()}
    listed = {r.id: r.location_ids for r in C.location_lists(mutations, places).collect()}
    assert listed[1] == [at["m", 1], at["m", 2]] and listed[2] == [] and {r.id for r in C.located(C.blocks_of(mutations), places, ["id"]).filter("location_id is null").collect()} == {3}


def test_gain_rejects_duplicates_and_unpaired(spark):
    from assaylake.operators.coverage import gain_totals

    schema = "project_id long, mutant_pairs long, mutants long, unpaired_mutants long, covered_mutants long, generalized_only_kills long"
    good = [(1, 100, 100, 0, 100, 3), (2, 200, 200, 0, 200, 0), (3, 100, 100, 0, 100, 1)]
    assert tuple(gain_totals(frame(spark, schema, *good)).first()) == (3, 400, 4, 2, 1.0)
    for bad in ([*good, good[0]], [(1, 99, 100, 1, 99, 3)]):
        with pytest.raises(Exception):
            gain_totals(frame(spark, schema, *bad)).collect()


def test_engine_paths(spark):
    from assaylake.sources.reports import name_ids, test_identity, unattributed, with_ids

    names = {
        "p.q.ATest.[engine:junit-jupiter]/[class:p.q.ATest]/[method:t()]": ("p.q.ATest", "p.q", "ATest", "t"),
        "p.ATest.[engine:junit-vintage]/[runner:p.ATest]/[test:t(p.ATest)]": ("p.ATest", "p", "ATest", "t"),
        "p.ATest.[engine:junit-vintage]/[runner:p.ATest]": ("p.ATest", "p", "ATest", None),
        "ATest.[engine:e]/[class:ATest]/[test-template:t(int)]/[test-template-invocation:#3]": ("ATest", "", "ATest", "t"),
        " A name_of it.[engine:jqwik]/[class:p.B]/[property:holds(int, int)]": ("p.B", "p", "B", "holds"),
        "p.ATest.t()": (None, None, None, None),
        "p.q.ATest.[engine:e]/[class:p.q.ATest]/[method:t()] and more": (None, None, None, None),
    }
    rows = frame(spark, "name string, project_id long", *[(n, 1) for n in names]).select("name", "project_id", *test_identity(F.col("name")))
    assert {r.name: (r.test_class, r.test_package, r.test_simple_class, r.test_method) for r in rows.collect()} == names
    tests = name_ids(frame(spark, "project_id long, test_qualified_method string, id long", (1, "p.ATest.t", 8), (1, "p.ATest.t", 7), (2, "p.q.ATest.t", 5)), "test_qualified_method", ["project_id"])
    own = name_ids(frame(spark, "project_id long, test_qualified_method string, id long", (1, "p.B.holds", 3)), "test_qualified_method", ["project_id"])
    got = with_ids(rows, tests, own, ["project_id"], ["project_id"])
    assert {(r.test_qualified_method, r.test_id, r.generalization_id) for r in got.filter("test_id is not null or generalization_id is not null").collect()} == {("p.ATest.t", 7, None), ("p.B.holds", None, 3)}
    assert tuple(unattributed(got.withColumn("is_detected", F.lit(True))).first()) == (7, 5)


def test_value_escapes_and_lines_over_splits(spark, tmp_path):
    from assaylake.sources.reports import numbered_lines, read_phase_log, read_value_log

    path = tmp_path / "v.tsv"
    path.write_text("a=x\\qy\tb=\\u00e9\\\\n\n\nc=\\t\\r|\n")
    got = sorted((r.trial_index, r.parameter_name, r.value) for r in read_value_log(spark, f"file://{path}").collect())
    assert got == [(0, "a", "xqy"), (0, "b", "é\\n"), (2, "c", "\t\r|")]
    for bad in ("a=x\\\n", "a=\\uZZ12\n", "a=\\u12\n", "none\n"):
        path.write_text(bad)
        with pytest.raises(Exception):
            read_value_log(spark, f"file://{path}").collect()
    for n in range(2):
        (tmp_path / f"{n}.log").write_text("".join(f"{i} {'x' * (i % 50)}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert numbered_lines(spark, f"file://{tmp_path}/*.log").filter("line_no <> cast(split(value, ' ')[0] as long)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "p.txt").write_text("noise\n[10:00:00] Phase A\nx\n[10:00:02] Phase B\n[10:00:05] FINISHED\n")
    got = [(r.step, r.phase, r.seconds) for r in read_phase_log(spark, f"file://{tmp_path}/p.txt", r"^\[(\S+)\] Phase (\w+)$", r"^\[(\S+)\] FINISHED", "HH:mm:ss").orderBy("step").collect()]
    assert got == [(1, "A", 2.0), (2, "B", 3.0)]


def test_line_kinds_by_force(spark, small):
    """Every document's lines against a plain state machine, and some source lines."""
    from assaylake.sources.tables import line_kinds, source_statistics

    def by_force(text):
        out, open_ = [0, 0, 0], False
        for line in text.split("\n")[: len(text.split("\n")) - text.endswith("\n")] if text else []:
            s = line.strip()
            at = s.find("/*") if "/*" in s else s.find("//")
            if not s:
                out[2] += 1
            elif open_:
                out[1], open_ = out[1] + 1, "*/" not in s
            elif s.startswith("//"):
                out[1] += 1
            elif at >= 0:
                out[0 if s[:at].strip() else 1] += 1
                open_ = "/*" in s and "*/" not in s
            else:
                out[0] += 1
        return tuple(out)

    sources = ["", "\n", "a", "a;\n/* b\n\n c */ d\ne // f\n//g /*\nh /* i */ j\n  k /* l\n m\n*/\nn", "x /* // y\nz */", "// a */\n/** b */\nclass C {} enum D {}\n"]
    texts = sources + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").filter("text is not null").collect() if "\r" not in r.text and not any(ord(c) in (11, 12, 28, 29, 30, 31, 133, 160) for c in r.text)]
    rows = frame(spark, "i int, text string", *enumerate(texts))
    for r in rows.select("i", line_kinds(F.col("text")).alias("k")).collect():
        assert tuple(r.k) == by_force(texts[r.i]), texts[r.i][:200]
    files = frame(spark, "path string, text string", ("/p/A.java", sources[5]), ("/p/_A_Generalized_B.java", "class"), ("/p/_x.java", "a"))
    assert tuple(source_statistics(files.withColumn("p", F.lit(1)), ["p"]).first())[1:] == (2, 2, 2, 2, 0)


def test_names_and_records(spark):
    from assaylake.sources.reports import match_reports, test_records

    expected = frame(spark, "name string", ("p.A.t one",), ("p.A.t_two(a b)",), ("p.A.x",), ("q.BA.x",))
    reports = frame(spark, "reported string", ("A.x",), ("p.A.t two(a b)",), ("(odd)",), ("A.t one",))
    assert {(r.name, r.reported) for r in match_reports(expected, reports, "name", "reported").collect()} == {("p.A.x", "A.x"), ("p.A.t_two(a b)", "p.A.t two(a b)")}
    cases = frame(spark, "path string, class_name string, test_name string, result string, failure_message string", ("b", "p.A", "t(1)", "PASSED", None), ("c", "p.A", "t(2)", "FAILED", "x"), ("a", "p.A$1", "t", "PASSED", None), ("a", "p.A", "1t", "PASSED", None), ("a", "p.A", "u", "ERROR", "No tests found in A"))
    assert [(r.class_name, r.method_name, r.result) for r in test_records(cases, []).collect()] == [("p.A", "t", "FAILED")]


def test_outcomes_of_the_latest_run(spark):
    from assaylake.sources.reports import import_outcomes

    runs = frame(spark, "execution_id long, project_id long, variant string, kind string", (1, 1, "V", "JUNIT"), (2, 1, "V", "JUNIT"), (3, 1, "V", "PIT"))
    reports = frame(spark, "report_id long, execution_id long, generalization_id long, diagnostic_kind string, message string", (1, 1, 5, "OLD", None), (2, 2, 5, "A", "x"), (3, 2, 5, "B", "y\0z"))
    own = frame(spark, "id long, project_id long, variant string", (5, 1, "V"), (6, 1, "V"), (7, 1, "W"))
    assert {tuple(r) for r in import_outcomes(runs, reports, own).collect()} == {(2, 5, "B", "yz"), (2, 6, "DIAGNOSTIC_MISSING", None)}


def test_repositories_and_values(spark, tmp_path):
    from assaylake.sources import tables

    schema = "build_tool string, java_version string, junit_version string, has_src_main string, has_src_test string, repo_size string"
    good = ("Maven ", " 1.8", "4.12", "True", "True", "99999")
    bad = [("Gradle", *good[1:]), (good[0], "1.9", *good[2:]), (good[0], "", *good[2:]), (*good[:2], "3.8", *good[3:]), (*good[:3], "False", *good[4:]), (*good[:5], "100000")]
    assert tables.eligible_repositories(frame(spark, schema, good, (*good[:1], "8.0", "5", *good[3:]), *bad)).count() == 2
    rows = frame(spark, "table_row string, mut_class string, mut_method string, parameter string, value string", ("1", "C", "m", "x", "a\t\"b\"\n"), ("1", "C", "m", "x", "a\t\"b\"\n"), ("2", "C", "m", "x", "z"))
    tables.write_values(rows, f"file://{tmp_path}/values")
    assert {tuple(r) for r in tables.read_values(spark, f"file://{tmp_path}/values").collect()} == {tuple(r) for r in rows.collect()}
    rows.drop("value").write.option("header", True).option("sep", "\t").csv(f"file://{tmp_path}/short")
    with pytest.raises(ValueError):
        tables.read_values(spark, f"file://{tmp_path}/short")


def test_scalars(spark):
    from assaylake.functions import scalars as X
    from assaylake.operators import values as V

    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert [value(X.stage_order(lit(s))) for s in ("CLEANUP_PROJECT", "COLLECT_PIT_DATA_GENERALIZED", None)] == [0, 35, -1]
    with pytest.raises(Exception):
        value(X.stage_order(lit("OTHER")))
    assert value(X.declaring_type(lit("#subPackage[name=a]#subPackage[name=b]#containedType[name=C]#method[signature=m()]"))) == "a.b.C" and value(X.declaring_type(lit("#x"))) is None
    assert [value(X.json_kind(lit(s))) for s in ("[1]", "{}", '"a"', "1.5", "true", "null", "{", None)] == ["array", "object", "string", "number", "boolean", "null", None, None]
    assert value(X.part_of(lit("a/b/c"), "/", -1)) == "c"
    assert value(X.short_combo(lit("p.AFilter+q.BFilter"), {"AFilter": "A"})) == "A+BFilter"
    assert value(X.display_project(lit(" /x/commons "), {"commons": "commons-dev"})) == "commons-dev"
    assert value(F.struct(*X.prefix_and_budget(lit("eq-es-default-10s")))) == ("eq", "10s") and value(X.base_name(lit("eq-es-default-1s"))) == "eq"
    assert value(X.normalized_text(lit("a  \n b\t\n"))) == "a\n b\n"
    assert value(X.matches_like(lit("PATHxCONDITION"), "%PATH_COND%")) and not value(X.in_list(lit(None).cast("string"), ["a"]))
    assert value(X.last_exception(lit("a.b.FirstException: x\nCaused by: c.D$E.LastError y"))) == "c.D$E.LastError" and value(X.last_exception(lit("none"))) is None
    key = lambda p: value(F.struct(*V.tested_method_key(lit("C"), lit("m"), lit(p).cast("string"))))
    assert key('[{"type":"int","name":"a"},{"type":"String"}]') == ("C::m(int,String)", True) and key('[{"name":"a"}]') == ("C::m(?)", False) and key("[]") == ("C::m()", True) and key(None) == ("C::m(?)", False) and key("{}") == ("C::m(?)", False)
    assert [value(V.argument_count(lit(x).cast("string"))) for x in ('[1,1,{"value":2}]', "[]", None)] == [3, 0, 0]
    with pytest.raises(Exception):
        value(V.argument_count(lit('{"a":1}')))
    assert value(V.value_identity(lit("é"))) == "w6k="


def test_rule_columns(spark):
    from assaylake.operators import rules

    one = frame(spark, "a string, b string, types array<string>", (None, None, ["x", "int"]), ("1", None, None), ("1", "2", ["x"]), ("1", "2", []))
    got = one.select(rules.missing_value_codes({"a": "NO_A", "b": "NO_B"}, F.when(F.col("a").isNotNull(), "RESOLVER")).alias("m"), rules.parameter_types(F.col("types"), ["int"]).alias("p")).collect()
    assert [tuple(r.m) for r in got] == [("REJECT", "NO_A", '["NO_A","NO_B"]'), ("REJECT", "RESOLVER", '["NO_B"]'), ("ACCEPT", None, None), ("ACCEPT", None, None)]
    assert [tuple(r.p) for r in got] == [("ACCEPT", None), ("DEFER", "PARAMETERS_MISSING"), ("REJECT", "NO_SUPPORTED_PARAMETER"), ("REJECT", "NO_SUPPORTED_PARAMETER")]
    value = lambda c: spark.range(1).select(c).first()[0]
    assert value(rules.test_type(F.lit("@Test"), ["@Test"]))[0] == "ACCEPT" and value(rules.test_type(F.lit(None).cast("string"), ["@Test"])) == ("REJECT", "NO_TEST_ANNOTATION")
    assert value(rules.unnamed_package(F.lit("")))[0] == "REJECT" and value(rules.unsupported_assertion(F.lit("verify"), ["assertEquals"]))[0] == "REJECT"
    assert [value(rules.semantic_kind(F.lit(n).cast("string"))) for n in ("assertNotSame", "assertThat", None)] == ["SAMENESS", "UNKNOWN", None]


def test_errors_of_checks(spark):
    from assaylake.operators import filter_reports, funnels, populations, quality, ranking

    broken = funnels.funnel_bands(frame(spark, "a boolean, b boolean", (True, True), (False, True)), [("A", F.col("a")), ("B", F.col("b"))])
    assert [r.broken for r in broken.orderBy("position").collect()] == [0, 1]
    cases = [
        lambda: funnels.require_nested(broken),
        lambda: funnels.grouped_causes(frame(spark, "cause string", ("X",)), {"Y": "y"}),
        lambda: quality.require_closed(frame(spark, "c string", ("X",)), "c", ["Y"]),
        lambda: filter_reports.filtering_evidence(frame(spark, "k long, is_included boolean", (1, True)), frame(spark, "k long, decision string", (1, "REJECT")), "k"),
        lambda: filter_reports.filtering_evidence(frame(spark, "k long, is_included boolean", (1, True), (1, True)), frame(spark, "k long, decision string", (2, "REJECT")), "k"),
        lambda: filter_reports.refusals(frame(spark, "code string", ("NEW",)), "code", ["OLD"]),
        lambda: filter_reports.failure_columns(frame(spark, "p long, k string", (1, "NEW")), ["p"], "k", ["OLD"]),
        lambda: populations.one_to_one(frame(spark, "k long", (1,)), frame(spark, "k long, v long", (1, 2), (1, 3)), ["k"]),
        lambda: populations.one_to_one(frame(spark, "k long", (1,)), frame(spark, "k long, v long", (2, 2)), ["k"]),
        lambda: ranking.stratified_sample(frame(spark, "s string, id long", ("a", 1)), ["s"], "id", frame(spark, "s string, wanted int", ("a", 2)), "x"),
        lambda: ranking.stratified_sample(frame(spark, "s string, id long", ("a", 1)), ["s"], "id", frame(spark, "s string, wanted int", ("b", 1)), "x"),
    ]
    for case in cases:
        with pytest.raises(Exception):
            case().collect()
    assert quality.tolerant(frame(spark, "a long", (1,)), ["b"], lambda d: d).first()[0] == "skipped, missing: b"
    facts = lambda *rows: frame(spark, "kind string, name string, value string", *rows)
    got = quality.run_comparability(facts(("tool_version", "x", "1"), ("count", "projects", "5")), facts(("tool_version", "x", "2"), ("count", "projects", "6")))
    assert {(r.name, r.severity) for r in got.collect()} == {("x", "block"), ("projects", "warn")}
    samples = filter_reports.bucket_samples(spark.range(500).select(F.lit("b").alias("b"), F.concat(F.lit("text "), "id").alias("t"), "id"), ["b"], "t", "id").first()
    assert samples.n == 500 and len(set(samples.samples.split(" | "))) == 3
    excluded = populations.excluded_projects(frame(spark, "project_id long, stage string, info string", (1, "X", "Could not find artifact"), (2, "B", "CommandException"), (3, "X", "CommandException"), (4, "X", None)), frame(spark, "project_id long, instruction_covered int, branch_covered int, line_covered int", (5, 0, 0, 0), (5, 0, 0, 0), (6, 0, 1, 0)), ["find artifact"], "B", "CommandException")
    assert {r[0] for r in excluded.collect()} == {1, 2, 5}


def test_pareto_tolerance(spark):
    from assaylake.operators.runtimes import pareto_points

    # a null group is a group of its own
    points = frame(spark, "g string, x double, y double", ("a", 1.0, 1.0), ("a", 1.05, 1.0), ("a", 1.2, 1.0), ("a", 2.0, 0.5), ("a", 3.0, 2.0), ("a", 3.0, 1.9995), ("a", 3.0, 1.9), (None, 5.0, 0.1))
    got = {(r.x, r.y): r.is_pareto_optimal for r in pareto_points(points, ["g"], "x", "y").collect()}
    assert got == {(1.0, 1.0): True, (1.05, 1.0): True, (1.2, 1.0): False, (2.0, 0.5): False, (3.0, 2.0): True, (3.0, 1.9995): True, (3.0, 1.9): False, (5.0, 0.1): True}


def test_fold_fans_out_and_streams(spark, tmp_path):
    """Project events reach every generalization of their variant; the stream gives what the batch gives, batch by batch."""
    from assaylake.streaming.lifecycle import fan_out, fold_events, fold_stream

    schema = "k long, project long, variant string, seq long, stage string, ok boolean, code string"
    events = frame(spark, schema, (1, 1, "V", 1, "a", True, None), (2, 1, "V", 2, "a", True, None), (3, 1, "W", 3, "a", True, None), (None, 1, "V", 4, "b", False, "X"), (1, 1, "V", 5, "b", False, None), (2, 1, "V", 6, "b", True, None), (2, 1, "V", 7, "c", True, None), (3, 1, "W", 8, "c", True, None))
    members = frame(spark, "k long, project long, variant string", (1, 1, "V"), (2, 1, "V"), (3, 1, "W"))
    every = fan_out(events, members, "k", ["project", "variant"])
    stages = ["a", "b", "c"]
    want = {r.k: tuple(r)[1:] for r in fold_events(every, "k", ["seq"], stages).collect()}
    assert want == {1: (1, False, "b", "X"), 2: (3, True, None, None), 3: (1, False, "b", None)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [r.asDict() for r in every.orderBy("seq").collect()]
    source = tmp_path / "in"
    for n, part in enumerate((rows[:5], rows[5:], [rows[0]])):
        spark.createDataFrame(part, every.schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        out = fold_stream(spark.readStream.schema(every.schema).parquet(f"file://{source}"), "k", "seq", stages)
        query = out.writeStream.outputMode("update").format("memory").queryName(f"fold{n}").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, i, n=n: df.write.mode("append").parquet(f"file://{tmp_path}/out{n}")).start()
        query.awaitTermination()
    final = {}
    for n in range(3):
        for r in spark.read.parquet(f"file://{tmp_path}/out{n}").collect():
            final[r.k] = tuple(r)[1:5]
    assert final == want
    late = spark.read.parquet(f"file://{tmp_path}/out2").collect()
    assert [r.late for r in late] == [1]
