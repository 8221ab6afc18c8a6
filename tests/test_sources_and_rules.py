import pytest
from pyspark.sql import functions as F


def write(tmp_path, name, text):
    path = tmp_path / "project-id-7"
    path.mkdir(exist_ok=True)
    (path / name).write_text(text)
    return f"file://{path / name}"


def test_mutations(spark, tmp_path):
    from assaylake.sources.reports import read_mutations

    path = write(tmp_path, "12-COLLECT_PIT.IMPROVED_10_TRIES.mutations.xml", """<mutations><mutation detected='true' status='KILLED' numberOfTestsRun='2'><sourceFile>A.java</sourceFile><mutatedClass>p.q.A</mutatedClass><mutatedMethod>m</mutatedMethod><methodDescription>()V</methodDescription><lineNumber>4</lineNumber><mutator>X</mutator><indexes><index>9</index><index>3</index></indexes><blocks><block>1</block></blocks><killingTest>p.q.ATest.[engine:e]/[class:p.q.ATest]/[method:t()]</killingTest><description>d</description></mutation>
<mutation detected='false' status='SURVIVED' numberOfTestsRun='0'><sourceFile>A.java</sourceFile><mutatedClass>A</mutatedClass><mutatedMethod>m</mutatedMethod><methodDescription>()V</methodDescription><lineNumber>5</lineNumber><mutator>X</mutator><indexes><index>1</index></indexes><blocks><block>1</block></blocks><killingTest/><description>d</description></mutation></mutations>""")
    a, b = read_mutations(spark, path).orderBy("line_number").collect()
    assert (a.step, a.stage, a.variant, a.project_id) == (12, "COLLECT_PIT", "IMPROVED_10_TRIES", 7)
    assert (a.package_name, a.class_name, a.indexes, a.test_class, a.test_method) == ("p.q", "A", "[3,9]", "p.q.ATest", "t")
    assert (b.package_name, b.class_name, b.killing_test, b.test_class) == (None, "A", None, None)


def test_coverage_and_tests(spark, tmp_path):
    from assaylake.sources.reports import best_reports, read_line_coverage, read_tests

    path = write(tmp_path, "3-COVER.lines.xml", "<coverage><block classname='p.A' method='m(I)V' number='2'><tests><test name='p.ATest.[engine:e]/[class:p.ATest]/[method:t()]'/><test name='odd'/></tests></block><block classname='p.A' method='n()V' number='1'><tests/></block></coverage>")
    got = sorted(((r.covered_class, r.covered_method, r.covered_description, r.covered_block, r.test_class, r.test_method) for r in read_line_coverage(spark, path).collect()), key=str)
    assert got == [("A", "m", "(I)V", 2, "p.ATest", "t"), ("A", "m", "(I)V", 2, None, None)]
    path = write(tmp_path, "4-RUN.tests.xml", "<testsuite><testcase classname='p.T' name='a(1)' time='0.5'/><testcase classname='p.T' name='b' time='0.1'><failure message='m' type='E'>x</failure></testcase><testcase classname='p.T' name='a(2)' time='1'><error message='z' type='F'>x</error></testcase></testsuite>")
    tests = read_tests(spark, path)
    assert {(r.test_name, r.result, r.failure_type) for r in tests.collect()} == {("a(1)", "PASSED", None), ("b", "FAILED", "E"), ("a(2)", "ERROR", "F")}
    assert {(r.method_name, r.result) for r in best_reports(tests, ["class_name", "method_name"]).collect()} == {("a", "ERROR"), ("b", "FAILED")}


def test_csv_and_logs(spark, tmp_path):
    from assaylake.sources import reports

    header = "GROUP,PACKAGE,CLASS,INSTRUCTION_MISSED,INSTRUCTION_COVERED,BRANCH_MISSED,BRANCH_COVERED,LINE_MISSED,LINE_COVERED,COMPLEXITY_MISSED,COMPLEXITY_COVERED,METHOD_MISSED,METHOD_COVERED\n"
    good = write(tmp_path, "5-COVER.jacoco.csv", header + "g,p,\"A,B\",1,2,3,4,5,6,7,8,9,10\n")
    assert [(r["class"], r.method_covered, r.step) for r in reports.read_coverage_csv(spark, good).collect()] == [("A,B", 10, 5)]
    with pytest.raises(Exception):
        reports.read_coverage_csv(spark, write(tmp_path, "6-COVER.jacoco.csv", header + "g,p,A,1,2\n")).collect()
    path = write(tmp_path, "statistics.csv", "x,TARGET_CLASS,criterion,Coverage,Total_Goals,Covered_Goals\n1, p.A ,LINE,0.5,4,2\n")
    assert reports.read_statistics_csv(spark, path).first().asDict() == {"class_name": "p.A", "criterion": "LINE", "coverage": 0.5, "total_goals": 4, "covered_goals": 2}
    with pytest.raises(ValueError):
        reports.read_statistics_csv(spark, write(tmp_path, "bad.csv", "a,b\n1,2\n"))
    ledger = reports.ledger_progress(spark, write(tmp_path, "status.tsv", "n\troot_path\texit_code\n1\ta\t0\n2\tb\t124\n3\tc\t1\n")).first()
    assert tuple(ledger) == (3, 1, 1, 1)
    path = write(tmp_path, "values.tsv", "x=1\ty=a\\tb\\\\n\\u00e9\nx=\ty==\n")
    got = sorted((r.trial_index, r.parameter_name, r.value) for r in reports.read_value_log(spark, path).collect())
    assert got == [(0, "x", "1"), (0, "y", "a\tb\\né"), (1, "x", ""), (1, "y", "=")]
    with pytest.raises(Exception):
        reports.read_value_log(spark, write(tmp_path, "broken.tsv", "x\n")).collect()


def test_rules(spark):
    from assaylake.operators import blockers, rules

    rows = spark.createDataFrame([(1, "int", "a"), (2, None, "a"), (3, "void", None), (4, "Thing", None)], "id long, kind string, name string")
    got = rules.evaluate(rows, "id", [("Missing", rules.missing_values({"name": "NO_NAME"})), ("Type", rules.supported_type("kind", ["int"]))])
    assert {(r.id, r.filter_name): (r.decision, r.reason_code) for r in got.collect()} == {
        (1, "Missing"): ("ACCEPT", None), (1, "Type"): ("ACCEPT", None), (2, "Missing"): ("ACCEPT", None), (2, "Type"): ("DEFER", "TYPE_MISSING"),
        (3, "Missing"): ("REJECT", "NO_NAME"), (3, "Type"): ("REJECT", "VOID"), (4, "Missing"): ("REJECT", "NO_NAME"), (4, "Type"): ("REJECT", "UNSUPPORTED_TYPE"),
    }
    folded = {r.id: (r.excluded, r.code) for r in blockers.verdicts(got, "id", "decision", "reason_code", ["ordinal"]).collect()}
    assert folded == {1: (False, None), 2: (False, None), 3: (True, "NO_NAME"), 4: (True, "NO_NAME")}
    assert rules.rejection_summary(got.withColumn("p", F.lit(1)), ["p"]).filter("n = 2").first().summary == "Missing/NO_NAME x2"


def test_scalars_and_fold(spark):
    from assaylake.functions import scalars as X
    from assaylake.streaming.lifecycle import fold_events

    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(X.variant_order(F.lit("IMPROVED_200_TRIES"))) - value(X.variant_order(F.lit("IMPROVED_10_TRIES"))) == 190
    assert value(X.variant_order(F.lit(None).cast("string"))) == 0
    with pytest.raises(Exception):
        value(X.variant_order(F.lit("OTHER")))
    with pytest.raises(Exception):
        value(X.last_segment(F.lit("/a/b/")))
    assert value(X.excluded_by(F.lit("Excluded by AFilter{x}"))) == "AFilter" and value(X.excluded_by(F.lit("CODE"))) is None
    assert value(X.type_domain(F.lit("java.lang.Integer"))) == "INTEGER" and value(X.type_domain(F.lit("int[]"))) == "ARRAY"
    assert value(X.config_hash(F.lit('{"b":"1","a":"2","out":"x"}'), ("out",))) == value(X.config_hash(F.lit('{"a":"2","b":"1","out":"y"}'), ("out",)))
    events = spark.createDataFrame([(1, 1, "a", True, None), (1, 2, "b", False, "X"), (1, 3, "b", False, None), (1, 4, "c", True, None), (2, 1, "a", True, None), (2, 2, "b", True, None), (2, 3, "c", True, None)], "k long, seq long, stage string, ok boolean, code string")
    got = {r.k: tuple(r)[1:] for r in fold_events(events, "k", ["seq"], ["a", "b", "c"]).collect()}
    assert got == {1: (1, False, "b", "X"), 2: (3, True, None, None)}
