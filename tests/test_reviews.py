"""Review chain, rejection breakdowns, and functions that no query binds, on odd rows."""

import json

import pytest
from pyspark.sql import functions as F

from assaylake.operators import filter_reports, marts, populations, quality, reviews, rules, runtimes, values
from assaylake.functions import scalars
from assaylake.sources import reports, tables


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_strata_of_mappings(spark):
    cases = [
        (("NO_VISIBLE_CALL", "RESOLVED", "T4_GUESS", 3), "no-visible-call"), (("UNRESOLVED_SOURCE_DECLARATION", None, None, None), "unresolved-source-declaration"), ((None, "RESOLVED", "T3_SINGLE_WEAK", 1), "t3-single-weak"), ((None, "RESOLVED", "T4_GUESS", None), "t4-guess"),
        ((None, "RESOLVED", "T1_PROVEN", 2), "ambiguous-high-confidence"), ((None, "RESOLVED", "T2_CORROBORATED", 1), None), ((None, "UNRESOLVED", "T4_GUESS", 2), None), ((None, None, None, None), None), (("OTHER", "RESOLVED", "T1_PROVEN", None), None),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, no_pick_reason string, resolution_status string, confidence_tier string, candidate_count int")
    assert {r.i: r.s for r in df.select("i", reviews.mapping_stratum().alias("s")).collect()} == {i: s for i, (_, s) in enumerate(cases)}


def test_rule_sample(spark):
    """Exact sizes, the same on any partitions; too small a stratum and one without an allocation are errors."""
    rows = spark.range(3000).selectExpr("id", "case when id % 10 = 0 then 'small' when id % 10 < 8 then 'large' end as s")
    one = rows_of(reviews.rule_sample(rows, "s", ["id"], {"small": 7, "large": 40}, "seed"))
    assert one == rows_of(reviews.rule_sample(rows.repartition(13), "s", ["id"], {"small": 7, "large": 40}, "seed")) and len(one) == 47
    assert {r[0]: r[3] for r in one} == {"small": 300, "large": 2100}
    assert one != rows_of(reviews.rule_sample(rows, "s", ["id"], {"small": 7, "large": 40}, "other"))
    with pytest.raises(ValueError, match="stratum small has 300 rows; review requires 301"):
        reviews.rule_sample(rows, "s", ["id"], {"small": 301, "large": 1}, "seed")
    with pytest.raises(ValueError, match="no allocation for small"):
        reviews.rule_sample(rows, "s", ["id"], {"large": 1, "none": 0}, "seed")


DECISIONS = "id long, reviewer string, label string, rationale string, confidence string, source_ids array<string>"
STATUSES = {"yes": "resolved", "no": "resolved", "odd": "incompatible"}


def test_adjudication(spark):
    population = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    decisions = spark.createDataFrame([(1, "a", "yes", "why", "T2_CORROBORATED", ["x", "w"]), (2, "a", "yes", "p", "T1_PROVEN", ["x"]), (2, "b", "yes", "q", "T4_GUESS", ["y", "x"]), (3, "a", "yes", "p", "T1_PROVEN", []), (3, "b", "no", "q", "T1_PROVEN", ["z"]), (5, "c", "odd", "r", "NONE", [])], DECISIONS)
    assert not reviews.decision_issues(population, decisions, ["id"], STATUSES).count()
    got = {r.id: tuple(r)[1:] for r in reviews.adjudicated(population, decisions, ["id"], STATUSES).collect()}
    assert got == {
        1: ("resolved", "yes", "T2_CORROBORATED", "why", ["w", "x"], 1, "single-reviewed"), 2: ("resolved", "yes", "T4_GUESS", "Reviewer decisions agree.", ["x", "y"], 2, "agreed"),
        3: ("unresolved", "unresolved", "NONE", "Reviewer decisions disagree; individual decisions are preserved.", ["z"], 2, "disputed"), 4: ("unresolved", "unresolved", "NONE", "No reviewer decision is available.", [], 0, "unreviewed"),
        5: ("incompatible", "odd", "NONE", "r", [], 1, "single-reviewed"),
    }
    bad = spark.createDataFrame([(1, "", "yes", "w", "NONE", []), (1, "b", "new", "w", "NONE", []), (1, "c", "yes", None, "NONE", []), (1, "d", "yes", "w", "T9", []), (1, "e", "odd", "w", "T1_PROVEN", []), (1, "f", "yes", "w", "NONE", ["x", "x"]), (1, "g", "yes", "w", "NONE", [""]), (1, "h", "yes", "w", "NONE", None), (9, "i", "yes", "w", "NONE", []), (2, "j", "yes", "w", "NONE", []), (2, "j", "no", "w", "NONE", [])], DECISIONS)
    twice = population.union(population.filter("id = 5"))
    assert rows_of(reviews.decision_issues(twice, bad, ["id"], STATUSES)) == sorted([
        ("no reviewer", "1:"), ("unknown label", "1:b"), ("no rationale", "1:c"), ("unknown confidence", "1:d"), ("confidence without resolution", "1:e"), ("invalid source ids", "1:f"), ("invalid source ids", "1:g"), ("invalid source ids", "1:h"),
        ("decision outside the population", "9:i"), ("duplicate reviewer decision", "2:j"), ("repeated identity", "5"),
    ], key=str)


def test_audit_documents(spark, tmp_path):
    entity = lambda c, s, x: {"claim": c, "status": s, "label": x, "more": [1]}
    (tmp_path / "a.json").write_text(json.dumps({"entities": [entity("m", "resolved", "yes")] * 3 + [entity("m", "unresolved", "no")]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"entities": []}))
    assert rows_of(reviews.outcome_counts(reviews.read_audit(spark, str(tmp_path)))) == [("m", "resolved", "yes", 3), ("m", "unresolved", "no", 1)]
    (tmp_path / "c.json").write_text(json.dumps({"other": 1}))
    with pytest.raises(Exception, match="audit without a list"):
        reviews.read_audit(spark, str(tmp_path)).collect()


def test_rejection_breakdowns(spark):
    rejected = spark.createDataFrame([(1, "x.ReturnTypeFilter", "A"), (1, "x.ReturnTypeFilter", "A"), (2, "x.ReturnTypeFilter", None), (3, "x.ReturnTypeFilter", "B"), (4, "x.ReturnTypeFilter", "B"), (5, "x.Other", "A"), *[(i, "x.ParameterTypeFilter", None) for i in range(10, 20)]], "entity_id long, filter_name string, reason_code string")
    assert rows_of(filter_reports.rejections_by(rejected, "ReturnTypeFilter", F.col("reason_code"), "entity_id")) == [("<missing>", 1, 4), ("A", 1, 4), ("B", 2, 4)]
    assert rows_of(filter_reports.rejections_by(rejected, "ReturnTypeFilter", F.col("reason_code"), "entity_id", 2)) == [("<missing>", 1, 4), ("B", 2, 4)]
    assert rows_of(filter_reports.rejections_by(rejected, "NoFilter", F.col("reason_code"), "entity_id")) == []
    seen = [(10, 1, False, '["a"]'), (11, 0, False, "[]"), (12, None, None, None), (13, 1, True, '["int"]'), (14, 2, True, '["int"]'), (15, 0, True, "[]"), (16, None, True, "[]"), (17, -1, True, "[]"), (18, 1, True, "{}"), (18, 1, True, "{}"), (99, 1, True, "[1]")]
    observations = spark.createDataFrame(seen, "assertion_id long, candidate_param_count int, candidate_param_supported boolean, resolved_parameter_types string")
    assert rows_of(filter_reports.parameter_rejections(rejected, observations)) == [("derivation_gap", 1, 10, 6), ("missing_declaration", 1, 10, 6), ("unsupported_types", 1, 10, 6), ("zero_parameters", 1, 10, 6)]


def test_unbound_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    text = lambda x: F.lit(x).cast("string")
    assert [one(scalars.simple_name(text(x))) for x in ("a.b.C", "C", "", "a.", None)] == ["C", "C", "", "", None]
    assert [one(scalars.compared_variant(text(x))) for x in ("BASELINE", "NAIVE_10_TRIES", "IMPROVED_5_TRIES", "NAIVE", "ORIGINAL", None)] == [True, True, True, False, False, False]
    assert [one(scalars.stage_order(text(x))) for x in ("CLEANUP_PROJECT", "COLLECT_PIT_DATA_GENERALIZED", None)] == [0, 35, -1]


def test_suffix_join(spark):
    paths = spark.createDataFrame([("/data/a/b",), ("/data/b",), ("/x/cb",), ("b/",), (None,)], "path string")
    names = spark.createDataFrame([("b", 1), ("a/b", 2), ("cb", 3), (None, 4)], "name string, v int")
    assert rows_of(populations.suffix_join(paths, names, "path", "name").select("path", "v")) == [("/data/a/b", 1), ("/data/a/b", 2), ("/data/b", 1), ("/data/b", 2), ("/x/cb", 3), ("b/", 1)]


def test_exports_and_candidates(spark, tmp_path):
    tables.export_sections({"one": spark.createDataFrame([("a,b", 1), ('q"', None)], "x string, y int"), "two": spark.range(0).toDF("z")}, str(tmp_path))
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/one")
    assert {r.x for r in back.collect()} == {"a,b", 'q"'} and tables.read_candidates(spark, f"{tmp_path}/one").columns == ["x", "y"]
    assert set(tables.snapshot(spark, "/root/testdata/sf0.001/", ["nation", "region"])) == {"nation", "region"}
    rows = spark.createDataFrame([("Java", "5", "0.5"), ("Java", "50", "0.5"), ("C", "5", "0.5"), ("Java", "5", None)], "language string, size string, share string")
    assert tables.prefiltered_repositories(rows, "Java", (1, 10), {"share": (0.1, 0.9)}).count() == 1


def test_pivot_refuses_too_many_columns(spark, monkeypatch):
    phases = spark.range(6).selectExpr("id % 2 as k", "concat('p', id) as phase", "cast(id as int) as step", "id as runtime")
    assert runtimes.phase_pivot(phases, ["k"], "phase", "step", "runtime").columns == ["k", *[f"p{i}" for i in range(6)], "total"]
    monkeypatch.setattr(runtimes, "MOST_COLUMNS", 5)
    with pytest.raises(ValueError, match="more than 5 phases"):
        runtimes.phase_pivot(phases, ["k"], "phase", "step", "runtime")
    assert runtimes.phase_pivot(phases, ["k"], "phase", "step", "runtime", ["p1"]).columns == ["k", "p1", "total"]


def test_unused_imports_are_functions():
    """The modules that queries bind stay importable on their own."""
    assert all(m.__doc__ for m in (filter_reports, marts, populations, quality, reviews, rules, runtimes, values, reports, tables))
