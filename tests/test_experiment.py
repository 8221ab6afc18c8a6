"""The chain of marts, snapshots, ordered digests, the rerun sink, unions by bitmaps and the generalization funnel."""

import collections
import hashlib
import os
import random
import re
import statistics

import pytest
from comparing import canonical
from pyspark.sql import functions as F

from assaylake.functions import scalars
from assaylake import scratch
from assaylake.operators import bitmaps, coverage, digests, filter_reports, funnels, ranking
from assaylake.plans import experiment
from assaylake.sources import rerun, snapshot


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_marts_read_each_given_table_once(spark, small, monkeypatch):
    """Every mart that is written, and every query's own plan, reads a given table at most once; keyed joins need no exchange."""
    plans = {}
    for name in ("bucketed", "saved"):
        write = getattr(experiment, name)
        monkeypatch.setattr(experiment, name, lambda df, *keys, write=write: plans.__setitem__(len(plans), plan_of(df)) or write(df, *keys))
    e = experiment.Experiment(snapshot.Snapshot(spark, small, experiment.TABLES))
    last = {n: plan_of(getattr(e, n)) for n in ("extension", "effects", "covering_tests", "signals", "gen_runs", "changes")}
    assert len(plans) >= 12
    for plan in [*plans.values(), *last.values()]:
        scans = collections.Counter(re.findall(r"Scan parquet.*?/(orders|lineitem|events|nation|documents)\.parquet", plan))
        assert not scans or max(scans.values()) == 1
    by_test = e.assertions.join(e.test_ext.filter("variant = 'ORIGINAL'"), "test_id").groupBy("test_id").agg(F.count("*"))
    by_mutant = e.mutations.alias("a").join(e.mutations.alias("b"), "mutation_id").filter("a.id < b.id")
    for joined in (by_test, by_mutant):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert "Exchange" not in plan_of(joined.select(F.lit(1))).replace("ReusedExchange", "")
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_files_of_many_rows_are_not_broadcast(spark, small):
    """A million sorted ids are a small file, and far more in the driver's hash table."""
    experiment.Experiment.of(spark, small)
    ids = scratch.bucketed(spark.range(1_000_000).select("id", (F.col("id") % 7).alias("n")), "id")
    many = scratch.bucketed(spark.range(1_000_000).select("id", (F.col("id") % 5).alias("m"), F.rand(1).alias("x")), "id")
    assert "BroadcastHashJoin" not in plan_of(many.join(ids, "id"))
    few = spark.read.parquet(f"{small}/nation.parquet")
    assert "BroadcastHashJoin" in plan_of(many.join(few, many.m == few.n_nationkey))


def test_marts_have_buckets_by_the_size_of_the_input(spark, small, monkeypatch):
    """A bucket holds about as many rows at any size, all marts have the same number, and readers that join nothing leave generalizations unwritten."""
    monkeypatch.setattr(experiment, "BUCKET", 10_000)
    e = experiment.Experiment(snapshot.Snapshot(spark, small, experiment.TABLES))
    given = sum(os.path.getsize(f"{small}/{n}.parquet") for n in ("orders", "lineitem"))
    assert e.buckets == -(-given // 10_000) > 8
    for mart in (e.tests, e.lines):
        files = {re.search(r"_(\d{5})\.", f)[1] for f in mart.inputFiles()}
        assert 8 < len(files) <= e.buckets
    assert rows_of(e.generated) and "generalizations" not in e.written
    assert {r.entity_id for r in e.decisions.filter("level = 'generalization'").collect()} == {r.id for r in e.generated.collect()}
    assert "generalizations" not in e.written
    assert rows_of(e.generated) == rows_of(e.generalizations)


def test_mutants_need_no_coverage_rows(spark, small, tmp_path, duck):
    """Mutations are drawn from places: no mart of coverage or generalizations is written for them, and places with null parts have no killers, as in the SQL."""
    for n in experiment.TABLES:
        rows = spark.read.parquet(f"{small}/{n}.parquet")
        if n == "lineitem":
            rows = rows.withColumn("l_partkey", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_partkey"))).withColumn("l_suppkey", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_suppkey")))
        rows.coalesce(1).write.parquet(f"{tmp_path}/{n}.parquet")
    e = experiment.Experiment(snapshot.Snapshot(spark, str(tmp_path), experiment.TABLES))
    names = ["id", "project_id", "variant_name", "variant", *coverage.PLACE, "mutator", "blocks", "status", "killing_test_id", "killing_generalization_id", "is_detected"]
    got = e.mutations.select(*names).toPandas()
    assert {"coverage", "covered", "generalizations"}.isdisjoint(e.written)
    sql = experiment.chained(f"SELECT {', '.join(names)} FROM reports")
    for n in ("orders", "lineitem"):
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 '{tmp_path}/{n}.parquet/*.parquet'", sql)
    assert len(got) and got.class_name.isna().any() and canonical(got) == canonical(duck(sql))
    assert e.signals.count() and {"coverage", "covered", "generalizations"}.isdisjoint(e.written)
    assert e.coverage.count() and "generalizations" not in e.written


def test_decisions_are_counted_by_one_row_an_entity(spark):
    """Nulls, repeated entities and different decisions on one; no row is multiplied before the shuffle."""
    rows = [("a", 1, "ACCEPT"), ("a", 1, "ACCEPT"), ("a", 1, "REJECT"), ("a", 2, "DEFER"), ("a", None, "REJECT"), ("a", 3, None), ("b", None, "ACCEPT")]
    counts = filter_reports.decision_counts(spark.createDataFrame(rows, "k string, id long, decision string"), ["k"], "id")
    assert rows_of(counts) == [("a", 1, 1, 1, 3), ("b", 0, 0, 0, 0)]
    assert "Expand" not in plan_of(counts)


def test_decisions_are_dealt_before_they_are_united(spark):
    """Many entities with one decision each: none is aggregated where it is read, and a task holds its share."""
    rows = spark.range(8000).selectExpr("concat('a', id % 1) as k", "id", "'ACCEPT' as decision")
    counts = filter_reports.decision_counts(rows, ["k"], "id", 16)
    assert rows_of(counts) == [("a0", 8000, 0, 0, 8000)]
    assert re.search(r"hashpartitioning\(k#\d+, id#\d+L, 16\), REPARTITION_BY_NUM", plan_of(counts)) and not re.search(r"hashpartitioning\(k#\d+, id#\d+L?, \d+\), ENSURE", plan_of(counts))


def test_experiment_follows_its_files(spark, small, tmp_path):
    """The same files give the same experiment; a changed one gives a new one."""
    for n in experiment.TABLES:
        spark.read.parquet(f"{small}/{n}.parquet").limit(50).coalesce(1).write.parquet(f"{tmp_path}/{n}.parquet")
    one = experiment.Experiment.of(spark, str(tmp_path))
    assert experiment.Experiment.of(spark, str(tmp_path)) is one
    spark.read.parquet(f"{small}/nation.parquet").limit(1).write.mode("append").parquet(f"{tmp_path}/nation.parquet")
    other = experiment.Experiment.of(spark, str(tmp_path))
    assert other is not one and other.projects.count() == one.projects.count() + 1


def test_snapshot_is_pinned(spark, tmp_path):
    """A writer between two reads changes nothing for frames of the snapshot; a listed file that goes is named."""
    root = str(tmp_path)
    spark.range(10).selectExpr("id", "id % 2 as side").write.partitionBy("side").parquet(f"{root}/a.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{root}/b.parquet")
    pinned = snapshot.Snapshot(spark, root, ["a", "b"])
    assert (pinned.table("a").count(), pinned.table("b").count()) == (10, 5) and set(pinned.table("a").columns) == {"id", "side"}
    spark.range(100, 200).selectExpr("id", "id % 2 as side").write.mode("append").partitionBy("side").parquet(f"{root}/a.parquet")
    assert pinned.table("a").join(pinned.table("b"), "id", "left").count() == 10 and pinned.changed() == [] and pinned.checked() is pinned
    later = snapshot.Snapshot(spark, root, ["a", "b"])
    assert later.table("a").count() == 110 and later.id != pinned.id and snapshot.Snapshot(spark, root, ["a", "b"]).id == later.id
    gone = pinned.files["b"][0][0].removeprefix("file:")
    os.remove(gone)
    assert [x.removeprefix("file:") for x in pinned.changed()] == [gone]
    with pytest.raises(ValueError, match="1 files"):
        pinned.checked()


def test_missing_artefacts_and_outcomes(spark, tmp_path):
    root = str(tmp_path)
    for name, text in {"a/outcome.json": '{"diagnosticKind":"TOO_MANY_FILTER_MISSES","message":"m\\u0000n"}', "b/outcome.json": "{not json", "c/outcome.json": "", "d/outcome.json": '{"message":"x"}', "e/outcome.json": "[1]"}.items():
        os.makedirs(f"{root}/{name[0]}")
        open(f"{root}/{name}", "w").write(text)
    expected = spark.createDataFrame([(x, f"{root}/{x}/outcome.json") for x in "abcdef"], "k string, path string")
    listed = snapshot.file_listing(spark, root, suffix=".json")
    assert {(r.k, r.problem) for r in snapshot.missing_artefacts(expected, listed).collect()} == {("a", None), ("b", None), ("c", "MISSING"), ("d", None), ("e", None), ("f", "MISSING")}
    got = {r.k: (r.diagnostic_kind, r.message) for r in snapshot.read_outcomes(spark, expected, root).collect()}
    assert got == {"a": ("TOO_MANY_FILTER_MISSES", "mn"), **{x: ("DIAGNOSTIC_UNREADABLE", None) for x in "be"}, "c": ("DIAGNOSTIC_MISSING", None), "d": ("DIAGNOSTIC_UNREADABLE", "x"), "f": ("DIAGNOSTIC_MISSING", None)}
    assert "content" not in listed.columns and not listed.filter("length is null").count()


def tree(lines, fan):
    level = list(lines)
    while True:
        level = [hashlib.sha256("\n".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_ordered_digest(spark, fan):
    """Equal to a plain tree, whatever the partitions; a null group is a group; a group may hold nearly all rows."""
    rows = [("hot", f"p{i:04}", i) for i in range(300)] + [(None, "z", 1), (None, "a", 2), ("one", "é\n", 3)]
    random.Random(1).shuffle(rows)
    want = sorted(((g, len(own), tree([f"{p}:{v}" for p, v in own], fan)) for g in {r[0] for r in rows} for own in [sorted(r[1:] for r in rows if r[0] == g)]), key=str)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, p string, v int").repartition(parts)
        assert rows_of(digests.ordered_digest(df, ["g"], ["p"], F.concat_ws(":", "p", "v"), fan=fan)) == want


def test_digest_refuses_repeats(spark):
    df = spark.range(0, 1000).selectExpr("id", "id % 3 as g")
    n, whole = ranking.population_digest(df, ["id", "g"]).first()
    assert n == 1000 and whole == tree([f'["{i}","{i % 3}"]' for i in range(1000)], 256)
    assert ranking.population_digest(df.filter("id < 0"), ["id"]).first() == (0, hashlib.sha256(b"").hexdigest())
    for at in (0, 255, 256, 700):  # inside a leaf, and across two
        with pytest.raises(ValueError, match="repeated identity"):
            ranking.population_digest(df.union(df.filter(F.col("id") == at)), ["id"])
    assert ranking.population_digest(df.filter("id <> 5"), ["id", "g"]).first().sha256 != whole


def test_rerun_replaces_its_scope(spark, tmp_path):
    path, keys = f"{tmp_path}/out", ["project", "stage"]
    frame = lambda rows: spark.createDataFrame(rows, "project long, stage string, v int")
    read = lambda: rows_of(spark.read.schema("v int, project long, stage string").parquet(path).select("project", "stage", "v"))
    rerun.replace_scope(frame([(1, "A", 1), (1, "B/x", 2), (2, "A", 3), (2, None, 4)]), path, keys, [(1, "A"), (1, "B/x"), (2, "A"), (2, None)])
    assert read() == [(1, "A", 1), (1, "B/x", 2), (2, "A", 3), (2, None, 4)]
    rerun.replace_scope(frame([(1, "A", 9), (1, "A", 8)]), path, keys, [(1, "A"), (1, "B/x")])  # B/x has no rows now
    assert read() == [(1, "A", 8), (1, "A", 9), (2, "A", 3), (2, None, 4)]
    rerun.replace_scope(frame([]), path, keys, [(2, None)])
    assert read() == [(1, "A", 8), (1, "A", 9), (2, "A", 3)]
    with pytest.raises(Exception, match="outside the scope"):
        rerun.replace_scope(frame([(1, "A", 0), (7, "A", 0)]), path, keys, [(1, "A")])
    broken = frame([(1, "A", 0)]).withColumn("v", F.raise_error(F.lit("broken write")).cast("int"))
    with pytest.raises(Exception, match="broken write"):
        rerun.replace_scope(broken, path, keys, [(1, "A")])
    assert read() == [(1, "A", 8), (1, "A", 9), (2, "A", 3)]


def test_rerun_ends_an_interrupted_swap(spark, tmp_path, monkeypatch):
    path, keys = f"{tmp_path}/out", ["project"]
    frame = lambda rows: spark.createDataFrame(rows, "project long, v int")
    read = lambda: rows_of(spark.read.parquet(path).select("project", "v"))
    rerun.replace_scope(frame([(1, 1), (2, 2), (3, 3)]), path, keys, [(1,), (2,), (3,)])
    monkeypatch.setattr(rerun, "_swap", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        rerun.replace_scope(frame([(1, 10), (2, 20)]), path, keys, [(1,), (2,), (3,)])
    monkeypatch.undo()
    assert read() == [(1, 1), (2, 2), (3, 3)]
    staged = next(x for x in os.listdir(path) if x.startswith("_staged-"))
    os.rename(f"{path}/project=1", f"{tmp_path}/old")  # one partition was moved before the loss
    os.rename(f"{path}/{staged}/project=1", f"{path}/project=1")
    rerun.finish_swaps(spark, path)
    assert read() == [(1, 10), (2, 20)] and not [x for x in os.listdir(path) if x.startswith("_staged-")]


def test_unions_by_bitmaps(spark):
    """Counts and weighted sums of unions, against sets; ids may be negative or far apart."""
    rng = random.Random(4)
    ids = [rng.choice([-70, -1, 0, 5, 63, 64, 1 << 40]) + rng.randrange(300) for _ in range(200)]
    entities = {i: (rng.random() < 0.5 if rng.random() < 0.9 else None, rng.choice([0, 1, 7, 1000, 1 << 33, None])) for i in ids}
    places = {p: rng.choices(ids, k=rng.randint(0, 60)) for p in range(20)}
    unions = {k: rng.sample(range(20), 3) for k in range(15)}
    index = bitmaps.bit_index(spark.createDataFrame([(i, *x) for i, x in entities.items()], "e long, f boolean, w long"), "e", {"present": F.lit(True), "flagged": F.col("f")}, {"sum": F.col("w"), "none": F.lit(None)})
    covered = bitmaps.masks(spark.createDataFrame([(p, e) for p, es in places.items() for e in [*es, None]], "p int, e long"), ["p"], "e")
    words = spark.createDataFrame([(k, p) for k, ps in unions.items() for p in ps], "k int, p int").join(covered, "p").select("k", "word", "mask")
    got = {r.k: (r.present, r.flagged, r.sum, r.none) for r in bitmaps.union_sums(words, ["k"], index).collect()}
    for k, ps in unions.items():
        es = {e for p in ps for e in places[p]}
        assert got.get(k, (0, 0, 0, 0)) == (len(es), sum(bool(entities[e][0]) for e in es), sum(entities[e][1] or 0 for e in es), 0)
    with pytest.raises(ValueError, match="not negative"):
        bitmaps.bit_index(spark.createDataFrame([(1, -1)], "e long, w long"), "e", {}, {"w": F.col("w")})


def test_locations_and_lists_leave_coverage_unwritten(spark, small, duck):
    """Locations come from places, also those where only generalizations are, and a mutant's reports share one list."""
    e = experiment.Experiment(snapshot.Snapshot(spark, small, experiment.TABLES))
    got = experiment.enriched_mutations(e)
    assert canonical(got.toPandas()) == canonical(duck(experiment.SQL["enriched_mutations"]))
    assert {"coverage", "covered", "generalizations"}.isdisjoint(e.written)
    assert rows_of(e.locations) == rows_of(coverage.locations(e.coverage, e.mutations).select(*e.locations.columns))


def test_detection_comparison_asks_its_runs_alone(spark, small, duck):
    """Only the reports of the two compared runs meet coverage; the covering marts of all runs are not written for it."""
    e = experiment.Experiment(snapshot.Snapshot(spark, small, experiment.TABLES))
    got = experiment.mutation_detection_comparison(e)
    assert canonical(got.toPandas()) == canonical(duck(experiment.SQL["mutation_detection_comparison"]))
    assert {"covering_tests", "covering_generalizations"}.isdisjoint(e.written)


def test_view_checks_make_no_pairs(spark, small, duck):
    e = experiment.Experiment(snapshot.Snapshot(spark, small, experiment.TABLES))
    got = experiment.view_checks(e)
    assert canonical(got.toPandas()) == canonical(duck(experiment.SQL["view_checks"])) and "pairs" not in e.written
    assert rows_of(coverage.covered_reports(e.in_runs, e.coverage).distinct()) == rows_of(e.pairs.select("mutation_id").distinct())


def test_changes_without_killers_are_dealt_to_many_tasks(spark):
    """Most status changes have no killing entity: they meet nothing, not even an entity whose id is their hash, and lie in no single task."""
    keyless = spark.range(4000).selectExpr("id as a_id", "id + 5000 as b_id", "cast(null as long) as killing_generalization_id", "cast(null as long) as killing_test_id")
    keyed = spark.createDataFrame([(-1, 1, 10, None), (-1, 2, 11, 3), (-1, 3, None, 3), (-1, 4, 99, 98)], keyless.schema)
    hashed = keyless.filter("a_id = 7").select(F.xxhash64("a_id", "b_id")).first()[0]
    g = spark.createDataFrame([(10, 1, 100, 5), (11, 2, 200, 6), (hashed, 2, 300, 7)], "id long, test_id long, assertion_id long, line_count long")
    runs = spark.createDataFrame([(10, 50), (10, 60), (11, 70), (hashed, 80), (hashed, 90), (None, 1)], "generalization_id long, runtime long")
    tests = spark.createDataFrame([(1,), (3,), (hashed,)], "id long")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        out = coverage.killing_entities(keyless.union(keyed), tests, g, runs)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        names = ["b_id", "killing_test_id", "killing_generalization_id", "killing_assertion_id", "killing_line_count", "killing_runtime"]
        assert sum(sizes) == 4005 and max(sizes) < 1000
        assert rows_of(out.filter("a_id < 0").select(*names)) == [(1, 1, 10, 100, 5, 50), (1, 1, 10, 100, 5, 60), (2, 2, 11, 200, 6, 70), (3, 3, None, None, None, None), (4, None, 99, None, None, None)]
        assert out.filter("a_id >= 0 and coalesce(killing_test_id, killing_generalization_id, killing_assertion_id, killing_line_count, killing_runtime) is not null").count() == 0
    finally:
        for k in off:
            spark.conf.unset(k)


def test_detection_comparison_is_the_product(spark):
    rng = random.Random(6)
    mutants = [(i, "p" if i % 3 else "q", i % 2 == 0) for i in range(12)] + [(99, "r", True)]
    rel = lambda n: [(rng.randrange(12), rng.choice([None, 1, 2, 5, 9])) for _ in range(n)]
    a, b, c = rel(30), rel(8), rel(17)
    frame = lambda rows, v: spark.createDataFrame(rows, f"mutation_id long, {v} long")
    got = coverage.detection_comparison(spark.createDataFrame(mutants, "id long, p string, d boolean"), ["p", "d"], [(frame(a, "x"), ["x"]), (frame(b, "y"), ["y"]), (frame(c, "z"), ["z"])])
    product = collections.defaultdict(list)
    for i, p, d in mutants:
        own = [[v for m, v in rows if m == i] or [None] for rows in (a, b, c)]
        product[p, d] += [(x, y, z) for x in own[0] for y in own[1] for z in own[2]]
    for r in got.collect():
        assert r["count"] == sum((p, d) == (r.p, r.d) for _, p, d in mutants)
        for k, v in enumerate("xyz"):
            values = [t[k] for t in product[r.p, r.d] if t[k] is not None]
            assert r[f"avg_{v}"] == (pytest.approx(sum(values) / len(values)) if values else None)
            assert r[f"median_{v}"] == (statistics.median(values) if values else None)


def test_variant_orders(spark):
    value = lambda x: spark.range(1).select(scalars.variant_order(F.lit(x))).first()[0]
    assert [value(x) for x in ("ORIGINAL", "INITIAL", "BASELINE", "NAIVE_10_TRIES", "IMPROVED_200_TRIES", "IMPROVED")] == [10_000_000, 20_000_000, 30_000_000, 40_000_010, 60_000_200, 60_000_000]
    assert spark.range(1).select(scalars.variant_order(F.lit(None).cast("string"))).first()[0] == 0
    for odd in ("ORIGINAL_X", "NAIVE_X", "NAIVE_TRIES", "OTHER_5_TRIES", ""):
        with pytest.raises(Exception, match="unknown variant"):
            value(odd)


def test_generalization_funnel(spark):
    names = ["generated_source_created", "generated_project_compiled", "generated_tests_executed", "generated_report_collected", "generated_filter_passed", "generated_pit_collected", "final_usable"]
    life = {1: [1] * 7 + [None], 2: [1] * 6 + [0, "RESTORE_GENERALIZED_BUILD"], 3: [1] * 5 + [0, 0, "COLLECT_PIT_DATA_GENERALIZED"], 4: [1, 0, 1, 1, 1, 0, 0, "BUILD_PROJECT_GENERALIZED"], 5: [1] + [0] * 6 + ["FILTER_GENERALIZATIONS"], 6: [0] * 7 + ["GENERALIZE_TESTS"], 7: [1, None, None, None, None, None, None, "EXECUTE_TESTS_GENERALIZED"]}
    g = spark.createDataFrame([(i, 1 + i % 2, "V") for i in range(1, 9)] + [(20, 1, "W"), (21, 9, "V")], "id long, project_id long, variant string")
    lifecycle = spark.createDataFrame([(i, *[None if x is None else bool(x) for x in v[:-1]], v[-1]) for i, v in life.items()], "generalization_id long, " + ", ".join(f"{n} boolean" for n in names) + ", final_failure_stage string")
    results = spark.createDataFrame([(1, i, "a.filter.NonPassingFilter") for i in (1, 2, 3, 4, 5)] + [(1, 7, "a.filter.Odd"), (1, None, "a.filter.XFilter")], "project_id long, generalization_id long, filter_name string")
    tasks = spark.createDataFrame([(2, "COLLECT_PIT_DATA_GENERALIZED", "V"), (2, "EXECUTE_TESTS_GENERALIZED", "W"), (1, "RESTORE_GENERALIZED_BUILD", None), (2, "EXECUTE_TESTS_GENERALIZED", None)], "project_id long, stage string, variant string")
    rows = funnels.generalization_lifecycle(g, lifecycle, results, tasks, spark.createDataFrame([(1,), (2,), (2,)], "project_id long"), "V")
    seen = {r.generalization_id: r for r in rows.collect()}
    assert set(seen) == set(range(1, 9)) and seen[8].attempted and not seen[8].emitted and seen[8].failure_attempt_observed is None
    assert [seen[i].failure_attempt_observed for i in (1, 2, 3, 4, 6, 7)] == [None, True, True, False, False, True]
    assert {r.generalization_id: r.gate for r in funnels.first_failing_gate(rows).collect()} == {1: None, 2: "final_usable", 3: "reduced", 4: "validated", 5: "filter_passed", 6: "emitted", 7: "filter_result_recorded", 8: "emitted"}
    bands = [tuple(r)[1:] for r in funnels.generalization_funnel(rows).orderBy("position").collect()]
    assert bands == [("emitted", "attempted", 8, 6, 2, 2, 0, 2), ("filter_result_recorded", "emitted", 6, 5, 1, 1, 0, 2), ("filter_passed", "filter_result_recorded", 5, 4, 1, 1, 0, 2), ("validated", "filter_passed", 4, 3, 1, 1, 0, 2), ("reduced", "validated", 3, 2, 1, 1, 0, 2), ("final_usable", "reduced", 2, 1, 1, 1, 0, 1)]
    with pytest.raises(Exception, match="reduced generalizations outside validated, such as 4"):
        funnels.generalization_funnel(rows.withColumn("reduced", F.col("reduced") | (F.col("generalization_id") == 4))).collect()
    assert funnels.generalization_funnel(rows.filter("1 = 0")).agg(F.sum("entering")).first()[0] == 0


def test_non_passing_classes_are_dealt_to_many_tasks(spark, small, tmp_path, duck):
    """Only tests are read; a class's rows and its long list lie in several tasks, and a writer keeps such a list once, not in each row."""
    from assaylake.operators import rules
    from assaylake.plans import reports

    e = experiment.Experiment(snapshot.Snapshot(spark, small, experiment.TABLES))
    assert canonical(reports.non_passing_rule(e).toPandas()) == canonical(duck(reports.SQL["non_passing_rule"])) and set(e.written) == {"tests"}
    tests = spark.range(4000).selectExpr("id", "cast(null as string) as p", "concat('C', id % 2) as c").union(spark.range(300).selectExpr("-id", "'p'", "'C'"))
    names = spark.range(60_000).selectExpr("'p' as p", "'C' as c", "sha2(string(id), 256) as n", "if(id % 4 = 0, 'PASSED', 'FAILED') as result").union(spark.createDataFrame([("p", "D", None, "FAILED"), ("p", "C", "a", None)], "p string, c string, n string, result string"))
    out = rules.non_passing(tests, names, ["p", "c"], "n", 16)
    assert out.select("id", "p", "c").subtract(tests).count() == 0 and out.count() == 4300
    held = out.filter("decision = 'REJECT'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(F.length("failing")).alias("length")).collect()
    assert sum(r.n for r in held) == 300 and max(r.n for r in held) < 150 and {r.length for r in held} == {66 * 45_000 - 2}
    out.write.parquet(f"{tmp_path}/out")
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 60 << 20 and spark.read.parquet(f"{tmp_path}/out").agg(F.sum(F.length("failing"))).first()[0] == 300 * (66 * 45_000 - 2)


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    """An experiment over tables with null parts of places, null figures and repeated rows, and the SQL over the same tables."""
    base, e = tmp_path_factory.mktemp("odd"), {}
    for kind in ("nulls", "repeated"):
        for n in experiment.TABLES:
            rows = spark.read.parquet(f"{small}/{n}.parquet")
            if n == "lineitem" and kind == "nulls":
                for c, k in (("l_partkey", 5), ("l_suppkey", 7), ("l_quantity", 3), ("l_returnflag", 4)):
                    rows = rows.withColumn(c, F.when((F.col("l_orderkey") + F.col("l_linenumber")) % k != 0, F.col(c)))
            if n == "orders" and kind == "nulls":
                rows = rows.withColumn("o_custkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey"))).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")))
            if n in ("orders", "lineitem"):
                rows = rows.union(rows.filter(f"{'o' if n == 'orders' else 'l'}_orderkey % 17 = 0")) if (kind, n) != ("nulls", "orders") else rows
            rows.coalesce(1).write.parquet(f"{base}/{kind}/{n}.parquet")
        e[kind] = experiment.Experiment(snapshot.Snapshot(spark, f"{base}/{kind}", experiment.TABLES))
    there = lambda sql, kind: re.sub(rf"\b(FROM|JOIN) ({'|'.join(experiment.TABLES)})\b", rf"\1 '{base}/{kind}/\2.parquet/*.parquet'", sql)
    return e, lambda name, kind: there(experiment.SQL[name], kind)


def same_as_sql(name, odd, duck, kinds=("nulls", "repeated")):
    """The query over new experiments of the odd tables equals its SQL there; what it wrote."""
    experiments, sql = odd
    for kind in kinds:
        e = experiment.Experiment(experiments[kind].snapshot)
        got = canonical(getattr(experiment, name)(e).toPandas())
        assert len(got[1]) and got == canonical(duck(sql(name, kind)))
    return set(e.written), e


#: What reports and footprints are made of.
PARTS = {"tests", "lines", "assertions", "met"}


def test_covering_tests_meet_reports_by_places(spark, odd, duck):
    """Neither coverage, mutations nor pairs are written, and pairs leave the join of places as they are."""
    written, e = same_as_sql("covering_tests", odd, duck)
    assert written == PARTS | {"test_ext"}
    whole = plan_of(e.covering_tests)
    assert "Exchange" not in whole[: whole.index("ShuffledHashJoin")]


def test_covering_assertions_travel_as_lists(spark, odd, duck):
    """A test's assertions are one list in its footprint: no pair of report and assertion is shuffled, sorted or made different."""
    written, e = same_as_sql("covering_assertions", odd, duck)
    assert written == PARTS | {"test_ext"}
    whole = plan_of(e.covering_assertions)
    assert not re.search("Exchange|Aggregate|Sort ", whole[: whole.index("ShuffledHashJoin")])


def test_coverage_pairs_are_not_written(spark, odd, duck):
    """Ids are made where reports and coverage meet; nothing but the parts is written, and pairs are not shuffled."""
    written, e = same_as_sql("mutation_coverage_pairs", odd, duck)
    assert written == PARTS - {"tests"}
    whole = plan_of(e.pairs)
    assert not re.search("Exchange|Aggregate|Sort ", whole[: whole.index("ShuffledHashJoin")])


def test_extension_sums_footprints_that_are_alike(spark, odd, duck):
    """Neither coverage nor mutations are written for it; reports without coverage and with null parts stay; repeated tests count as in the SQL, their assertions once."""
    written, _ = same_as_sql("mutation_report_extension", odd, duck)
    assert written == PARTS | {"test_ext"}
    sites = spark.createDataFrame([(1, [0], 10), (1, [0, 1], 11), (2, [5], 12), (None, None, 13)], "p int, blocks array<int>, id long")
    feet = spark.createDataFrame([(1, [0], 3), (1, [0, 1], 4), (1, [1], 5), (1, [0], None), (2, [0], 9), (None, [1], 7)], "p int, blocks array<int>, w long")
    assert rows_of(coverage.covered_sums(sites, feet, ["p"], ["w"]).select("id", "w")) == [(10, 7), (11, 12), (12, 0), (13, 0)]
    assert rows_of(coverage.covering(sites, feet, ["p"]).select("mutation_id", "w")) == [(10, 3), (10, 4), (10, None), (11, 3), (11, 4), (11, 5), (11, None)]


def test_comparison_keeps_no_pairs(spark, odd, duck):
    """Weights are found and values counted where places meet: neither pairs, nor coverage, generalizations or mutations are written, and lists hold sizes alone."""
    written, e = same_as_sql("mutation_detection_comparison", odd, duck)
    assert written == PARTS | {"test_ext"}
    assert e.asserting_footprints("model_size").columns == ["project_id", "cls", "m", "blocks", "runtime", "model_size"]


def test_view_checks_ask_shared_parts_once(spark, odd, duck):
    """Coverage is asked by its places and reports by their mutants; no mart of coverage or generalizations is written, and places with null parts have locations."""
    written, _ = same_as_sql("view_checks", odd, duck)
    assert written == PARTS | {"test_ext", "mutations", "locations"}
