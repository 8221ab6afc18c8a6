"""Shapes and estimates on odd inputs, artefacts, yields, and the fold in slices."""

import itertools
import random
import time

import pandas as pd
import pytest
from assaylake.functions import expressions as E
from assaylake.operators import topology as T
from pyspark.sql import functions as F


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


SHAPES = {
    None: "UNEXTRACTABLE", "": "FIELD_OR_QUALIFIED_NAME", "()": "FIELD_OR_QUALIFIED_NAME", " ((x)) ": "VARIABLE", '"a(b"': "LITERAL", "'('": "LITERAL", "-1_000L": "LITERAL", "0xFFL": "LITERAL", "null": "LITERAL", "this": "VARIABLE",
    "a.b.C": "FIELD_OR_QUALIFIED_NAME", "(int) x": "VARIABLE", "(A<B>) (C) f.g()": "SINGLE_CALL", "(a) + (b)": "OPERATOR_COMPOSITE", "(a + b)": "OPERATOR_COMPOSITE", "f(a + b)": "SINGLE_CALL", "f(a ? b : c)": "SINGLE_CALL", "a ? b : c": "OPERATOR_COMPOSITE",
    "!f()": "OPERATOR_COMPOSITE", "x instanceof A": "OPERATOR_COMPOSITE", "xs[i + 1]": "ARRAY_INDEX", "f(1)[0]": "ARRAY_INDEX", "new A()": "CTOR_ONLY", "new A(f()).x": "CTOR_ONLY", "new A().f()": "CTOR_RECEIVER_CALL_0ARG", "new A().f(1)": "CTOR_RECEIVER_CALL_NARG",
    "new A().f().x": "CTOR_RECEIVER_CALL_NARG", "new A().f().g()": "CHAINED_CALLS", "a.f(g(h(1)))": "SINGLE_CALL", "a.f().g( )": "CHAINED_CALLS_END0ARG", "a.f().g(x.y())": "CHAINED_CALLS_ENDNARG", "a[f()].g().h": "CHAINED_CALLS_ENDNARG", "m.<A.B>of(1)": "SINGLE_CALL",
    "((A) b).c()": "CHAINED_CALLS_END0ARG", "A::b": "LAMBDA_OR_METHODREF", "f(x -> y)": "LAMBDA_OR_METHODREF", "-x": "FIELD_OR_QUALIFIED_NAME", "f(": "FIELD_OR_QUALIFIED_NAME",
}


def test_shapes(spark):
    rows = frame(spark, "e string", *[(e,) for e in SHAPES if e != "f("])
    got = {r.e: r.s for r in rows.select("e", T.expression_shape(F.col("e")).alias("s")).collect()}
    assert got == {e: s for e, s in SHAPES.items() if e != "f("}
    assert [E.shape(t) for t in E.paired([*(e for e in SHAPES if e is not None)])] == [s for e, s in SHAPES.items() if e is not None] and E.paired([]) == []


def test_brackets_are_paired_in_linear_time():
    """As a stack pairs them, in every text of a batch, balanced or not; four times the brackets take no more than some eight times the time."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("([)]a,.") for _ in range(rng.randrange(40))) for _ in range(500)]
    for text, t in zip(texts, E.paired(texts), strict=True):
        stack, partner = [], [-1] * len(t.kinds)
        for i, v in enumerate(t.values):
            if v in "([":
                stack.append(i)
            elif v in ")]" and stack:
                j = stack.pop()
                partner[i], partner[j] = j, i
        assert t.partner == partner, text
    took = []
    for n in (25_000, 100_000):
        deep = ["(" * n + "x" + ")" * n, "f(" * n + ")" * n, "a.b(" * n + "1" + ")" * n + ".c()", "[(" * n]
        start = time.process_time()
        assert [E.shape(t) for t in E.paired(deep)] == ["VARIABLE", "SINGLE_CALL", "CHAINED_CALLS_END0ARG", "FIELD_OR_QUALIFIED_NAME"]
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1


def test_actual_expression(spark):
    args = lambda *kinds: "[" + ",".join(f'{{"type":"{k}","value":"{i}"}}' for i, k in enumerate(kinds)) + "]"
    cases = [
        ("assertEquals", args("String", "int", "int"), "JUNIT_4", "2"), ("assertEquals", args("int", "int", "double"), "JUNIT_4", "1"), ("assertEquals", args("S", "a", "b", "c"), "JUNIT_4", "2"), ("assertEquals", args("a", "b"), "JUNIT_4", "1"),
        ("assertEquals", args("a"), "JUNIT_4", None), ("assertEquals", args("a", "b", "c"), "JUNIT_5", "1"), ("assertTrue", args("S", "b"), "JUNIT_4", "1"), ("assertTrue", args("b"), "JUNIT_4", "0"), ("assertFalse", args("b", "S"), "JUNIT_5", "0"),
        ("assertTrue", "[]", "JUNIT_5", None), ("assertNull", args("a"), "JUNIT_5", None), ("assertTrue", "nonsense", "JUNIT_5", None), ("assertTrue", '{"type":"a","value":"0"}', "JUNIT_5", None), ("assertTrue", None, "JUNIT_4", None), (None, args("b"), None, None),
    ]
    got = frame(spark, "n string, a string, f string, want string", *cases).select("want", T.actual_expression(F.col("n"), F.col("a"), F.col("f")).alias("got")).collect()
    assert [r.got for r in got] == [c[3] for c in cases]


def test_receivers_candidates_and_causes(spark):
    rows = frame(spark, "s string, m string", ("a.get().get(1)", "get"), ("get()", "get"), (None, "get"), ("a.get()", None), ("x .get(", "get"), ("a.get()", ""))
    assert [r[0] for r in rows.select(T.call_receiver(F.col("s"), F.col("m"))).collect()] == ["a.get()", None, None, None, "x", None]
    calls = {"f()": False, "f( )": False, "f(a)": True, "f(g())": True, "f(a).g()": False, "x": False, "": False, None: False, "f(a) ": True, "f)": False}
    got = {r.c: r.a for r in frame(spark, "c string", *[(c,) for c in calls]).select("c", T.call_has_arguments(F.col("c")).alias("a")).collect()}
    assert got == calls
    details = {None: 0, "": 0, "x": 0, "[]": 0, '{"callSource":"a(b)"}': 0, '[{"callSource":"a(b)"},{"callSource":null}]': 0, '[{"callSource":"a()"}]': 1, '[{"callSource":5}]': 0, '[{"callSource":["a(b)"]}]': 0, '[{"callSource":true},{"callSource":"f(x)"}]': 0, "[1]": 0, '[{}]': 0, '[{"callSource":"  "}]': 0, '[{"callSource":"f(\\")\\")"}]': 2, "[null]": 0, "5": 0, '[{"callSource":"a()"},{"callSource":"b(c)"}]': 2}
    names = ["Candidate detail unavailable", "Choice-invariant", "Choice-dependent"]
    got = {r.d: r.c for r in frame(spark, "d string", *[(d,) for d in details]).select("d", T.choice_sensitivity(F.col("d")).alias("c")).collect()}
    assert got == {d: names[n] for d, n in details.items()}
    causes = {None: "Unparsed", "": "Unparsed", "plain": "Unparsed", '{"message":null,"detail":"Caused by: a.B"}': "Application exception", "[1]": "Unparsed", "Caused by: a.NoSuchMethodException x vm.P_1": "model/field gap", "Caused by: vm.X at vm.P_1": "native-peer gap"}
    got = {r.d: r.c for r in frame(spark, "d string", *[(d,) for d in causes]).select("d", T.recovered_cause(F.col("d"), "MARK", "vm.", r"vm\.P_\w+").alias("c")).collect()}
    assert got == causes
    none = frame(spark, "category string")
    assert [tuple(r) for r in T.category_shares(none, "category", ["a", "b"]).orderBy("category").collect()] == [("a", 0, 0.0), ("b", 0, 0.0)]


def test_yield_and_artefacts(spark):
    lives = frame(spark, "generalization_id long, compiled boolean, final_usable boolean, failure_stage string, failure_code string", (1, True, True, None, None), (2, True, False, "RUN", "X"), (3, None, False, None, None))
    gens = frame(spark, "id long, is_included boolean", (1, True), (2, True), (3, False), (4, None))
    assert tuple(T.true_yield(gens, lives, ["compiled", "final_usable"]).first()) == (4, 2, 2, 1)
    outcomes = frame(spark, "generalization_id long, diagnostic_kind string", (2, "A"), (2, "A"), (1, "B"))
    assert sorted(tuple(r) for r in T.yield_gap(lives, outcomes, "generalization_id").collect()) == [("<none>", "<none>", "<no outcome>", 1), ("RUN", "X", "A", 2)]
    projects = frame(spark, "id long, test_reports_path string, coverage_reports_path string, mutation_reports_path string", (1, "t", "c", "m"), (2, "t2", "c2", "m2"))
    tasks = frame(
        spark, "id long, project_id long, stage string, variant string, status string, info string",
        (1, 1, "BUILD", None, "FAILED", None), (2, 1, "BUILD", None, "OK", None), (3, 1, "COLLECT_JUNIT_REPORTS_ORIGINAL", None, "FAILED", "Report directory x does not exist"), (4, 1, "COLLECT_PIT_DATA_X", "V", "FAILED", "Report file linecoverage.xml does not exist"),
        (5, 1, "COLLECT_PIT_DATA_X", "V", "FAILED", "other"), (6, 2, "COLLECT_JACOCO_DATA_X", "V", "FAILED", "Report file does not exist"), (7, 2, "COLLECT_PIT_DATA_X", "W", "FAILED", "Report file does not exist"),
    )
    got = {(r.project_id, r.searched_path, r.build) for r in T.missing_artefacts(projects, tasks, {"build": "BUILD"}).collect()}
    assert got == {(1, "t", "OK"), (1, "m/linecoverage.xml", "OK"), (2, "c2/jacoco.csv", None), (2, "m2/mutations.xml", None)}


@pytest.mark.parametrize("width", [1, 2, 3])
def test_sliced_fold_equals_whole(spark, width):
    """All sequences of three events, and longer ones, in slices of one, two and three events."""
    from assaylake.streaming.lifecycle import fold_events

    kinds = list(itertools.product("abx", [True, False], [None, "p"]))
    rows = [(k, i, *e) for k, events in enumerate(itertools.product(kinds, repeat=3)) for i, e in enumerate(events)]
    rows += [(10_000 + k, i, *kinds[(k * 7 + i * i * 5 + i) % len(kinds)]) for k in range(60) for i in range(12)]
    events = frame(spark, "k long, seq long, stage string, ok boolean, code string", *rows)
    whole = fold_events(events, "k", ["seq"], ["a", "b"])
    parts = fold_events(events, "k", ["seq"], ["a", "b"], F.floor(F.col("seq") / width))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)


def test_tokens_of_a_batch_are_held_in_slices(monkeypatch):
    """A batch of many texts never has all its tokens at once; slices change no result."""
    texts = pd.Series([f"a{i}.get(b, (c))" if i % 3 else None for i in range(300)] + ["(" * 500 + "x" + ")" * 500])
    whole = (list(E._shapes(texts)), list(E._arguments(texts)), list(E._any_arguments(pd.Series([list(texts[:5]), None, []]))))
    sizes, pair = [], E.paired
    monkeypatch.setattr(E, "SLICE", 200)
    monkeypatch.setattr(E, "paired", lambda held: sizes.append(sum(map(len, held))) or pair(held))
    assert (list(E._shapes(texts)), list(E._arguments(texts)), list(E._any_arguments(pd.Series([list(texts[:5]), None, []])))) == whole
    assert max(sizes) == 1001 and sorted(sizes)[-3] <= 200
    assert len(E._shapes(pd.Series([], dtype="object"))) == 0
