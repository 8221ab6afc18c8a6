"""Expression shapes, accessor estimates, causes and generation telemetry over rows that Spark derives from line items, tests and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import topology as T
from .queries import query

#: Sources of asserted values around a key, and the shape of each.
SHAPES = [
    ("x{k}", "VARIABLE"), ("a.b({k})", "SINGLE_CALL"), ("new Foo({k}).get( )", "CTOR_RECEIVER_CALL_0ARG"), ("a.f(g(1)).h({k})", "CHAINED_CALLS_ENDNARG"), ("(int) (m.n({k}) + 1)", "OPERATOR_COMPOSITE"),
    ("{k}L", "LITERAL"), ("xs[{k}]", "ARRAY_INDEX"), ("((K.F{k}))", "FIELD_OR_QUALIFIED_NAME"), ("new Foo(a({k}))", "CTOR_ONLY"), ("() -> {k}", "LAMBDA_OR_METHODREF"), ("m.<A.B>of({k}).size()", "CHAINED_CALLS_END0ARG"),
]


def _texts(key, templates: list[str]):
    """The template that the key's remainder picks, filled with the key."""
    parts = [t.split("{k}") for t in templates]
    return F.get(F.array(*[F.concat(F.lit(p[0]), *[x for rest in p[1:] for x in (key.cast("string"), F.lit(rest))]) for p in parts]), (key % len(templates)).cast("int"))


@query(f"""SELECT CASE WHEN l_linenumber % 5 = 4 THEN 'UNEXTRACTABLE' ELSE ([{", ".join(f"'{s}'" for _, s in SHAPES)}])[l_partkey % {len(SHAPES)} + 1] END AS shape,
CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS "A", CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS "R", CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS "NONE", count(*) AS "TOTAL" FROM lineitem GROUP BY 1""")
def expression_shapes(t):
    n, value = F.col("l_linenumber") % 5, _texts(F.col("l_partkey"), [s for s, _ in SHAPES])
    one = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("value"))
    # JUnit 4 with a message, with a delta, JUnit 5 with a delta, a truth with a message in JUnit 5, and a message alone
    lists = [[one("String", F.lit("m")), one("int", F.lit("1")), one("int", value)], [one("int", F.lit("1")), one("int", value), one("double", F.lit("0.1"))], [one("A", F.lit("e")), one("A", value), one("String", F.lit("m"))], [one("boolean", value), one("String", F.lit("m"))], [one("String", F.lit("m"))]]
    rows = t("lineitem").select(
        F.when(n < 3, "assertEquals").when(n == 3, "assertTrue").otherwise("assertEquals").alias("assertion_name"), F.to_json(F.get(F.array(*[F.array(*x) for x in lists]), n.cast("int"))).alias("assertion_arguments"),
        F.when(n < 2, "JUNIT_4").otherwise("JUNIT_5").alias("test_framework"), F.nullif("l_returnflag", F.lit("N")).alias("first_reject_filter"),
    )
    return T.shape_crosstab(rows, "first_reject_filter", ["A", "R", "NONE"])


#: (method, declaring type, source, provenance, candidate details), then the family and whether it counts as recoverable.
CALLS = [
    ("get", "java.util.Optional", "find(x).get()", None, None, "Optional.get", True), ("get", "com.X.OwnMap", "m.get(a.b({k}))", "LOCAL_OTHER", "", "Map.get", True), ("get", "java.util.Vector", "v{k}.get(0)", "FIELD", '[{"callSource":" v{k} "}]', "List.get", True),
    ("next", "java.util.ListIterator", "it.next()", None, '[{"callSource":"other"}]', "Iterator.next", False), ("size", "java.util.List", "a().size()", "LOCAL_OTHER", None, "other", False), ("get", None, "a.b().get(1)", None, "{broken", "other", False),
]


@query(f"""WITH c AS (SELECT ([{", ".join(f"'{c[5]}'" for c in CALLS)}])[o_orderkey % {len(CALLS)} + 1] AS accessor, ([{", ".join(str(c[6]).lower() for c in CALLS)}])[o_orderkey % {len(CALLS)} + 1] AS ok FROM orders),
n AS (SELECT accessor, count(*) AS total, count(*) FILTER (WHERE ok) AS estimated_recoverable FROM c GROUP BY 1)
SELECT a AS accessor, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(estimated_recoverable, 0) AS BIGINT) AS estimated_recoverable FROM (SELECT unnest(['List.get', 'Map.get', 'Iterator.next', 'Optional.get', 'other']) AS a) LEFT JOIN n ON a = accessor
UNION ALL SELECT 'TOTAL', count(*), count(*) FILTER (WHERE ok) FROM c""")
def accessor_estimate(t):
    names = ["resolved_method_name", "resolved_declaring_type", "resolved_call_source", "receiver_provenance", "candidate_details"]
    pick = (F.col("o_orderkey") % len(CALLS)).cast("int")
    plain = [F.get(F.array(*[F.lit(c[i]) for c in CALLS]), pick).alias(names[i]) for i in (0, 1, 3)]
    filled = [F.when(~pick.isin([n for n, c in enumerate(CALLS) if c[i] is None]), _texts(F.col("o_orderkey"), [c[i] or "" for c in CALLS])).alias(names[i]) for i in (2, 4)]
    return T.accessor_summary(T.accessor_estimates(t("orders").select(*plain, *filled)))


CANDIDATES = [("[]", 0), ('[{"callSource":"a.b()"},{"callSource":"f(g()).h( )"}]', 1), ('[{"callSource":"a.b()"},{"callSource":"a.c(f({k}))"}]', 2), ('[{"callSource":""}]', 0), ('[{"other":{k}}]', 0), ('[{"callSource":"x{k}"}]', 1)]
CHOICES = ["Candidate detail unavailable", "Choice-invariant", "Choice-dependent"]


@query(f"""SELECT category, CAST(count(k) AS BIGINT) AS count, coalesce(count(k) / nullif(sum(count(k)) OVER (), 0), 0)::DOUBLE AS share FROM (SELECT unnest({CHOICES}) AS category, unnest([0, 1, 2]) AS n)
LEFT JOIN (SELECT ({[n for _, n in CANDIDATES]})[o_orderkey % {len(CANDIDATES)} + 1] AS n, o_orderkey AS k FROM orders) USING (n) GROUP BY 1""")
def candidate_choice(t):
    rows = t("orders").select(T.choice_sensitivity(_texts(F.col("o_orderkey"), [c for c, _ in CANDIDATES])).alias("category"))
    return T.category_shares(rows, "category", CHOICES)


DIAGNOSTICS = [
    ('{"message":"x Caused by: a.B: {k}\\nCaused by: java.lang.IllegalStateException: no"}', 0), ("in MARK\njava.lang.NoSuchFieldException: f{k}", 1), ("Caused by: app.Odd: {k}\n at vm.core.PEER_java_util.x", 2), ("Caused by: vm.core.Stop", 3), ("early.FirstException: 1 MARK\nlate.OtherError: {k}", 0), ('{"other":{k}}', 3),
]
KINDS = ["Application exception", "model/field gap", "native-peer gap", "Unparsed"]


@query(f"""SELECT category, CAST(count(k) AS BIGINT) AS count, coalesce(count(k) / nullif(sum(count(k)) OVER (), 0), 0)::DOUBLE AS share FROM (SELECT unnest({KINDS}) AS category, unnest([0, 1, 2, 3]) AS n)
LEFT JOIN (SELECT ({[n for _, n in DIAGNOSTICS]})[event_id % {len(DIAGNOSTICS)} + 1] AS n, event_id AS k FROM events) USING (n) GROUP BY 1""")
def diagnostic_causes(t):
    cause = T.recovered_cause(_texts(F.col("event_id"), [d for d, _ in DIAGNOSTICS]), "MARK", "vm.core", r"vm\.core\.PEER_\w+")
    return T.category_shares(t("events").select(cause.alias("category")), "category", KINDS)


def _telemetry(t) -> dict[str, DataFrame]:
    """Line items as clauses and parameters, orders as generalizations and their filter decisions."""
    items, orders = t("lineitem"), t("orders")
    clauses = items.select(F.concat("l_returnflag", F.lit("_"), (F.col("l_partkey") % 9).cast("string")).alias("shape"), F.col("l_linestatus").alias("type_domain"), (F.col("l_quantity") > 25).alias("consumed"))
    parameters = items.select(F.col("l_orderkey").alias("generalization_id"), F.col("l_returnflag").alias("type_domain"), F.col("l_linestatus").alias("representation"), (F.col("l_linenumber") > 2).alias("symbolic_spec_present"))
    decisions = orders.select(F.when(F.col("o_custkey") % 2 == 0, "x.ParameterTypeFilter").otherwise("x.OtherFilter").alias("filter_name"), F.when(F.col("o_orderstatus") == "F", "REJECT").otherwise("ACCEPT").alias("decision"), F.col("o_orderpriority").alias("reason"))
    return T.generation_coverage(clauses, parameters, decisions, orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("exclusion_info")))


@query("SELECT l_returnflag || '_' || (l_partkey % 9) AS shape, count(*) AS count FROM lineitem WHERE NOT l_quantity > 25 GROUP BY 1")
def residual_shapes(t):
    return _telemetry(t)["residual_shapes"]


@query("SELECT l_linestatus AS type_domain, count(*) FILTER (WHERE l_quantity > 25) AS consumed, count(*) FILTER (WHERE NOT l_quantity > 25) AS residual FROM lineitem GROUP BY 1")
def domain_coverage(t):
    return _telemetry(t)["domain_coverage"]


@query("SELECT l_linestatus AS representation, count(*) AS count FROM lineitem GROUP BY 1")
def parameter_representations(t):
    return _telemetry(t)["representations"]


@query("SELECT o_orderpriority AS declared_type, 'ENTRY_GAP' AS type_domain, count(*) AS count FROM orders WHERE o_custkey % 2 = 0 AND o_orderstatus = 'F' GROUP BY 1")
def entry_gap(t):
    return _telemetry(t)["entry_gap"]


@query("SELECT l_returnflag AS type_domain, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS exclusion_reason, count(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT l_linenumber > 2 GROUP BY 1, 2")
def specification_gap(t):
    return _telemetry(t)["specification_gap"]


#: Expressions around two names of a document (a, b), its whole text without quotes, brackets and signs (t), and n_chars % 60 nested brackets (o, c); and the shape of each.
OF_TEXTS = [
    (["o", "a", "c"], "VARIABLE"), (["a", "'.'", "b", "'('", "t", "')'"], "SINGLE_CALL"), (["a", "'.f('", "t", "').'", "b", "'()'"], "CHAINED_CALLS_END0ARG"), (["'new A('", "t", "').'", "b", "'('", "a", "')'"], "CTOR_RECEIVER_CALL_NARG"),
    (["a", "'[f'", "o", "t", "c", "']'"], "ARRAY_INDEX"), (["'(int) ('", "a", "' + '", "t", "')'"], "OPERATOR_COMPOSITE"), (["'\"'", "t", "'\"'"], "LITERAL"), (["a", "'.'", "b", "'::'", "t"], "LAMBDA_OR_METHODREF"),
]


@query(f"SELECT lang, ([{', '.join(repr(s) for _, s in OF_TEXTS)}])[doc_id % {len(OF_TEXTS)} + 1] AS shape, count(*) AS n FROM documents GROUP BY 1, 2")
def expression_shapes_of_texts(t):
    """Whole texts inside expressions: the scan's time follows their length, not their nesting."""
    text = F.coalesce("text", F.lit(""))
    name = lambda pattern: F.concat(F.lit("v"), F.regexp_extract(text, pattern, 1))
    nested = F.coalesce(F.col("n_chars") % 60, F.lit(0)).cast("int")
    pieces = {"a": name("([a-z]{2,})"), "b": name("([a-z]{2,})[^a-z]*$"), "t": F.regexp_replace(text, r"[^\w\s.,]|_", ""), "o": F.repeat(F.lit("("), nested), "c": F.repeat(F.lit(")"), nested)}
    made = F.array(*[F.concat(*[pieces[p] if p in pieces else F.lit(p[1:-1]) for p in parts]) for parts, _ in OF_TEXTS])
    rows = t("documents").select("lang", T.expression_shape(F.get(made, (F.col("doc_id") % len(OF_TEXTS)).cast("int"))).alias("shape"))
    return rows.groupBy("lang", "shape").agg(F.count("*").alias("n"))
