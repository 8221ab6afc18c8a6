"""The evaluation operators bound to tables, and the same questions in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import blockers, ids, pairs, populations, quality, ranking, rates
from ..scratch import expanded
from ..sources.intervals import event_intervals
from ..sources.text_stats import line_stats
from ..streaming.lifecycle import fold_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (t) -> DataFrame, where t(name) reads a table."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: expanded(spark).read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STATUS = {"finished": ["F"], "open": ["O"], "partial": ["P"]}


def _rates_sql(keys: str, source: str) -> str:
    on = f"USING ({keys})" if keys else "ON true"
    k = f"{keys}, " if keys else ""
    pct = ", ".join(f"round({n} * 100.0::DOUBLE / total, 2) AS {n}_pct" for n in STATUS)
    count = ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{v[0]}') AS {n}" for n, v in STATUS.items())
    return f"""
WITH c AS (SELECT {k}o_orderpriority, count(*) AS total, {count} FROM {source} GROUP BY ALL),
r AS (SELECT *, {pct} FROM c),
b AS (SELECT {k}{", ".join(f"{n}_pct AS base_{n}" for n in STATUS)} FROM r WHERE o_orderpriority = '1-URGENT')
SELECT {k}o_orderpriority, total, {", ".join(STATUS)}, {", ".join(f"{n}_pct" for n in STATUS)}, {", ".join(f"round({n}_pct - base_{n}, 2) AS {n}_diff" for n in STATUS)} FROM r JOIN b {on}"""


@query(_rates_sql("", "orders"))
def outcome_rates_by_variant(t):
    return rates.outcome_rates(t("orders"), "o_orderpriority", [], "o_orderstatus", STATUS, "1-URGENT")


@query(_rates_sql("c_mktsegment", "orders JOIN customer ON o_custkey = c_custkey"))
def outcome_rates_by_group(t):
    rows = t("orders").join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return rates.outcome_rates(rows, "o_orderpriority", ["c_mktsegment"], "o_orderstatus", STATUS, "1-URGENT")


#: Line numbers repeat within an order here, so further columns break ties.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _chain(t):
    return blockers.reject_chain(t("lineitem"), "l_orderkey", "l_returnflag", LINE_ORDER)


CHAIN = f"SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS position FROM lineitem"


@query(f"SELECT l_returnflag, count(*) FILTER (WHERE position = 1) AS first_rejects, count(*) AS total_rejects, count(*) FILTER (WHERE position > 1) AS shadowed FROM ({CHAIN}) GROUP BY 1")
def first_reject_chain(t):
    return blockers.blocker_summary(_chain(t), "l_orderkey", "l_returnflag")


@query(f"""WITH p AS (SELECT l_orderkey, max(l_returnflag) FILTER (WHERE position = 1) AS first, max(l_returnflag) FILTER (WHERE position = 2) AS second FROM ({CHAIN}) GROUP BY 1)
SELECT first, second, count(*) AS n FROM p WHERE second IS NOT NULL GROUP BY 1, 2""")
def blocker_cooccurrence(t):
    return blockers.first_two(_chain(t), "l_orderkey", "l_returnflag")


@query("WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS entities, count(*) FILTER (WHERE n > 1) AS multi, round(count(*) FILTER (WHERE n > 1) * 100.0::DOUBLE / count(*), 2) AS multi_pct FROM s")
def multi_blocker_rate(t):
    return blockers.multi_blocker_rate(_chain(t), "l_orderkey").withColumn("multi_pct", F.col("multi_pct").cast("double"))


@query("""WITH c AS (SELECT l_orderkey, string_agg(f, '+' ORDER BY f) AS combo FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS f FROM lineitem) GROUP BY 1)
SELECT combo, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, combo LIMIT 10""")
def blocker_combos(t):
    return blockers.blocker_combos(t("lineitem").withColumn("f", F.concat("l_returnflag", "l_linestatus")), "l_orderkey", "f", 10)


@query("WITH s AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1) SELECT l_orderkey, l_returnflag FROM s WHERE n = 1")
def sole_blocked_entities(t):
    return blockers.sole_blocked(t("lineitem"), "l_orderkey", "l_returnflag")


@query("""WITH cause AS (SELECT o_orderkey, CASE
  WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'RETURNED'
  WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) THEN 'LARGE'
  WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.08) THEN 'DISCOUNTED' ELSE 'UNKNOWN' END AS cause FROM orders),
c AS (SELECT cause, count(*) AS n FROM cause GROUP BY 1)
SELECT cause, n, CAST(sum(n) OVER () AS BIGINT) AS total, round(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS pct FROM c""")
def first_cause_attribution(t):
    lines = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    evidence = [("RETURNED", lines.filter("l_returnflag = 'R'")), ("LARGE", lines.filter("l_quantity > 45")), ("DISCOUNTED", lines.filter("l_discount >= 0.08D"))]
    causes = blockers.first_cause(t("orders"), "o_orderkey", evidence)
    return blockers.with_shares(causes.groupBy("cause").agg(F.count("*").alias("n"))).withColumn("pct", F.col("pct").cast("double"))


@query(f"""SELECT l_orderkey, bool_or(l_returnflag = 'R') AS excluded, arg_min(l_linestatus, ({', '.join(LINE_ORDER)})) FILTER (WHERE l_returnflag = 'R') AS code FROM lineitem GROUP BY 1""")
def verdict_fold(t):
    rows = t("lineitem").withColumn("decision", F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("ACCEPT"))
    return blockers.verdicts(rows, "l_orderkey", "decision", "l_linestatus", LINE_ORDER)


@query("""SELECT 'orders' AS level, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS included, count(*) FILTER (WHERE o_orderstatus <> 'F') AS excluded FROM orders
UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (WHERE l_linestatus = 'F'), count(*) FILTER (WHERE l_linestatus <> 'F') FROM lineitem
UNION ALL SELECT 'part', count(*), count(*) FILTER (WHERE p_size < 25), count(*) FILTER (WHERE p_size >= 25) FROM part""")
def entity_status_union(t):
    levels = [("orders", F.col("o_orderstatus") == "F"), ("lineitem", F.col("l_linestatus") == "F"), ("part", F.col("p_size") < 25)]
    return quality.all_checks([t(n).agg(F.count("*").alias("total"), F.count_if(c).alias("included"), F.count_if(~c).alias("excluded")).select(F.lit(n).alias("level"), "*") for n, c in levels])


@query("SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS all_clean, bool_or(o_orderstatus = 'F') AS any_finished, count(*) AS n FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus <> 'P') AND bool_or(o_orderstatus = 'F')")
def project_status_having(t):
    agg = t("orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") != "P").alias("all_clean"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_finished"), F.count("*").alias("n"))
    return agg.filter("all_clean and any_finished")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value FROM events WHERE event_type = 'error' GROUP BY 1")
def first_failed_per_entity(t):
    return ranking.first_per_key(t("events").filter("event_type = 'error'").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_per_entity(t):
    return ranking.first_per_key(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], latest=True).drop("ts")


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_partkey, l_suppkey) AS pair_id FROM lineitem")
def global_dense_ids(t):
    return ids.global_dense_id(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "pair_id").drop("l_partkey", "l_suppkey")


@query("""WITH a AS (SELECT o_custkey, list(DISTINCT l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
e AS (SELECT o_custkey, unnest(parts) AS p FROM a)
SELECT DISTINCT o_custkey, l_suppkey FROM e JOIN lineitem ON l_partkey = p WHERE l_returnflag = 'R'""")
def array_membership_join(t):
    urgent = t("orders").filter("o_orderpriority = '1-URGENT'").join(t("lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    arrays = urgent.groupBy("o_custkey").agg(F.collect_set("l_partkey").alias("parts"))
    return pairs.membership_pairs(arrays, "parts", t("lineitem").filter("l_returnflag = 'R'"), "l_partkey", [], "o_custkey", "l_suppkey")


@query("""WITH r AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey, a.l_returnflag AS variant_a, a.n AS value_a, b.l_returnflag AS variant_b, b.n AS value_b FROM r a JOIN r b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag <> b.l_returnflag""")
def variant_pairs(t):
    return pairs.variant_pairs(t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")), ["l_suppkey"], "l_returnflag", "n")


@query("""WITH r AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT r.l_suppkey, r.l_returnflag, r.n, b.n AS baseline, r.n - b.n AS diff FROM r JOIN r b ON r.l_suppkey = b.l_suppkey AND b.l_returnflag = 'N'""")
def baseline_self_join(t):
    return pairs.against_baseline(t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")), ["l_suppkey"], "l_returnflag", "N", "n")


@query("""WITH f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT coalesce(f.o_custkey, o.o_custkey) AS o_custkey, f.o_custkey IS NOT NULL AS in_left, o.o_custkey IS NOT NULL AS in_right FROM f FULL JOIN o ON f.o_custkey = o.o_custkey""")
def full_outer_pairing(t):
    return pairs.full_pairing(t("orders").filter("o_orderstatus = 'F'"), t("orders").filter("o_orderstatus = 'O'"), ["o_custkey"])


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS children FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag <> 'N')")
def replaceable_parents(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return pairs.represented_parents(lines, "l_orderkey", "l_linenumber", lines.filter("l_returnflag <> 'N'"))


@query("SELECT o_orderkey, count(l_orderkey) AS children, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def child_extension(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("q"))
    return pairs.child_extension(t("orders").select("o_orderkey"), lines, "o_orderkey", {"quantity": "q"})


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_finished, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_urgent FROM customer")
def exists_flags(t):
    orders = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    flagged = populations.with_flag(t("customer").select("c_custkey"), ["c_custkey"], orders.filter("o_orderstatus = 'F'"), "has_finished")
    return populations.with_flag(flagged, ["c_custkey"], orders.filter("o_orderpriority = '1-URGENT'"), "has_urgent")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists_survivors(t):
    failed = t("orders").filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return populations.survivors(t("customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment"), ["c_custkey"], failed)


FUNNEL = ["o_totalprice > 50000", "o_orderstatus <> 'P'", "o_orderpriority <> '5-LOW'", "o_custkey % 3 = 0"]


@query("WITH s AS (SELECT count(*) AS n0, " + ", ".join(f"count(*) FILTER (WHERE {' AND '.join(FUNNEL[: i + 1])}) AS n{i + 1}" for i in range(4)) + " FROM orders) " + " UNION ALL ".join(f"SELECT 's{i + 1}' AS stage, {i + 1} AS position, n{i} AS entering, n{i + 1} AS surviving, n{i} - n{i + 1} AS excluded FROM s" for i in range(4)))
def nested_funnel(t):
    return populations.nested_funnel(t("orders"), [(f"s{i + 1}", F.expr(c)) for i, c in enumerate(FUNNEL)])


@query("""WITH m AS (SELECT (o_orderstatus = 'P')::INT AS a, (o_totalprice > 150000)::INT AS b, (o_orderpriority = '5-LOW')::INT AS c FROM orders)
SELECT CASE WHEN a + b + c = 0 THEN 'UNEXPLAINED' WHEN a + b + c > 1 THEN 'AMBIGUOUS' WHEN a = 1 THEN 'PARTIAL' WHEN b = 1 THEN 'LARGE' ELSE 'LOW' END AS mechanism, count(*) AS n FROM m GROUP BY 1""")
def mechanism_partition(t):
    return populations.mechanism_partition(t("orders"), [("PARTIAL", F.col("o_orderstatus") == "P"), ("LARGE", F.col("o_totalprice") > 150000), ("LOW", F.col("o_orderpriority") == "5-LOW")])


KINDS = ["signup", "error", "click", "view", "purchase"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS \"{k}\"" for k in KINDS) + ", count(*) AS total FROM events GROUP BY 1")
def decision_pivot(t):
    return populations.crosstab(t("events"), "user_id", "event_type", KINDS)


@query("SELECT l_linestatus, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{k}') AS \"{k}\"" for k in "ANR") + ", count(*) AS total FROM lineitem GROUP BY 1")
def crosstab_total(t):
    return populations.crosstab(t("lineitem"), "l_linestatus", "l_returnflag", list("ANR"))


@query("SELECT user_id, event_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id), 2) AS pct FROM events GROUP BY 1, 2")
def share_of_group(t):
    return ranking.share_of_group(t("events"), ["user_id"], ["event_type"]).withColumn("pct", F.col("pct").cast("double"))


@query("WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, n, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS total FROM c ORDER BY n DESC, p_brand LIMIT 10")
def topk_with_total(t):
    return ranking.top_k(t("part").groupBy("p_brand").agg(F.count("*").alias("n")), "n", ["p_brand"], 10)


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def topk_per_tier(t):
    return ranking.top_k_per_group(t("customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey")


@query("SELECT o_orderpriority, sum(CAST(l_quantity AS BIGINT))::DOUBLE / count(*) AS mean, median(CAST(l_quantity AS BIGINT))::DOUBLE AS median FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def median_fanout(t):
    joined = t("lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q")).groupBy("l_orderkey", "q").agg(F.count("*").alias("w"))
    rows = joined.join(t("orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.fan_out_statistics(rows, ["o_orderpriority"], "q", "w")


GROUPS = {"ENTER": ["signup"], "READ": ["view", "click"], "END": ["purchase", "error"]}


@query("""WITH g AS (SELECT user_id, CASE WHEN event_type = 'signup' THEN 'ENTER' WHEN event_type IN ('view', 'click') THEN 'READ' ELSE 'END' END AS grp, CAST(value AS DECIMAL(18,6)) AS value FROM events)
SELECT user_id, grp, round(CAST(sum(value) AS DOUBLE), 4) AS runtime FROM g GROUP BY 1, 2""")
def runtime_stage_groups(t):
    grp = X.ordered_rules([(F.col("event_type").isin(v), k) for k, v in GROUPS.items()])
    return t("events").groupBy("user_id", grp.alias("grp")).agg(F.round(F.sum(F.col("value").cast("decimal(18,6)")).cast("double"), 4).alias("runtime"))


@query("""WITH s AS (SELECT user_id, count(*) AS shared FROM events WHERE event_type = 'signup' GROUP BY 1), v AS (SELECT user_id, event_type, count(*) AS own FROM events WHERE event_type <> 'signup' GROUP BY 1, 2)
SELECT v.user_id, event_type, own, own + coalesce(shared, 0) AS with_shared FROM v LEFT JOIN s ON v.user_id = s.user_id""")
def shared_plus_variant(t):
    events = t("events")
    shared = events.filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("shared"))
    own = events.filter("event_type <> 'signup'").groupBy("user_id", "event_type").agg(F.count("*").alias("own"))
    return own.join(shared, "user_id", "left").select("user_id", "event_type", "own", (F.col("own") + F.coalesce("shared", F.lit(0))).alias("with_shared"))


@query("""WITH b AS (SELECT p_brand, p_retailprice, max(p_size) AS p_size FROM part GROUP BY 1, 2),
f AS (SELECT *, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
SELECT p_partkey, p_brand FROM part SEMI JOIN (SELECT * FROM f WHERE before IS NULL OR p_size > before) USING (p_brand, p_retailprice, p_size)""")
def pareto_front(t):
    return ranking.pareto_front(t("part"), ["p_brand"], "p_retailprice", "p_size").select("p_partkey", "p_brand")


@query("""WITH s AS (SELECT n_nationkey, seg FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer)), c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1, 2)
SELECT n_nationkey, seg, coalesce(n, 0) AS n FROM s LEFT JOIN c ON c_nationkey = n_nationkey AND c_mktsegment = seg""")
def skeleton_counts(t):
    segments = t("customer").select(F.col("c_mktsegment").alias("seg")).distinct()
    skeleton = t("nation").select("n_nationkey").crossJoin(segments)
    counts = t("customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"))
    return populations.on_skeleton(skeleton, counts, ["n_nationkey", "seg"])


@query("""WITH e AS (SELECT event_type, unnest(json_keys(props)) AS k, props FROM events)
SELECT event_type, k AS parameter, count(*) AS generated, count(DISTINCT json_extract_string(props, '$.' || k)) AS distinct_values FROM e GROUP BY 1, 2""")
def distinct_values_per_parameter(t):
    values = t("events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("parameter", "value"))
    return values.groupBy("event_type", "parameter").agg(F.count("value").alias("generated"), F.countDistinct("value").alias("distinct_values"))


@query("SELECT event_type, count(DISTINCT v) AS union_values FROM (SELECT event_type, json_extract_string(props, '$.k') AS v FROM events UNION SELECT event_type, CAST(user_id AS VARCHAR) FROM events) GROUP BY 1")
def suite_union_values(t):
    e = t("events")
    both = e.select("event_type", F.get_json_object("props", "$.k").alias("v")).union(e.select("event_type", F.col("user_id").cast("string")))
    return both.distinct().groupBy("event_type").agg(F.count("v").alias("union_values"))


@query("SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY 1")
def json_map_counts(t):
    counts = t("events").select("user_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("cause", "n")).filter("cause = 'k'")
    return counts.groupBy("user_id").agg(F.sum("n").alias("k_sum"), F.max("n").alias("k_max"))


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('review:' || c_custkey), c_custkey) AS r FROM customer) WHERE r <= 5")
def stratified_hash_sample(t):
    return ranking.hash_sample(t("customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 5, "review")


@query("""WITH l0 AS (SELECT pos // 256 AS node, sha256(string_agg(line, chr(10) ORDER BY pos)) AS h FROM (SELECT row_number() OVER (ORDER BY o_orderkey, o_custkey) - 1 AS pos, '["' || o_orderkey || '","' || o_custkey || '"]' AS line FROM orders) GROUP BY 1),
l1 AS (SELECT node // 256 AS node, sha256(string_agg(h, chr(10) ORDER BY node)) AS h FROM l0 GROUP BY 1), l2 AS (SELECT sha256(string_agg(h, chr(10) ORDER BY node)) AS h FROM l1)
SELECT (SELECT count(*) FROM orders) AS n, CASE WHEN (SELECT count(*) FROM l0) = 1 THEN (SELECT max(h) FROM l0) WHEN (SELECT count(*) FROM l1) = 1 THEN (SELECT max(h) FROM l1) ELSE (SELECT max(h) FROM l2) END AS sha256""")
def population_digest(t):
    return ranking.population_digest(t("orders"), ["o_orderkey", "o_custkey"])


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, list_position(['signup', 'view', 'click', 'purchase'], event_type) AS p, value >= 0 AND event_id % 5 <> 0 AS ok, CASE WHEN event_id % 3 = 0 THEN event_type || event_id END AS code FROM events WHERE event_type <> 'error'),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, 0 AS reached, 0 AS failed, CAST(NULL AS VARCHAR) AS code FROM e UNION ALL SELECT user_id, e.n,
  CASE WHEN p > reached + 1 THEN reached WHEN ok THEN greatest(reached, p) ELSE least(reached, p - 1) END, CASE WHEN p > reached + 1 THEN failed WHEN NOT ok THEN p WHEN failed = p THEN 0 ELSE failed END,
  CASE WHEN p > reached + 1 THEN f.code WHEN NOT ok THEN coalesce(e.code, CASE WHEN failed = p THEN f.code END) WHEN failed = p THEN NULL ELSE f.code END FROM f JOIN e USING (user_id) WHERE e.n = f.n + 1)
SELECT user_id, reached, reached = 4 AS final_usable, ['signup', 'view', 'click', 'purchase'][reached + 1] AS failure_stage, code AS failure_code FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def lifecycle_fold(t):
    order = ["signup", "view", "click", "purchase"]
    ok, code = (F.col("value") >= 0) & (F.col("event_id") % 5 != 0), F.when(F.col("event_id") % 3 == 0, F.concat("event_type", "event_id"))
    events = t("events").select("user_id", F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("stage"), ok.alias("ok"), code.alias("code"))
    return fold_events(events, "user_id", ["ts", "seq"], order, F.date_trunc("day", "ts"))


@query("""SELECT 'positive_quantity' AS name, count(*) FILTER (WHERE NOT l_quantity > 0) AS violations, count(*) FILTER (WHERE NOT l_quantity > 0) = 0 AS holds FROM lineitem
UNION ALL SELECT 'discount_range', count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.05)), count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.05)) = 0 FROM lineitem""")
def invariant_checks(t):
    return quality.checks(t("lineitem"), [("positive_quantity", F.col("l_quantity") > 0), ("discount_range", F.col("l_discount").between(0, 0.05))])


@query("""WITH a AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, 'n' AS "column", CAST(a.n AS VARCHAR) AS "left", CAST(b.n AS VARCHAR) AS "right" FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey WHERE a.n IS DISTINCT FROM b.n""")
def result_diff(t):
    lines = t("lineitem")
    counts = lambda d: d.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return quality.result_diff(counts(lines), counts(lines.filter("l_linenumber <> 7")), ["l_suppkey"])


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def eligibility_audit(t):
    eligible = t("orders").filter("o_orderstatus = 'F'").select("o_custkey").distinct()
    return eligible.join(t("orders").filter("o_orderstatus = 'P'"), "o_custkey", "left_semi")


@query("""WITH f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), p AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
SELECT o_custkey, 'left' AS side FROM f ANTI JOIN p USING (o_custkey) UNION ALL SELECT o_custkey, 'right' FROM p ANTI JOIN f USING (o_custkey)""")
def set_difference(t):
    at = lambda p: t("orders").filter(F.col("o_orderpriority") == p)
    return quality.set_difference(at("1-URGENT"), at("5-LOW"), ["o_custkey"])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE trim(line) = '') AS empty_lines, max(length(line)) AS longest FROM l GROUP BY 1""")
def text_line_stats(t):
    return line_stats(t("documents"), "doc_id", "text")


@query("""WITH l AS (SELECT user_id, event_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id, event_id, event_type AS phase, step, CAST(epoch_us(nxt) - epoch_us(ts) AS BIGINT) AS micros FROM l WHERE nxt IS NOT NULL""")
def phase_intervals(t):
    return event_intervals(t("events"), ["user_id"], "event_type", "ts", ["ts", "event_id"], ["event_id"])


@query("""SELECT p_partkey, regexp_extract(p_type, '([^ ]+)$', 1) AS last_word, string_split(p_name, ' ')[1] AS first_word, 'Excluded by ' || p_brand || '{x}' AS info, p_brand AS excluded_by FROM part""")
def text_extracts(t):
    info = F.concat(F.lit("Excluded by "), "p_brand", F.lit("{x}"))
    return t("part").select("p_partkey", X.matched(F.col("p_type"), "([^ ]+)$").alias("last_word"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"), info.alias("info"), X.excluded_by(info).alias("excluded_by"))


@query("SELECT p_partkey, (p_size // 10 < 2 OR (p_size // 10 = 2 AND p_size % 10 < 5)) AS older FROM part")
def version_compare(t):
    version = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"))
    return t("part").select("p_partkey", X.older(version, F.lit("2.5")).alias("older"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_totals(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT page_id, md5(coalesce(html, '')) AS content, split_part(split_part(url, '//', 2), '/', 1) AS method FROM pages)
SELECT page_id, min(page_id) OVER (PARTITION BY content, method) AS representative, count(*) OVER (PARTITION BY content, method) AS class_size FROM h""")
def equivalence_classes(t):
    method = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    rows = t("pages").select("page_id", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("content"), method.alias("method"))
    return populations.equivalence_members(rows, ["content", "method"], "page_id")
