"""The composite operators bound to tables, and the same questions in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import marts, populations
from .queries import query


@query("""SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(urgent, 0) AS urgent, coalesce(open_lines, 0) AS open_lines, coalesce(returned, 0) AS returned, coalesce(errors, 0) AS errors FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS orders, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey
LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1) e ON user_id = c_custkey""")
def entity_signals(t):
    orders = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    lines = t("lineitem").join(orders.select("o_orderkey", "c_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return marts.signals(
        t("customer").select("c_custkey"),
        "c_custkey",
        [
            (orders, {"orders": F.count("*"), "urgent": F.count_if(F.col("o_orderpriority") == "1-URGENT")}),
            (lines, {"open_lines": F.count_if(F.col("l_linestatus") == "O"), "returned": F.count_if(F.col("l_returnflag") == "R")}),
            (t("events").withColumnRenamed("user_id", "c_custkey"), {"errors": F.count_if(F.col("event_type") == "error")}),
        ],
    )


@query("""WITH b AS (SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), a AS (SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
j AS (SELECT coalesce(b.l_suppkey, a.l_suppkey) AS l_suppkey, coalesce(b.q, 0) AS q_before, coalesce(a.q, 0) AS q_after FROM b FULL JOIN a ON a.l_suppkey = b.l_suppkey)
SELECT *, q_after - q_before AS q_delta, CASE WHEN q_before <> 0 THEN round((q_after - q_before) * 100.0::DOUBLE / q_before, 2) END AS q_pct FROM j""")
def suite_effects(t):
    lines = t("lineitem").select("l_suppkey", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    return marts.effects(lines.filter("l_linestatus = 'F'"), lines.filter("l_linestatus = 'O'"), ["l_suppkey"], ["q"])


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT c.user_id, c.event_type, c.n, CASE WHEN b.n > 0 THEN c.n - b.n ELSE 0 END AS absolute, CASE WHEN b.n > 0 THEN round((c.n - b.n) * 100.0::DOUBLE / b.n, 2) ELSE 0 END AS relative
FROM c LEFT JOIN c b ON b.user_id = c.user_id AND b.event_type = 'view' WHERE c.event_type <> 'view'""")
def detection_improvement(t):
    return marts.improvement(t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], "event_type", "view", "n")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"SELECT o_custkey, o_orderpriority FROM (SELECT DISTINCT o_custkey FROM orders), (SELECT unnest({PRIORITIES}) AS o_orderpriority) EXCEPT SELECT o_custkey, o_orderpriority FROM orders")
def matrix_completeness(t):
    return marts.missing_cells(t("orders"), "o_custkey", "o_orderpriority", PRIORITIES)


@query("""WITH p AS (SELECT user_id, value < 20 AS failed, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END AS pos FROM events),
f AS (SELECT user_id, count(DISTINCT pos) AS n, min(pos) FILTER (WHERE failed) AS first FROM p GROUP BY 1)
SELECT user_id, CASE WHEN first IS NOT NULL THEN 'failed' WHEN n = 3 THEN 'complete' ELSE 'not_reached' END AS status, CASE first WHEN 0 THEN 'signup' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' END AS first_failed FROM f""")
def ledger_status(t):
    return marts.ledger(t("events"), "user_id", "event_type", F.col("value") < 20, ["signup", "view", "purchase"])


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'P' WHEN bool_or(o_orderstatus = 'O') THEN 'O' ELSE 'unobserved' END AS o_orderstatus FROM orders GROUP BY 1""")
def outcome_precedence(t):
    return marts.outcome_precedence(t("orders"), ["o_custkey"], "o_orderstatus", ["P", "O"])


@query("""SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) ELSE 'disputed' END AS l_returnflag, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN max(l_linenumber) END AS l_linenumber, count(*) AS reviews FROM lineitem GROUP BY 1""")
def review_adjudication(t):
    return marts.adjudicate(t("lineitem"), "l_orderkey", "l_returnflag", "l_linenumber")


@query("""WITH r AS (SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1)
SELECT source, docs::DOUBLE AS docs, chars::DOUBLE AS chars FROM r UNION ALL SELECT 'total', sum(docs)::DOUBLE, sum(chars)::DOUBLE FROM r
UNION ALL SELECT 'mean', round(avg(docs), 2), round(avg(chars), 2) FROM r UNION ALL SELECT 'median', round(median(docs), 2), round(median(chars), 2) FROM r""")
def dataset_statistics(t):
    return marts.statistics_rows(t("documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")), "source", ["docs", "chars"])


@query("""SELECT l_linestatus AS variant, o_orderstatus AS owner_variant, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> o_orderstatus GROUP BY 1, 2""")
def variant_isolation(t):
    reports = t("lineitem").select("l_orderkey", F.col("l_linestatus").alias("variant"))
    return marts.crossed_references(reports, t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("variant")), "l_orderkey", "variant")


@query("""WITH c AS (SELECT CASE WHEN text LIKE '%license%' THEN 'LICENSE' WHEN text LIKE '%@%' THEN 'ADDRESS' WHEN text LIKE '%http%' THEN 'LINK' ELSE 'OTHER' END AS cause FROM documents)
SELECT cause, count(*) AS n FROM c GROUP BY 1""")
def text_cause_categories(t):
    cause = X.ordered_rules([(F.col("text").contains("license"), "LICENSE"), (F.col("text").contains("@"), "ADDRESS"), (F.col("text").contains("http"), "LINK")])
    return t("documents").groupBy(F.coalesce(cause, F.lit("OTHER")).alias("cause")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS users, CAST(sum(n) AS BIGINT) AS events, max(n) AS most, median(n) AS median, round(sum(n) * 100.0::DOUBLE / (SELECT count(*) FROM events), 2) AS pct FROM s GROUP BY 1""")
def variant_summary(t):
    sizes = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    summary = sizes.groupBy("event_type").agg(F.count("*").alias("users"), F.sum("n").alias("events"), F.max("n").alias("most"), F.median("n").alias("median"))
    whole = summary.agg(F.sum("events").alias("_all"))  # one row, summed over the variants
    return summary.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one").select("event_type", "users", "events", "most", "median", marts.percent(F.col("events"), F.col("_all")).alias("pct"))


@query("""WITH g AS (SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS rejected, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS accepted FROM orders)
SELECT CASE WHEN rejected THEN 'excluded' WHEN accepted THEN 'included' ELSE 'unknown' END AS evidence, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 2) AS pct FROM g GROUP BY 1""")
def filtering_evidence(t):
    lines = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    flagged = populations.with_flag(t("orders").select("o_orderkey"), ["o_orderkey"], lines.filter("l_returnflag = 'R'"), "rejected")
    flagged = populations.with_flag(flagged, ["o_orderkey"], lines.filter("l_returnflag = 'A'"), "accepted")
    counts = flagged.groupBy(F.when(F.col("rejected"), "excluded").when(F.col("accepted"), "included").otherwise("unknown").alias("evidence")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_all")).withColumn("_one", F.lit(1))  # one row
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").select("evidence", "n", marts.percent(F.col("n"), F.col("_all")).alias("pct"))
