"""Reports over filter decisions and exclusions: who rejected what, how populations flow through the filters, and samples of each reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_total(counts: DataFrame, n: str = "n", pct: str = "pct") -> DataFrame:
    """Counts with their total and percentage of it; the total is one row."""
    total = counts.agg(F.sum(n).alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn(pct, F.round(F.try_divide(F.col(n) * 100.0, F.col("total")), 2))


def decision_counts(decisions: DataFrame, keys: list[str], entity: str, parts: int | None = None) -> DataFrame:
    """(*keys, accepted, deferred, rejected, entities): distinct entities by decision. An entity's decisions are united first, in ``parts`` tasks (as many as shuffles have partitions).

    Most rows are an entity's only one, so they are dealt before they are united: uniting them where they are read would hold and spill them for nothing,
    and their bytes are so few that adaptive execution would put millions into a task.
    """
    names = {"ACCEPT": "accepted", "DEFER": "deferred", "REJECT": "rejected"}
    dealt = decisions.select(*keys, entity, "decision").repartition(parts or int(decisions.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, entity)
    united = dealt.groupBy(*keys, entity).agg(*[F.coalesce(F.bool_or(F.col("decision") == d), F.lit(False)).alias(f"_{n}") for d, n in names.items()])
    known = F.col(entity).isNotNull()
    return united.groupBy(*keys).agg(*[F.count_if(known & F.col(f"_{n}")).alias(n) for n in names.values()], F.count_if(known).alias("entities"))


def with_inferred(decisions: DataFrame, inferred: list[tuple[str, str, DataFrame]], entity: str) -> DataFrame:
    """Recorded decisions and those that follow from other evidence: each (filter, reason, entities) rejects the entities that the filter has no row for."""
    out = decisions.select(entity, "filter_name", "decision", "reason_code", F.lit(False).alias("inferred"))
    for name, reason, rows in inferred:
        known = decisions.filter(F.col("filter_name") == name).select(entity).distinct()
        more = rows.select(entity).distinct().join(known, entity, "left_anti")
        out = out.union(more.select(entity, F.lit(name), F.lit("REJECT"), F.lit(reason), F.lit(True)))
    return out


def mechanism_columns(counts: DataFrame, keys: list[str], mechanisms: list[str], collapsed: dict[str, list[str]]) -> DataFrame:
    """(*keys, one column a mechanism, one a collapsed name, total) from (*keys, mechanism, n)."""
    of = lambda names: F.sum(F.when(F.col("mechanism").isin(names), F.col("n")).otherwise(0))
    return counts.groupBy(*keys).agg(*[of([m]).alias(m) for m in mechanisms], *[of(v).alias(k) for k, v in collapsed.items()], F.sum("n").alias("total"))


def filtering_flow(tests: DataFrame) -> DataFrame:
    """One row of populations in two filter rounds from tests with the flags first_rejected, analyzed, second_rejected and is_included.

    entering = first_passed + first_rejects; analyzed = second_passed + second_rejects; unreached are those that passed the
    first round and were not analyzed.
    """
    f = {n: F.coalesce(F.col(n), F.lit(False)) for n in ("first_rejected", "analyzed", "second_rejected", "is_included")}
    passed = ~f["first_rejected"]
    counts = {
        "entering": F.lit(True), "first_rejects": f["first_rejected"], "first_passed": passed, "unreached": passed & ~f["analyzed"], "analyzed_tests": passed & f["analyzed"],
        "second_rejects": passed & f["analyzed"] & f["second_rejected"], "second_passed": passed & f["analyzed"] & ~f["second_rejected"], "included": f["is_included"],
        "contradictory": f["is_included"] & (f["first_rejected"] | f["second_rejected"]),
    }
    return tests.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def filtering_evidence(entities: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """(key, evidence): included, excluded (a rejecting decision), pre_filter_failure (excluded without a decision) or unknown (neither); contradictions and repeated entities are errors.

    entities: (key, is_included).
    """
    found = decisions.groupBy(key).agg(F.bool_or(F.col("decision") == "REJECT").alias("_rejected"))
    sizes = entities.groupBy(key).agg(F.count("*").alias("_n"), F.bool_and("is_included").alias("is_included"))
    joined = sizes.join(found, key, "left")
    stop = lambda text: F.raise_error(F.concat(F.lit(text), F.col(key).cast("string"))).cast("string")
    evidence = (
        F.when(F.col("_n") > 1, stop("repeated entity "))
        .when(F.col("is_included") & F.col("_rejected"), stop("included and rejected: "))
        .when(F.col("is_included"), "included")
        .when(F.col("_rejected"), "excluded")
        .when(~F.col("is_included"), "pre_filter_failure")
        .otherwise("unknown")
    )
    return joined.select(key, evidence.alias("evidence"))


def refusals(attempts: DataFrame, code: str, allowed: list[str]) -> DataFrame:
    """(code, n, of_attempts, of_refusals) of attempts with a refusal code; a code outside the list is an error."""
    counts = attempts.groupBy(code).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("_attempts"), F.sum(F.when(F.col(code).isNotNull(), F.col("n"))).alias("_refusals"))
    known = F.when(F.col(code).isin(allowed), F.col(code)).otherwise(F.raise_error(F.concat(F.lit("unknown refusal "), F.col(code))).cast("string"))
    share = lambda c: F.round(F.try_divide(F.col("n") * 100.0, F.col(c)), 2)
    return counts.filter(F.col(code).isNotNull()).crossJoin(F.broadcast(totals)).select(known.alias(code), "n", share("_attempts").alias("of_attempts"), share("_refusals").alias("of_refusals"))


def top_reasons(rejections: DataFrame, reason: list[str], k: int) -> DataFrame:
    """The k most frequent reasons with their share of all; ties by the reason."""
    counts = rejections.groupBy(*reason).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), *reason).limit(k).crossJoin(F.broadcast(total)).withColumn("pct", F.round(F.try_divide(F.col("n") * 100.0, F.col("total")), 2))


def bucket_samples(rows: DataFrame, bucket: list[str], text: str, identity: str, k: int = 3, chars: int = 60) -> DataFrame:
    """(*bucket, n, samples): the count and up to k snippets of a bucket, chosen by a hash of the identity and joined by ' | ' in that order.

    Each bucket's candidates are cut to k in 64 slices first, so that a large bucket is not sorted by one task.
    """
    keyed = rows.withColumns({"_h": F.xxhash64(identity), "_s": F.pmod(F.xxhash64(identity, F.lit(1)), F.lit(64))})
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_h", identity))
    few = keyed.withColumn("_r", rank(*bucket, "_s")).filter(F.col("_r") <= k).withColumn("_r", rank(*bucket)).filter(F.col("_r") <= k)
    listed = few.groupBy(*bucket).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.substring(text, 1, chars).alias("_t")))), lambda x: x["_t"]), " | ").alias("samples"))
    return rows.groupBy(*bucket).agg(F.count("*").alias("n")).join(listed, bucket, "left")


def closest_projects(assertions: DataFrame, blocked: DataFrame, key: str, project: str, name: str) -> DataFrame:
    """(project, assertions, sole_blocked, name): per project and filter, the assertions that this filter alone stops; most first."""
    sole = blocked.groupBy(project, key).agg(F.countDistinct(name).alias("_n"), F.min(name).alias(name)).filter("_n = 1")
    counts = sole.groupBy(project, name).agg(F.count("*").alias("sole_blocked"))
    sizes = assertions.groupBy(project).agg(F.count("*").alias("assertions"))
    return counts.join(sizes, project).orderBy(F.desc("sole_blocked"), project, name)


def tiered(counts: DataFrame, n: str, bounds: list[tuple[int, str]], otherwise: str) -> DataFrame:
    """Rows with the label of the first bound that n reaches."""
    tier = F.coalesce(*[F.when(F.col(n) >= b, label) for b, label in bounds], F.lit(otherwise))
    return counts.withColumn("tier", tier)


def failure_columns(rows: DataFrame, keys: list[str], kind: str, allowed: list[str]) -> DataFrame:
    """(*keys, a column for each kind, total); a kind outside the list is an error."""
    known = F.when(F.col(kind).isin(allowed), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unclassified "), F.coalesce(F.col(kind), F.lit("null")))).cast("string"))
    return rows.withColumn("_k", known).groupBy(*keys).agg(*[F.count_if(F.col("_k") == a).alias(a) for a in allowed], F.count("_k").alias("total"))


def run_progress(tasks: DataFrame) -> DataFrame:
    """(stage, tasks, succeeded, failed, running, projects, seconds) of a task ledger."""
    of = lambda s: F.count_if(F.col("status") == s)
    return tasks.groupBy("stage").agg(F.count("*").alias("tasks"), of("SUCCEEDED").alias("succeeded"), of("FAILED").alias("failed"), of("IN_PROGRESS").alias("running"), F.countDistinct("project_id").alias("projects"), F.sum("runtime").alias("seconds"))


def extraction_rollup(tasks: DataFrame, codes: DataFrame) -> DataFrame:
    """(project_id, test_id, tasks, failed, failure_counts): by (project, test) and by project, whose rows have a null test_id.

    Tasks without a test are left out; failure_counts is a JSON object of the diagnostics' codes. codes: (project_id, test_id, code).
    """
    sets = [[F.col("project_id"), F.col("test_id")], [F.col("project_id")]]
    counted = tasks.filter("test_id is not null").groupingSets(sets, "project_id", "test_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    n = codes.filter("test_id is not null").groupBy("project_id", "test_id", "code").agg(F.count("*").alias("n"))
    n = n.union(n.groupBy("project_id", F.lit(None).cast("long").alias("test_id"), "code").agg(F.sum("n").alias("n")))
    listed = n.groupBy("project_id", "test_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n"))))).alias("failure_counts"))
    on = (F.col("c.project_id") == F.col("l.project_id")) & F.col("c.test_id").eqNullSafe(F.col("l.test_id"))
    return counted.alias("c").join(listed.alias("l"), on, "left").select("c.*", F.coalesce("failure_counts", F.lit("{}")).alias("failure_counts"))


def ranked_causes(rollup: DataFrame, counts: str = "failure_counts") -> DataFrame:
    """(cause, n): JSON maps of counts exploded and summed, most first."""
    return rollup.select(F.explode(F.from_json(counts, "map<string,bigint>")).alias("cause", "n")).groupBy("cause").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cause")


def level_mismatch(failures: DataFrame, environment: DataFrame, keys: list[str], wanted: str, used: str) -> DataFrame:
    """Failures with mismatch: the compiler level in use is older than the wanted one, as dotted versions; null where unknown."""
    numbers = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    return failures.join(environment, keys, "left").withColumn("mismatch", numbers(F.col(used)) < numbers(F.col(wanted)))


def funnel_by_tier(observations: DataFrame, tier: str, status: str) -> DataFrame:
    """(tier, status, n, pct of the tier): a cross-table with every tier's shares."""
    counts = observations.groupBy(tier, status).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy(tier))), 2))


def with_grand_total(rows: DataFrame, label: str, measures: list[str], name: str = "TOTAL") -> DataFrame:
    """Rows and one more with the sums under the label TOTAL; an empty input gives a total of zeros."""
    total = rows.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]).select(F.lit(name).alias(label), *measures)
    return rows.select(F.col(label).cast("string").alias(label), *measures).union(total)


def min_max_share(counts: DataFrame, group: list[str], category: str, n: str) -> DataFrame:
    """(category, min_percent, max_percent) over the groups: each category's share of its group, over the groups where it occurs."""
    share = F.try_divide(F.col(n) * 100.0, F.sum(n).over(Window.partitionBy(*group)))
    return counts.withColumn("_p", F.round(share, 2)).groupBy(category).agg(F.min("_p").alias("min_percent"), F.max("_p").alias("max_percent"))


def golden_rows(rows: DataFrame, fixture: list[str], run: str, natural: list[str]) -> DataFrame:
    """Rows of each fixture's latest run with gen_count and gen_index, numbered by natural keys and so the same for any surrogate ids."""
    latest = rows.groupBy(*fixture).agg(F.max(run).alias(run))
    kept = rows.join(latest, [*fixture, run])
    w = Window.partitionBy(*fixture)
    return kept.withColumn("gen_count", F.count("*").over(w)).withColumn("gen_index", F.row_number().over(w.orderBy(*natural)))


def coverage_shares(counts: DataFrame, whole: str, part: str) -> DataFrame:
    """Rows with uncovered and covered_share; a zero denominator gives 0."""
    return counts.withColumns({"uncovered": F.col(whole) - F.col(part), "covered_share": F.coalesce(F.round(F.try_divide(F.col(part) * 100.0, F.col(whole)), 2), F.lit(0.0))})


def flagged_rule(text: Column, families: dict[str, str]) -> Column:
    """The name of the first family whose pattern the text holds, else null."""
    return F.coalesce(*[F.when(text.rlike(p), name) for name, p in families.items()])


#: Categories of rejected parameter types, and what contradicts itself.
PARAMETER_CATEGORIES, INVALID = ["unsupported_types", "zero_parameters", "missing_declaration", "derivation_gap"], "<invalid_evidence>"


def rejections_by(rejected: DataFrame, filter_name: str, category, entity: str, k: int | None = None) -> DataFrame:
    """(category, assertions, rejected): different entities that a filter rejected under each category, and the sum over all; only the k largest, ties by category, if k is given."""
    chosen = rejected.filter(F.col("filter_name").endswith(filter_name)).select(F.coalesce(category, F.lit("<missing>")).alias("category"), entity)
    counts = chosen.groupBy("category").agg(F.countDistinct(entity).alias("assertions"))
    total = counts.agg(F.coalesce(F.sum("assertions"), F.lit(0)).alias("rejected"))  # one row
    listed = counts if k is None else counts.orderBy(F.desc("assertions"), "category").limit(k)
    return listed.crossJoin(F.broadcast(total))


def parameter_rejections(rejected: DataFrame, observations: DataFrame) -> DataFrame:
    """(category, assertions, rejected, evidence_errors) of assertions that the parameter-type filter rejected, by their only observation.

    observations: assertion_id, candidate_param_count, candidate_param_supported, resolved_parameter_types (a JSON list). No
    or several observations, some of the three missing but not all, a negative count or one that differs from the list's
    length, and supported without parameters contradict themselves.
    """
    c = F.col
    seen = observations.groupBy("assertion_id").agg(F.count("*").alias("_n"), F.min("candidate_param_count").alias("_c"), F.bool_and("candidate_param_supported").alias("_s"), F.min("resolved_parameter_types").alias("_t"))
    rows = rejected.filter(F.col("filter_name").endswith("ParameterTypeFilter")).select(F.col("entity_id").alias("assertion_id")).distinct().join(seen, "assertion_id", "left")
    missing = [c(x).isNull() for x in ("_c", "_s", "_t")]
    every, some = missing[0] & missing[1] & missing[2], missing[0] | missing[1] | missing[2]
    length = F.json_array_length("_t")
    odd = (c("_c") < 0) | length.isNull() | (length != c("_c")) | ((c("_c") == 0) & c("_s"))
    category = F.when(F.coalesce(c("_n"), F.lit(0)) != 1, INVALID).when(every, "missing_declaration").when(some | odd, INVALID).when(c("_c") == 0, "zero_parameters").when(~c("_s"), "unsupported_types").otherwise("derivation_gap")
    counts = rows.select(category.alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    wide = counts.agg(*[F.coalesce(F.sum(F.when(c("category") == x, c("n"))), F.lit(0)).alias(x) for x in [*PARAMETER_CATEGORIES, INVALID]], F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    bands = F.array(*[F.struct(F.lit(x).alias("category"), c(x).alias("assertions"), c("_all").alias("rejected"), F.col(f"`{INVALID}`").alias("evidence_errors")) for x in PARAMETER_CATEGORIES])
    return wide.select(F.inline(bands))
