"""The review chain: populations, strata by rule, seeded samples of exact size, reviewers' decisions and their agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tiers from strong to none, states, strata of weak mappings.
TIERS = ["T1_PROVEN", "T2_CORROBORATED", "T3_SINGLE_WEAK", "T4_GUESS", "NONE"]
UNRESOLVED = "unresolved"
STRATA = ["t3-single-weak", "t4-guess", "no-visible-call", "unresolved-source-declaration", "ambiguous-high-confidence"]
SIZES = [(1, "one-per-project"), (5, "two-to-five-per-project"), (20, "six-to-twenty-per-project")]
LARGEST = "more-than-twenty-per-project"
#: Slices of a stratum that are cut to the wanted number before the stratum is sorted.
SLICES = 256


def no_assertion_population(tests: DataFrame, results: DataFrame, assertions: DataFrame, eligible: DataFrame) -> DataFrame:
    """Tests (id, project_id) of eligible projects that the filter for missing assertions rejected, with the number of their assertions on record (a row each result)."""
    rejected = results.filter(F.col("filter_name").like("%NoAssertionsFilter") & (F.col("decision") == "REJECT")).select(F.col("entity_id").alias("id"), "reason_code")
    counts = assertions.groupBy(F.col("test_id").alias("id")).agg(F.count("*").alias("_n"))
    chosen = tests.join(eligible.select("project_id").distinct(), "project_id", "left_semi")
    return chosen.join(rejected, "id").join(counts, "id", "left").withColumn("recorded_assertions", F.coalesce("_n", F.lit(0))).drop("_n")


def size_stratum(rows: DataFrame, project: str) -> DataFrame:
    """Rows with ``stratum``: how many of them their project has. Counts are joined back, so that a large project is no window."""
    counts = rows.groupBy(project).agg(F.count("*").alias("_n"))
    name = F.lit(LARGEST)
    for most, label in reversed(SIZES):
        name = F.when(F.col("_n") <= most, label).otherwise(name)
    return rows.join(counts, project).withColumn("stratum", name).drop("_n")


def mapping_stratum() -> Column:
    """The stratum of a mapping (no_pick_reason, resolution_status, confidence_tier, candidate_count) whose evidence is weak or ambiguous; null for others."""
    tier, reason = F.col("confidence_tier"), F.col("no_pick_reason")
    resolved = F.col("resolution_status") == "RESOLVED"
    several = tier.isin("T1_PROVEN", "T2_CORROBORATED") & (F.col("candidate_count") > 1)
    return (
        F.when(reason == "NO_VISIBLE_CALL", "no-visible-call").when(reason == "UNRESOLVED_SOURCE_DECLARATION", "unresolved-source-declaration")
        .when(resolved & (tier == "T3_SINGLE_WEAK"), "t3-single-weak").when(resolved & (tier == "T4_GUESS"), "t4-guess").when(resolved & several, "ambiguous-high-confidence")
    )


def sufficient() -> Column:
    """Whether a mapping's evidence is enough for a specification."""
    named = F.col("resolved_call_source").isNotNull() & F.col("resolved_method_name").isNotNull() & F.col("resolved_declaring_type").isNotNull()
    return F.coalesce((F.col("resolution_status") == "RESOLVED") & F.col("confidence_tier").isin("T1_PROVEN", "T2_CORROBORATED") & named, F.lit(False))


def rule_sample(rows: DataFrame, stratum: str, identity: list[str], allocation: dict[str, int], seed: str) -> DataFrame:
    """(stratum, *identity, selection_sha256, stratum_size): in each stratum the wanted number of rows of the smallest SHA-256 of seed and identity.

    Rows without a stratum take no part. A stratum with fewer rows than wanted, and a stratum without an allocation, are
    errors at the call. Candidates are first cut in each of 256 slices of the hash, so that no stratum is sorted by one task.
    """
    named = rows.filter(F.col(stratum).isNotNull())
    sizes = {r[0]: r[1] for r in named.groupBy(stratum).agg(F.count("*")).limit(len(allocation) + 1).collect()}  # a row a stratum
    if unknown := sorted(set(sizes) - set(allocation)):
        raise ValueError(f"no allocation for {unknown[0]}")
    for name, wanted in allocation.items():
        if sizes.get(name, 0) < wanted:
            raise ValueError(f"stratum {name} has {sizes.get(name, 0)} rows; review requires {wanted}")
    rank = F.sha2(F.concat(F.lit(seed), F.to_json(F.array(*[F.col(c).cast("string") for c in identity]))), 256)
    numbers = F.create_map(*[F.lit(x) for kv in allocation.items() for x in kv])
    keyed = named.select(F.col(stratum).alias("stratum"), *identity, rank.alias("selection_sha256")).withColumn("_w", numbers[F.col("stratum")])
    order = [F.col("selection_sha256"), *[F.col(c) for c in identity]]
    cut = keyed.withColumn("_slice", F.substring("selection_sha256", 1, 2)).withColumn("_r", F.row_number().over(Window.partitionBy("stratum", "_slice").orderBy(*order))).filter("_r <= _w")
    chosen = cut.withColumn("_r", F.row_number().over(Window.partitionBy("stratum").orderBy(*order))).filter("_r <= _w")
    known = F.create_map(*[F.lit(x) for n in allocation for x in (n, sizes.get(n, 0))])
    return chosen.select("stratum", *identity, "selection_sha256", known[F.col("stratum")].cast("long").alias("stratum_size"))


def decision_issues(population: DataFrame, decisions: DataFrame, identity: list[str], statuses: dict[str, str]) -> DataFrame:
    """(issue, evidence) of decisions (identity, reviewer, label, rationale, confidence, source_ids) that may not be adjudicated."""
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in identity], F.coalesce("reviewer", F.lit("<null>")))
    status = F.try_element_at(F.create_map(*[F.lit(x) for kv in statuses.items() for x in kv]), F.col("label"))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    sources = F.coalesce(F.exists("source_ids", lambda x: F.coalesce(x == "", F.lit(True))) | (F.size(F.array_distinct("source_ids")) < F.size("source_ids")), F.lit(True))
    checks = [
        (blank("reviewer"), "no reviewer"), (status.isNull(), "unknown label"), (blank("rationale"), "no rationale"), (~F.coalesce(F.col("confidence").isin(TIERS), F.lit(False)), "unknown confidence"),
        (F.coalesce((status != "resolved") & (F.col("confidence") != "NONE"), F.lit(False)), "confidence without resolution"), (sources, "invalid source ids"),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(issue)) for c, issue in checks]), lambda x: x.isNotNull())
    single = decisions.select(F.explode(found).alias("issue"), name.alias("evidence"))
    strange = decisions.join(population.select(*identity), identity, "left_anti").select(F.lit("decision outside the population").alias("issue"), name.alias("evidence"))
    twice = decisions.groupBy(*identity, "reviewer").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.lit("duplicate reviewer decision").alias("issue"), name.alias("evidence"))
    repeated = population.groupBy(*identity).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.lit("repeated identity").alias("issue"), F.concat_ws(":", *[F.col(c).cast("string") for c in identity]).alias("evidence"))
    return single.union(strange).union(twice).union(repeated)


def adjudicated(population: DataFrame, decisions: DataFrame, identity: list[str], statuses: dict[str, str]) -> DataFrame:
    """One row for each of the population: (*identity, status, label, confidence, rationale, source_ids, reviewers, review_state).

    One or more equal labels stand, with the last of TIERS that a reviewer gave; different labels leave the entity unresolved and
    disputed, no decision unresolved and unreviewed. Source ids are united and sorted. Decisions have passed decision_issues().
    """
    place = F.array_position(F.array(*map(F.lit, TIERS)), F.col("confidence"))
    grouped = decisions.groupBy(*identity).agg(
        F.count("*").alias("reviewers"), F.min("label").alias("_low"), F.max("label").alias("_high"), F.max(place).alias("_tier"), F.first("rationale").alias("_why"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("_sources")
    )
    rows = population.select(*identity).join(grouped, identity, "left")
    none, same = F.col("reviewers").isNull(), F.col("_low") == F.col("_high")
    status = F.try_element_at(F.create_map(*[F.lit(x) for kv in statuses.items() for x in kv]), F.col("_low"))
    why = F.when(none, "No reviewer decision is available.").when(~same, "Reviewer decisions disagree; individual decisions are preserved.").when(F.col("reviewers") == 1, F.col("_why")).otherwise("Reviewer decisions agree.")
    state = F.when(none, "unreviewed").when(~same, "disputed").when(F.col("reviewers") == 1, "single-reviewed").otherwise("agreed")
    return rows.select(
        *identity, F.when(same, status).otherwise(UNRESOLVED).alias("status"), F.when(same, F.col("_low")).otherwise(UNRESOLVED).alias("label"), F.when(same, F.element_at(F.array(*map(F.lit, TIERS)), F.col("_tier").cast("int"))).otherwise("NONE").alias("confidence"),
        why.alias("rationale"), F.coalesce("_sources", F.array().cast("array<string>")).alias("source_ids"), F.coalesce("reviewers", F.lit(0)).alias("reviewers"), state.alias("review_state"),
    )


def outcome_counts(entities: DataFrame) -> DataFrame:
    """(claim, status, outcome, reviewed_count) of reviewed entities (claim, status, label)."""
    return entities.groupBy("claim", "status", F.col("label").alias("outcome")).agg(F.count("*").alias("reviewed_count"))


def read_audit(spark, path) -> DataFrame:
    """(claim, status, label) of the ``entities`` of audit documents, one JSON object a file; a document without a list of entities is an error."""
    documents = spark.read.option("multiLine", True).schema("entities array<struct<claim string, status string, label string>>").json(path)
    listed = F.when(F.col("entities").isNull(), F.raise_error(F.lit("audit without a list of entities")).cast("array<struct<claim string, status string, label string>>")).otherwise(F.col("entities"))
    return documents.select(F.inline(listed))
