"""What excluded an entity: evidence of six tables brought to one row an entity, exactly one mechanism each, and the issues that forbid it.

Filter results, tasks and the three levels of entities are brought to the key (level, entity_id) first; their flags are
aggregated in one grouping and joined once, whatever the number of evidence kinds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels, producers, codes, mechanisms and issues.
LEVELS = {"Test": "test_id", "Assertion": "assertion_id", "Generalization": "generalization_id"}
FILTER_CLASS, QUARANTINE = r"filter\.\w+Filter$", "GeneratedTestValidator"
GATE_CODES = ["INPUT_SPEC_NOT_SATISFIED_BY_SEED", "ORACLE_NOT_WIDENABLE"]
QUARANTINE_CODES = ["UNCOMPILABLE_GENERALIZED_TEST", "UNCOMPILABLE_INSTRUMENTED_WRAPPER"]
CAPABILITY_CODES = ["INHERITED_METHOD_NOT_FLATTENABLE"]
DECISIONS = ["ACCEPT", "DEFER", "REJECT"]
MECHANISMS = ["included", "generation_gate", "filter_rejection", "build_quarantine", "inherited_test_inlining_limit", "task_exception"]


def _is(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(values), F.lit(False))


def filter_evidence(results: DataFrame) -> DataFrame:
    """Filter results (id, project_id, test_id, assertion_id, generalization_id, filter_name, decision, reason_code) with level, entity_id, identities (how many ids are set) and mechanism of the producer (null: unknown)."""
    ids = [F.col(c) for c in LEVELS.values()]
    level = reduce(lambda c, kv: c.when(F.col(kv[1]).isNotNull(), kv[0]), LEVELS.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    producer = F.when(F.col("filter_name").rlike(FILTER_CLASS), "filter_rejection").when(F.col("filter_name") == QUARANTINE, "build_quarantine")
    return results.withColumns({"level": level, "entity_id": F.coalesce(*ids), "identities": sum((c.isNotNull().cast("int") for c in ids), F.lit(0)), "producer_mechanism": producer})


def entities(tests: DataFrame, assertions: DataFrame, generalizations: DataFrame, lifecycle: DataFrame, eligible: DataFrame | None, variant: str | None) -> DataFrame:
    """(level, project_id, entity_id, is_included, code, stopped, created) of all three levels; of generalizations those of one variant, included if their filter passed.

    Entities: id, project_id, is_included and exclusion_info; its code is what stands before the first colon. lifecycle:
    generalization_id, generated_filter_passed, generated_source_created, final_failure_stage.
    """
    code = F.split_part(F.col("exclusion_info"), F.lit(":"), F.lit(1)).alias("code")
    none = [F.lit(False).alias("stopped"), F.lit(False).alias("created")]
    level = lambda rows, name: rows.select(F.lit(name).alias("level"), "project_id", F.col("id").alias("entity_id"), F.coalesce("is_included", F.lit(False)).alias("is_included"), code, *none)
    chosen = generalizations if variant is None else generalizations.filter(F.col("variant") == variant)
    life = chosen.join(lifecycle.withColumnRenamed("generalization_id", "id"), "id", "left")
    g = life.select(F.lit("Generalization").alias("level"), "project_id", F.col("id").alias("entity_id"), F.coalesce("generated_filter_passed", F.lit(False)).alias("is_included"), code, F.col("final_failure_stage").isNotNull().alias("stopped"), F.coalesce("generated_source_created", F.lit(False)).alias("created"))
    out = level(tests, "Test").unionByName(level(assertions, "Assertion")).unionByName(g)
    return out if eligible is None else out.join(eligible.select("project_id").distinct(), "project_id", "left_semi").select(out.columns)


def mechanism_candidates(rows: DataFrame, results: DataFrame, tasks: DataFrame) -> DataFrame:
    """entities() with ``candidates``: every mechanism that has evidence for the entity, in the order of MECHANISMS.

    A task belongs to the deepest entity that it names. What a filter rejected, a validator quarantined or a code explains is no
    task exception.
    """
    found = filter_evidence(results).filter("level is not null").select("level", "entity_id", F.expr("decision = 'REJECT' and producer_mechanism = 'filter_rejection'").alias("_r"), F.expr("producer_mechanism = 'build_quarantine'").alias("_q"), F.lit(False).alias("_t"))
    owner = F.when(F.col("generalization_id").isNotNull(), "Generalization").when(F.col("assertion_id").isNotNull(), "Assertion").when(F.col("test_id").isNotNull(), "Test")
    failed = tasks.filter("status <> 'SUCCEEDED'").select(owner.alias("level"), F.coalesce("generalization_id", "assertion_id", "test_id").alias("entity_id"), F.lit(False).alias("_r"), F.lit(False).alias("_q"), F.lit(True).alias("_t")).filter("level is not null")
    flags = found.union(failed).groupBy("level", "entity_id").agg(*[F.bool_or(c).alias(c) for c in ("_r", "_q", "_t")])
    joined = rows.join(flags, ["level", "entity_id"], "left")
    rejected, quarantined, failed_task = (F.coalesce(F.col(c), F.lit(False)) for c in ("_r", "_q", "_t"))
    test, generalization = F.col("level") == "Test", F.col("level") == "Generalization"
    coded, code = _is(F.col("code"), QUARANTINE_CODES), F.col("code")
    gated, limited = generalization & _is(code, GATE_CODES), test & _is(code, CAPABILITY_CODES)
    blamed = failed_task | F.coalesce(code.startswith("Excluded by"), F.lit(False)) | F.col("stopped")
    unexplained = ~rejected & ~quarantined & ~coded & ~gated & ~limited
    holds = {
        "included": F.when(generalization, F.col("is_included")).otherwise(F.col("is_included") & ~failed_task),
        "generation_gate": gated,
        "filter_rejection": rejected,
        "build_quarantine": quarantined | coded,
        "inherited_test_inlining_limit": limited,
        "task_exception": blamed & unexplained & ~(generalization & F.col("is_included")),
    }
    candidates = F.filter(F.array(*[F.when(holds[m], m) for m in MECHANISMS]), lambda x: x.isNotNull())
    return joined.withColumn("candidates", candidates).drop("_r", "_q", "_t")


def mechanism_partition(candidates: DataFrame) -> DataFrame:
    """mechanism_candidates() with ``mechanism``: the only candidate, or null without evidence. An entity with two is an error."""
    named = F.concat_ws(":", "level", F.col("entity_id").cast("string"), F.array_join("candidates", ","))
    single = F.when(F.size("candidates") > 1, F.raise_error(F.concat(F.lit("multiply classified entity: "), named)).cast("string")).otherwise(F.try_element_at("candidates", F.lit(1)))
    return candidates.withColumn("mechanism", single).drop("candidates")


def mechanism_table(partition: DataFrame) -> DataFrame:
    """(level, total, one count for each mechanism, unclassified): every level's entities by their mechanism."""
    counts = [F.count_if(F.col("mechanism") == m).alias(m) for m in MECHANISMS]
    return partition.groupBy("level").agg(F.count("*").alias("total"), *counts, F.count_if(F.col("mechanism").isNull()).alias("unclassified"))


def collapsed(partition: DataFrame) -> DataFrame:
    """(level, included, filtered, failed): the three ways that matter to readers; entities without evidence are in none."""
    ways = {"included": ["included"], "filtered": ["generation_gate", "filter_rejection"], "failed": ["build_quarantine", "inherited_test_inlining_limit", "task_exception"]}
    return partition.groupBy("level").agg(*[F.count_if(_is(F.col("mechanism"), ms)).alias(n) for n, ms in ways.items()])


def _each(rows: DataFrame, issues: list[tuple[Column, str, Column]]) -> DataFrame:
    """(issue, evidence): one row for each issue that holds, in one pass over the rows."""
    listed = F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("issue"), text.alias("evidence"))) for holds, name, text in issues])
    return rows.select(F.inline(F.filter(listed, lambda x: x.isNotNull())))


def evidence_issues(results: DataFrame, rows: DataFrame, candidates: DataFrame, test_methods: DataFrame, expected: DataFrame) -> DataFrame:
    """(issue, evidence): everything by which the evidence contradicts itself; no rows mean that it may be reported.

    results: filter results; rows: entities() of all projects and variants; candidates: mechanism_candidates(); test_methods: entity_id,
    declaring_type (null: not parsed) and class_name; expected: (level, entity_id, filter_name) pairs that must have a decision.
    """
    text = lambda *parts: F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("<null>")) for p in parts])
    c, code, level = F.col, F.col("code"), F.col("level")
    known = filter_evidence(results)
    of_results = _each(known, [
        (c("identities") != 1, "invalid filter-result identity", text(F.lit("filter_result"), c("id"))),
        (~_is(c("decision"), DECISIONS), "invalid filter-result decision", text(F.lit("filter_result"), c("id"), c("decision"))),
        ((c("decision") == "REJECT") & c("reason_code").isNull(), "missing filter-result rejection reason", text(F.lit("filter_result"), c("id"), c("filter_name"))),
        (c("producer_mechanism").isNull(), "unknown filter-result producer", text(F.lit("filter_result"), c("id"), c("filter_name"))),
        ((c("filter_name") == QUARANTINE) & ((c("decision") != "REJECT") | ~_is(c("reason_code"), QUARANTINE_CODES)), "invalid build-quarantine verdict", text(F.lit("filter_result"), c("id"), c("decision"), c("reason_code"))),
    ])
    entity = text(level, c("entity_id"))
    typed = code.isNotNull() & ~code.startswith("Excluded by")
    wrong = (_is(code, GATE_CODES) & (level != "Generalization")) | (_is(code, QUARANTINE_CODES) & (level == "Test")) | (_is(code, CAPABILITY_CODES) & (level != "Test"))
    of_entities = _each(rows, [
        (_is(code, GATE_CODES) & (level == "Generalization") & c("created"), "pre-emission rejection created source", text(level, c("entity_id"), code)),
        (typed & ~_is(code, GATE_CODES + QUARANTINE_CODES + CAPABILITY_CODES), "unknown typed exclusion code", text(level, c("entity_id"), code)),
        (typed & wrong, "typed exclusion code at invalid level", text(level, c("entity_id"), code)),
    ])
    inherited = rows.filter((level == "Test") & _is(code, CAPABILITY_CODES)).join(test_methods.filter("declaring_type <> class_name").select("entity_id"), "entity_id", "left_anti")
    undecided = expected.join(known.filter("decision is not null").select("level", "entity_id", "filter_name").distinct(), ["level", "entity_id", "filter_name"], "left_anti")
    out = [
        of_results, of_entities,
        _each(test_methods, [(c("declaring_type").isNull(), "unparsed test method path", text(F.lit("Test"), c("entity_id")))]),
        _each(inherited, [(F.lit(True), "inherited-method exclusion without inherited path", entity)]),
        _each(undecided, [(F.lit(True), "incomplete proactive filter decision", text(level, c("filter_name"), c("entity_id")))]),
        _each(candidates, [(F.size("candidates") == 0, "unclassified entity", F.concat(entity, F.lit(":"))), (F.size("candidates") > 1, "multiply classified entity", F.concat(entity, F.lit(":"), F.array_join("candidates", ",")))]),
    ]
    return reduce(DataFrame.unionByName, out)


def require_evidence(issues: DataFrame, shown: int = 20) -> None:
    """An error that names the first issues in order, if there are any."""
    rows = issues.orderBy("issue", "evidence").limit(shown).collect()
    if rows:
        raise ValueError("; ".join(f"{r.issue}={r.evidence}" for r in rows))
