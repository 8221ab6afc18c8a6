"""Project and generalization funnels: evidence per project, nested populations, causes of exclusion, and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_level(tasks: DataFrame) -> DataFrame:
    """Tasks of the project as a whole: no test, assertion or generalization."""
    return tasks.filter("test_id is null and assertion_id is null and generalization_id is null")


def finished_projects(tasks: DataFrame, required: list[str], ignored: list[str] = ()) -> DataFrame:
    """(project_id): projects all of whose project-level tasks outside ``ignored`` succeeded and that reached one of the required stages."""
    counted = project_level(tasks).filter(~F.col("stage").isin(list(ignored))) if ignored else project_level(tasks)
    agg = counted.groupBy("project_id").agg(F.bool_and(F.col("status") == "SUCCEEDED").alias("_all"), F.bool_or(F.col("stage").isin(required)).alias("_reached"))
    return agg.filter("_all and _reached").select("project_id")


def project_failures(tasks: DataFrame) -> DataFrame:
    """(project_id, step, stage, variant, id): each project's first failed project-level task by step, then id."""
    failed = project_level(tasks).filter("status = 'FAILED'")
    first = failed.groupBy("project_id").agg(F.min_by(F.struct("step", "stage", "variant", "id"), F.struct("step", "id")).alias("_f"))
    return first.select("project_id", "_f.*")


def failure_summary(failures: DataFrame) -> DataFrame:
    """(step, stage, failures) of project_failures()."""
    return failures.groupBy("step", "stage").agg(F.count("*").alias("failures"))


def project_signals(projects: DataFrame, tasks: DataFrame, tests: DataFrame, assertions: DataFrame, generalizations: DataFrame, decisions: DataFrame, reports: DataFrame, mutations: DataFrame, evaluation: list[str]) -> DataFrame:
    """One row a project with counts and flags from every table; absent evidence is 0 or false.

    Each table is aggregated by project before it is joined, so that no join multiplies. decisions: (project_id, level, decision).
    """
    whole = project_level(tasks)
    included = lambda n: [F.count("*").alias(f"{n}"), F.count_if("is_included").alias(f"included_{n}")]
    stage = lambda s: F.bool_or((F.col("stage") == s) & (F.col("status") == "SUCCEEDED"))
    frames = [
        (tests.groupBy("project_id").agg(*included("tests"), F.countDistinct("class_name").alias("test_classes")), ["tests", "included_tests", "test_classes"]),
        (assertions.groupBy("project_id").agg(*included("assertions"), F.countDistinct("test_id").alias("asserting_tests")), ["assertions", "included_assertions", "asserting_tests"]),
        (generalizations.groupBy("project_id").agg(*included("generalizations"), F.countDistinct("variant").alias("variants")), ["generalizations", "included_generalizations", "variants"]),
        (decisions.groupBy("project_id").agg(*[F.count_if((F.col("level") == x) & (F.col("decision") == "REJECT")).alias(f"rejected_{x}") for x in ("test", "assertion", "generalization")]), [f"rejected_{x}" for x in ("test", "assertion", "generalization")]),
        (reports.groupBy("project_id").agg(F.count("*").alias("test_reports"), F.count_if(F.col("result") != "PASSED").alias("non_passing_reports")), ["test_reports", "non_passing_reports"]),
        (mutations.groupBy("project_id").agg(F.count("*").alias("mutation_reports"), F.count_if("is_detected").alias("detected_reports"), F.countDistinct("mutation_id").alias("mutants")), ["mutation_reports", "detected_reports", "mutants"]),
        (tasks.groupBy("project_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "FAILED").alias("failed_tasks"), F.count_if((F.col("status") == "FAILED") & F.col("stage").isin(evaluation)).alias("failed_evaluations")), ["tasks", "failed_tasks", "failed_evaluations"]),
        (whole.groupBy("project_id").agg(F.count("*").alias("project_tasks"), F.count_if(F.col("status") == "FAILED").alias("failed_project_tasks"), F.max("step").alias("last_step")), ["project_tasks", "failed_project_tasks"]),
    ]
    flags = whole.groupBy("project_id").agg(*[stage(s).alias(f"reached_{s.lower()}") for s in evaluation])
    out = projects.select(F.col("id").alias("project_id"))
    for frame, zero in frames:
        out = out.join(frame, "project_id", "left").fillna(0, zero)
    names = [c for c in flags.columns if c != "project_id"]
    return out.join(flags, "project_id", "left").fillna(False, names)


def funnel_bands(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(position, stage, entering, surviving, excluded, broken): one aggregation; broken counts rows that hold a later stage without an earlier one."""
    sums, alive, n = [F.count("*").alias("_0")], F.lit(True), len(stages)
    for i, (_, holds) in enumerate(stages, 1):
        holds = F.coalesce(holds, F.lit(False))
        sums += [F.count_if(holds & ~alive).alias(f"_b{i}")]
        alive = alive & holds
        sums += [F.count_if(alive).alias(f"_{i}")]
    bands = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(stages[i - 1][0]).alias("stage"), F.col(f"_{i - 1}").alias("entering"), F.col(f"_{i}").alias("surviving"), (F.col(f"_{i - 1}") - F.col(f"_{i}")).alias("excluded"), F.col(f"_b{i}").alias("broken")) for i in range(1, n + 1)])
    return rows.agg(*sums).select(F.inline(bands))


def require_nested(bands: DataFrame) -> DataFrame:
    """The bands; a band with broken rows is an error."""
    checked = F.when(F.col("broken") > 0, F.raise_error(F.concat(F.lit("populations are not nested at "), F.col("stage"))).cast("bigint")).otherwise(F.col("broken"))
    return bands.withColumn("broken", checked)


def excluded_with_cause(rows: DataFrame, key: str, stages: list[tuple[str, Column]], failures: DataFrame, fallback: list[tuple[Column, str]], otherwise: str = "UNEXPLAINED") -> DataFrame:
    """(key, stage, cause): the first stage that a row does not survive, and its earliest failure's code there, else the first fallback rule that holds.

    failures: (key, stage, ordinal, code).
    """
    lost = F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in stages])
    gone = rows.withColumn("stage", lost).filter("stage is not null")
    first = failures.groupBy(key, "stage").agg(F.min_by("code", F.struct("ordinal", "code")).alias("_code"))
    rule = reduce(lambda c, r: c.when(r[0], r[1]), fallback, F.when(F.lit(False), F.lit(None).cast("string")))
    return gone.join(first, [key, "stage"], "left").select(key, "stage", F.coalesce("_code", rule, F.lit(otherwise)).alias("cause"))


def cause_counts(causes: DataFrame, order: dict[str, int]) -> DataFrame:
    """(stage, position, cause, n), ordered by stage, falling count and cause."""
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("stage"))
    return causes.groupBy("stage", "cause").agg(F.count("*").alias("n")).withColumn("position", place).orderBy("position", F.desc("n"), "cause")


def grouped_causes(causes: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rows with the reader's label of their cause; an unmapped cause is an error."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("cause"))
    return causes.withColumn("label", F.coalesce(known, F.raise_error(F.concat(F.lit("no label for "), F.col("cause"))).cast("string")))


def conserved(bands: DataFrame) -> DataFrame:
    """(name, violations, holds): what leaves a band enters the next, and nothing is negative."""
    both = bands.alias("a").join(bands.alias("b"), F.col("b.position") == F.col("a.position") + 1, "left")
    wrong = (F.coalesce(F.col("a.surviving") != F.col("b.entering"), F.lit(False))) | (F.col("a.excluded") < 0) | (F.col("a.entering") != F.col("a.surviving") + F.col("a.excluded"))
    return both.agg(F.count_if(wrong).alias("violations")).select(F.lit("bands are conserved").alias("name"), "violations", (F.col("violations") == 0).alias("holds"))


def reconciled(decisions: DataFrame, keys: list[str], rejected: DataFrame) -> DataFrame:
    """(*keys, total, accepted, deferred, rejected, listed, holds): decisions add up, and as many entities are listed as rejected as were rejected."""
    kinds = decisions.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col("decision") == d).alias(n) for d, n in (("ACCEPT", "accepted"), ("DEFER", "deferred"), ("REJECT", "rejected"))])
    listed = rejected.groupBy(*keys).agg(F.count("*").alias("listed"))
    joined = kinds.join(listed, keys, "left").fillna(0, ["listed"])
    return joined.withColumn("holds", (F.col("total") == F.col("accepted") + F.col("deferred") + F.col("rejected")) & (F.col("rejected") == F.col("listed")))


#: The nested populations of generalization attempts, in order.
POPULATIONS = ["attempted", "emitted", "filter_result_recorded", "filter_passed", "validated", "reduced", "final_usable"]
#: Gates whose exclusions are known by themselves; at the others a failure must have been attempted.
SELF_EVIDENT = ["emitted", "filter_passed", "validated", "final_usable"]
FILTER_CLASS = r"filter\.\w+Filter$"


def attempted_stages(rows: DataFrame, key: str, tasks: DataFrame) -> DataFrame:
    """(key): rows (key, project_id, stage, variant) for which some task of the project has that stage, and no variant or the row's.

    The "or" over the variant is a union of two equi-joins' keys. Rows without a stage are not among them.
    """
    seen = tasks.select("project_id", "stage", "variant").distinct()
    plain = rows.join(seen.filter("variant is null").select("project_id", "stage"), ["project_id", "stage"], "left_semi")
    own = rows.join(seen.filter("variant is not null"), ["project_id", "stage", "variant"], "left_semi")
    return plain.select(key).union(own.select(key)).distinct()


def generalization_lifecycle(generalizations: DataFrame, lifecycle: DataFrame, filter_results: DataFrame, tasks: DataFrame, eligible: DataFrame, variant: str) -> DataFrame:
    """One row a generalization of eligible projects in one variant: the POPULATIONS as flags, final_failure_stage, and whether a task attempted that stage (null without one).

    generalizations: id, project_id, variant. lifecycle: generalization_id, generated_source_created, generated_project_compiled,
    generated_tests_executed, generated_report_collected, generated_filter_passed, generated_pit_collected, final_usable,
    final_failure_stage; at most one row a generalization. filter_results: project_id, generalization_id, filter_name.
    """
    g = generalizations.filter(F.col("variant") == variant).join(eligible.select("project_id").distinct(), "project_id", "left_semi").select("project_id", F.col("id").alias("generalization_id"), "variant")
    recorded = filter_results.filter(F.col("generalization_id").isNotNull() & F.col("filter_name").rlike(FILTER_CLASS)).select("generalization_id").distinct().withColumn("_recorded", F.lit(True))
    joined = g.join(lifecycle, "generalization_id", "left").join(recorded, "generalization_id", "left")
    flag = lambda *names: F.coalesce(reduce(lambda a, b: a & b, [F.col(n) for n in names]), F.lit(False))
    made = ["generated_source_created", "generated_project_compiled", "generated_tests_executed", "generated_report_collected", "generated_filter_passed"]
    rows = joined.select(
        "project_id", "generalization_id", "variant", F.lit(True).alias("attempted"), flag(made[0]).alias("emitted"), F.coalesce("_recorded", F.lit(False)).alias("filter_result_recorded"), flag("generated_filter_passed").alias("filter_passed"),
        flag(*made).alias("validated"), flag("generated_pit_collected").alias("reduced"), flag("final_usable").alias("final_usable"), "final_failure_stage",
    )
    attempted = attempted_stages(rows.select("generalization_id", "project_id", F.col("final_failure_stage").alias("stage"), "variant"), "generalization_id", tasks).withColumn("_seen", F.lit(True))
    observed = F.when(F.col("final_failure_stage").isNotNull(), F.coalesce("_seen", F.lit(False)))
    return rows.join(attempted, "generalization_id", "left").withColumn("failure_attempt_observed", observed).drop("_seen")


def first_failing_gate(rows: DataFrame) -> DataFrame:
    """Lifecycle rows with ``gate``: the first population that the generalization is not in; null if it is in all."""
    return rows.withColumn("gate", F.coalesce(*[F.when(~F.col(p), F.lit(p)) for p in POPULATIONS[1:]]))


def generalization_funnel(rows: DataFrame) -> DataFrame:
    """(position, population, entering_population, entering, passing, exclusions, attempt_known, attempt_unknown, projects) of generalization_lifecycle().

    One aggregation over all gates. A generalization in a population but not in the one before it is an error, as is a band
    that does not conserve. Exclusions are known at SELF_EVIDENT gates, at others where the failing stage was attempted.
    """
    sums = []
    for i, (entering, p) in enumerate(zip(POPULATIONS, POPULATIONS[1:], strict=False), 1):
        gone = F.col(entering) & ~F.col(p)
        known = gone if p in SELF_EVIDENT else gone & F.coalesce("failure_attempt_observed", F.lit(False))
        sums += [F.count_if(F.col(entering)).alias(f"e{i}"), F.count_if(F.col(p)).alias(f"p{i}"), F.count_if(gone).alias(f"x{i}"), F.count_if(known).alias(f"k{i}"), F.min(F.when(F.col(p) & ~F.col(entering), F.col("generalization_id"))).alias(f"o{i}"), F.countDistinct(F.when(F.col(p), F.col("project_id"))).alias(f"d{i}")]
    band = lambda i: F.struct(F.lit(i).alias("position"), F.lit(POPULATIONS[i]).alias("population"), F.lit(POPULATIONS[i - 1]).alias("entering_population"), *[F.col(f"{c}{i}").alias(n) for c, n in zip("epxkod", ["entering", "passing", "exclusions", "attempt_known", "outside", "projects"], strict=True)])
    bands = rows.agg(*sums).select(F.inline(F.array(*[band(i) for i in range(1, len(POPULATIONS))])))
    broken = F.when(F.col("outside").isNotNull(), F.concat("population", F.lit(" generalizations outside "), "entering_population", F.lit(", such as "), "outside"))
    broken = broken.when(F.col("entering") != F.col("passing") + F.col("exclusions"), F.concat(F.lit("funnel band does not conserve "), "population"))
    entering = F.when(broken.isNotNull(), F.raise_error(broken).cast("long")).otherwise(F.col("entering"))
    return bands.select("position", "population", "entering_population", entering.alias("entering"), "passing", "exclusions", "attempt_known", (F.col("exclusions") - F.col("attempt_known")).alias("attempt_unknown"), "projects")
