"""Parameter-value coverage: generated runs, distinct values and tuples, instruction coverage, census and scoreboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs_with_outcome(runs: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with outcome PASSED, FAILED or MISSING (no report) and the report's diagnostic."""
    return runs.join(reports.select(*keys, "result", "diagnostic"), keys, "left").withColumn("outcome", F.when(F.col("result").isNull(), "MISSING").when(F.col("result") == "PASSED", "PASSED").otherwise("FAILED")).drop("result")


def narrowed(rows: DataFrame, **allowed: list | None) -> DataFrame:
    """Rows whose named columns have one of the given values; None leaves a column alone."""
    for column, values in allowed.items():
        if values is not None:
            rows = rows.filter(F.col(column).isin(list(values)))
    return rows


def value_coverage(values: DataFrame, keys: list[str], parameter: str = "parameter_name", value: str = "value") -> DataFrame:
    """(*keys, parameter, generated, distinct_values)."""
    return values.groupBy(*keys, parameter).agg(F.count(value).alias("generated"), F.countDistinct(value).alias("distinct_values"))


def property_coverage(values: DataFrame, keys: list[str], trial: str = "trial_index") -> DataFrame:
    """(*keys, trials, parameters, pvc): trials, parameters and distinct (parameter, value) pairs of a property."""
    return values.groupBy(*keys).agg(F.countDistinct(trial).alias("trials"), F.countDistinct("parameter_name").alias("parameters"), F.countDistinct("parameter_name", "value").alias("pvc"))


def distinct_tuples(values: DataFrame, keys: list[str], trial: str = "trial_index") -> DataFrame:
    """(*keys, trials, distinct_tuples): trials as whole rows of parameters; only a digest of each trial is counted."""
    tuples = values.groupBy(*keys, trial).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("parameter_name", "value")))), 256).alias("_t"))
    return tuples.groupBy(*keys).agg(F.count("*").alias("trials"), F.countDistinct("_t").alias("distinct_tuples"))


def union_values(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, union_values): distinct values of two sources together; nulls are no values."""
    both = left.select(*keys, value).union(right.select(*keys, value)).distinct()
    return both.groupBy(*keys).agg(F.count(value).alias("union_values"))


def value_identity(value: Column) -> Column:
    """Base 64 of the UTF-8 bytes."""
    return F.base64(F.encode(value, "UTF-8"))


def compact_facts(runs: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with a sorted list of their different (parameter, base-64 value) pairs, [] where there are none."""
    pairs = values.select(*keys, F.struct("parameter_name", value_identity(F.col("value")).alias("value")).alias("_p")).distinct()
    listed = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("facts"))
    return runs.join(listed, keys, "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<struct<parameter_name:string,value:string>>")))


def instruction_coverage(reports: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, covered, missed, ratio): sums over classes; no instructions give a null ratio."""
    sums = reports.groupBy(*keys).agg(F.sum("instruction_covered").alias("covered"), F.sum("instruction_missed").alias("missed"))
    return sums.withColumn("ratio", F.round(F.try_divide(F.col("covered").cast("double"), F.col("covered") + F.col("missed")), 4))


def mutant_scores(reports: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """(*keys, mutants, covered, killed, score, covered_score) over distinct mutants; one that any report kills is killed."""
    one = reports.groupBy(*keys, *identity).agg(F.bool_or("is_detected").alias("_k"), F.bool_or(F.col("status") != "NO_COVERAGE").alias("_c"))
    sums = one.groupBy(*keys).agg(F.count("*").alias("mutants"), F.count_if("_c").alias("covered"), F.count_if("_k").alias("killed"))
    ratio = lambda c: F.round(F.try_divide(F.col("killed").cast("double"), F.col(c)), 4)
    return sums.withColumns({"score": ratio("mutants"), "covered_score": ratio("covered")})


def method_signature(parameters: Column) -> tuple[Column, Column]:
    """(signature, known) of a JSON array of parameters: type names in order, ? for a parameter without type; ? and false where it is no array."""
    parsed = F.from_json(parameters, "array<struct<type:string>>")
    types = F.transform(parsed, lambda p: F.coalesce(F.nullif(p["type"], F.lit("")), F.lit("?")))
    array = parameters.isNotNull() & parsed.isNotNull() & F.trim(parameters).startswith("[")
    return F.when(array, F.array_join(types, ",")).otherwise("?"), F.coalesce(array & F.forall(parsed, lambda p: F.coalesce(p["type"] != "", F.lit(False))), F.lit(False))


def tested_method_key(cls: Column, method: Column, parameters: Column) -> tuple[Column, Column]:
    """(key, known): class::method(signature); a null class or method has no key."""
    signature, known = method_signature(parameters)
    there = cls.isNotNull() & method.isNotNull()
    return F.when(there, F.concat(cls, F.lit("::"), method, F.lit("("), signature, F.lit(")"))), there & known


def argument_count(arguments: Column) -> Column:
    """Different (position, value) pairs of a JSON array, which are as many as its elements; null counts 0, anything but an array is an error."""
    n = F.json_array_length(arguments)
    return F.when(arguments.isNull(), 0).otherwise(F.coalesce(n, F.raise_error(F.lit("arguments must be a JSON array")).cast("int")))


def census(rows: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """(*keys, n, one count a flag); null keys are a group of their own."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])


def project_coverage(values: DataFrame, project: str, method: str, known: str) -> DataFrame:
    """(project, pvc, sound, unresolved): distinct values of every (method, parameter) over all properties; methods whose identity is known, and the rest."""
    distinct = values.select(project, method, known, "parameter_name", "value").distinct()
    return distinct.groupBy(project).agg(F.count("value").alias("pvc"), F.countDistinct(F.when(F.col(known), F.col(method))).alias("sound"), F.countDistinct(F.when(~F.col(known), F.col(method))).alias("unresolved"))


def scoreboard(coverage: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Value coverage and mutant scores side by side; counts missing on one side are 0."""
    joined = coverage.join(scores, keys, "full")
    return joined.fillna(0, [c for c in joined.columns if c not in keys])


def against_published(measured: DataFrame, published: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, value, published, difference, matches): left join on published rows; a probe without measure has nulls and does not match."""
    joined = published.select(*keys, F.col(value).alias("published")).join(measured.select(*keys, value), keys, "left")
    return joined.select(*keys, value, "published", (F.col(value) - F.col("published")).alias("difference"), F.coalesce(F.col(value) == F.col("published"), F.lit(False)).alias("matches"))
