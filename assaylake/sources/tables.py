"""Snapshots of tables, captured values, candidate repositories, source trees and report exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.digests import ordered_digest
from ..operators.quality import require_columns
from ..scratch import saved


def snapshot(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """The named Parquet tables below one root, which holds one immutable state of a corpus."""
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}.parquet") for n in names}


def old_java(version: Column) -> Column:
    """Java 8 or older, written 1.0 to 1.8, or 0 to 8 with or without .0; empty or missing is not."""
    return F.coalesce(F.trim(version).rlike(r"^(1\.[0-8]|[0-8](\.0)?)$"), F.lit(False))


def eligible_repositories(rows: DataFrame, most_size: float = 100_000) -> DataFrame:
    """Maven, Java 8 or older, test framework 4 or 5, both source folders, below a size; all columns are texts."""
    require_columns(rows, ["build_tool", "java_version", "junit_version", "has_src_main", "has_src_test", "repo_size"])
    framework = F.trim("junit_version")
    return rows.filter((F.lower(F.trim("build_tool")) == "maven") & old_java(F.col("java_version")) & (framework.startswith("4") | framework.startswith("5")) & (F.col("has_src_main") == "True") & (F.col("has_src_test") == "True") & (F.col("repo_size").cast("double") < most_size))


def prefiltered_repositories(rows: DataFrame, language: str, sizes: tuple[float, float], ratios: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows of one language, of a size within bounds, with each named ratio within its bounds."""
    kept = rows.filter((F.col("language") == language) & F.col("size").cast("double").between(*sizes))
    for column, (low, high) in ratios.items():
        kept = kept.filter(F.col(column).cast("double").between(low, high))
    return kept


def read_candidates(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)


VALUES = ["table_row", "mut_class", "mut_method", "parameter", "value"]


def write_values(values: DataFrame, path: str) -> None:
    """Distinct captured values as tab-separated texts with a header, sorted; rows are ranged over files, so that no task holds all."""
    values.select(*[F.col(c).cast("string") for c in VALUES]).distinct().orderBy(*VALUES).write.mode("overwrite").option("header", True).option("sep", "\t").option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_values(spark: SparkSession, path) -> DataFrame:
    """All columns as texts; a missing one is an error."""
    return require_columns(spark.read.option("header", True).option("sep", "\t").option("escape", '"').option("multiLine", True).csv(path), VALUES).select(*VALUES)


def export_sections(sections: dict[str, DataFrame], root: str) -> None:
    """Each section's rows as CSV with a header in a folder of its name."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{root.rstrip('/')}/{name}")


def excluded_file(path: Column) -> Column:
    """Instrumentation and generalized files by their names."""
    name = F.substring_index(path, "/", -1)
    return name.startswith("_") & (name.contains("_Driver_") | name.contains("_Instrumented_") | name.contains("_Generalized_"))


def line_kinds(text: Column) -> Column:
    """struct(code, comment, empty): lines of a source text by kind, block comments carried from line to line.

    A line counts once: with code before a comment it is code. Comment signs inside strings are not told apart. A line end
    at the end of the text starts no further line.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n\\z", ""), "\n", -1)
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(False).alias("open"), zero.alias("code"), zero.alias("comment"), zero.alias("empty"))

    def step(state: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
        ends, begins, single = line.contains("*/"), line.contains("/*"), line.contains("//")
        before = lambda sign: F.trim(F.substring_index(line, sign, 1)) != ""
        empty = line == ""
        comment = ~empty & (state["open"] | line.startswith("/*") | line.startswith("//") | (begins & ~before("/*")) | (~begins & single & ~before("//")))
        opened = F.when(empty, state["open"]).when(state["open"], ~ends).when(line.startswith("//"), F.lit(False)).otherwise(begins & ~ends)
        add = lambda name, c: (state[name] + c.cast("long")).alias(name)
        return F.struct(opened.alias("open"), add("code", ~empty & ~comment), add("comment", comment), add("empty", empty))

    whole = F.aggregate(lines, start, step, lambda s: F.struct(s["code"].alias("code"), s["comment"].alias("comment"), s["empty"].alias("empty")))
    return F.when(text == "", F.struct(zero.alias("code"), zero.alias("comment"), zero.alias("empty"))).otherwise(whole)


def source_statistics(files: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, files, types, code, comment, empty) of source files (path, text): types are 'class' and 'enum' tokens; generated files are skipped."""
    kept = files.filter(~excluded_file(F.col("path"))).withColumn("_k", line_kinds(F.col("text")))
    types = F.regexp_count("text", F.lit(r"\b(class|enum)\b"))
    return kept.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(types).alias("types"), *[F.sum(F.col(f"_k.{c}")).alias(c) for c in ("code", "comment", "empty")])


def read_sources(spark: SparkSession, path, suffix: str = "java") -> DataFrame:
    """(path, text) of all files below a folder with the suffix."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def content_digest(files: DataFrame, keys: list[str], ineligible: DataFrame | None = None) -> DataFrame:
    """(*keys, files, bytes, sha256): the ordered digest of (path, hash of content) of each project; generated files and ineligible projects are skipped.

    files: (*keys, path, content binary). Only paths and hashes meet, in nodes of bounded size, never contents; a project with the same path twice is an error.
    """
    kept = files.filter(~excluded_file(F.col("path")))
    if ineligible is not None:
        kept = kept.join(ineligible.select(*keys).distinct(), keys, "left_anti")
    hashed = saved(kept.select(*keys, "path", F.sha2("content", 256).alias("_h"), F.octet_length("content").cast("long").alias("_n")))
    digests = ordered_digest(hashed, keys, ["path"], F.concat("path", F.lit("\0"), "_h")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("n").alias("files"), "sha256")
    sizes = hashed.groupBy(*keys).agg(F.sum("_n").alias("bytes"))
    return sizes.join(digests, [sizes[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]).select(*keys, "files", "bytes", "sha256")
