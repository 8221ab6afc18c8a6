"""Shared helpers of the training-data operators: scratch tables, sessions, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import in_buckets, saved, ship

__all__ = ["SPACES", "WORD", "free_names", "in_buckets", "let", "saved", "table", "tune"]

#: ASCII white space of the word rule; a word is a maximal run of anything else.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and bytes, so that a worker never holds many long texts at once; give the workers this package. The session keeps these two settings, as frames run later."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind a costly expression to a lambda variable, so that it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as no column of ``df`` has, in any case."""
    taken, lead = [c.lower() for c in df.columns], "_"
    while any(c.startswith(lead) for c in taken):
        lead += "_"
    return [lead + n for n in names]
