"""Event logs to phase intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_intervals(events: DataFrame, keys: list[str], phase: str, ts: str, order: list[str], keep: list[str]) -> DataFrame:
    """(keys, keep, phase, step, micros): each event lasts until the key's next one; the last, which nothing closes, is left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    micros = F.unix_micros(F.lead(F.col(ts).cast("timestamp")).over(w)) - F.unix_micros(F.col(ts).cast("timestamp"))
    return events.select(*keys, *keep, F.col(phase).alias("phase"), F.row_number().over(w).alias("step"), micros.alias("micros")).filter("micros is not null")
