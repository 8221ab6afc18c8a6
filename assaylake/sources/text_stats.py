"""Per-text line statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lines, empty_lines, longest) of each row, inside the row: no explode, no shuffle."""
    lines = F.split(text, "\n", -1)
    return df.select(key, F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("empty_lines"), F.array_max(F.transform(lines, lambda x: F.length(x))).cast("long").alias("longest"))
