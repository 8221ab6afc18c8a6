"""Dense ids over all rows without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved


def global_dense_id(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The input with ``name`` = dense_rank over (order by keys).

    Distinct keys are range-sorted and written; a row's place in its sorted part, which the running row number of the
    writing task gives, plus the counts of the parts before it, is its id. No second shuffle numbers them.
    """
    placed = df.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = saved(placed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit(2**33 - 1)).alias("_rank")))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a part
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    ids = ranged.join(F.broadcast(offsets), "_part").select(*[f"_k{i}" for i in range(len(keys))], (F.col("_offset") + F.col("_rank") + 1).alias(name))
    same = [df[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(ids, same).drop(*[f"_k{i}" for i in range(len(keys))])
