"""Digests of sorted row sets as trees of bounded nodes: the same for the same rows, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved

#: Children of a node.
FAN = 256


def _folded(nodes: DataFrame, groups: list[str], at: str, text: str, fan: int) -> DataFrame:
    """(*groups, _node, _h): SHA-256 over the texts of each ``fan`` neighbours, in order, joined by line feeds."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(text).alias("t")))), lambda x: x["t"])
    return nodes.groupBy(*groups, F.floor(F.col(at) / fan).alias("_node")).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("_h"))


def ordered_digest(rows: DataFrame, groups: list[str], identity: list[str], line: Column, unique: bool = True, fan: int = FAN) -> DataFrame:
    """(*groups, n, sha256): the digest of each group's lines in the order of the identity columns.

    Rows are range-sorted by group and identity and numbered within their group; a leaf is the digest of ``fan`` lines, a node
    that of ``fan`` children, and the root, the first level with one node, is the group's digest. A node never holds more than
    ``fan`` texts, and one group may fill any number of ranges. With ``unique`` a repeated identity is an error: it stands
    beside its like in the order. Without groups and rows the result is one row: n 0 and the digest of nothing; null groups are groups.
    """
    named = {g: f"_g{i}" for i, g in enumerate(groups)}
    keys = list(named.values())
    slim = rows.select(*[F.col(g).alias(k) for g, k in named.items()], F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}).alias("_id"), *[F.col(c).alias(f"_i{i}") for i, c in enumerate(identity)], line.cast("string").alias("_line"))
    order = [*keys, *[f"_i{i}" for i in range(len(identity))], "_line"]
    if not keys:
        slim, keys = slim.withColumn("_all", F.lit(0)), ["_all"]
    ranged = saved(slim.repartitionByRange(*order).sortWithinPartitions(*order).select(*keys, "_id", "_line", F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33)))
    # A row for each part of each group: where the part's rows start among the group's.
    parts = ranged.groupBy(*keys, "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(*[F.col(k).alias(f"_s{k}") for k in keys], F.col("_part").alias("_s_part"), (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_shift"))
    same = [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys] + [F.col("_part") == F.col("_s_part")]
    numbered = saved(ranged.join(starts, same).select(*keys, "_id", "_line", (F.col("_at") + F.col("_shift")).alias("_at")))
    if unique:
        _refuse_repeats(numbered, keys, fan)
    total = numbered.groupBy(*keys).agg(F.count("*").alias("n"))
    level = saved(_folded(numbered, keys, "_at", "_line", fan))
    roots = None
    while True:
        counted = level.groupBy(*[F.col(k).alias(f"_s{k}") for k in keys]).agg(F.max("_node").alias("_last"))
        joined = saved(level.join(counted, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys]).select(*keys, "_node", "_h", "_last"))
        done = joined.filter("_last = 0").select(*keys, F.col("_h").alias("sha256"))
        roots = done if roots is None else roots.union(done)
        rest = joined.filter("_last > 0")
        if not rest.limit(1).count():
            break
        level = saved(_folded(rest, keys, "_node", "_h", fan))
    right = total.select(*[F.col(k).alias(f"_s{k}") for k in keys], "n")
    out = roots.join(right, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys]).select(*[F.col(k).alias(g) for g, k in named.items()], "n", "sha256")
    if groups:
        return out
    return out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"))


def _refuse_repeats(numbered: DataFrame, keys: list[str], fan: int) -> None:
    """An error for two neighbours with one identity: inside a leaf, or where one leaf ends and the next begins."""
    leaf = F.floor(F.col("_at") / fan)
    ends = numbered.groupBy(*keys, leaf.alias("_leaf")).agg(F.count("*").alias("_n"), F.countDistinct("_id").alias("_d"), F.min_by("_id", "_at").alias("_first"), F.max_by("_id", "_at").alias("_final"))
    inside = ends.filter("_n <> _d").select(F.col("_first").alias("_id"))
    after = ends.select(*[F.col(k).alias(f"_s{k}") for k in keys], (F.col("_leaf") - 1).alias("_s_leaf"), F.col("_first").alias("_s_first"))
    across = ends.join(after, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys] + [F.col("_leaf") == F.col("_s_leaf")]).filter("_final = _s_first").select(F.col("_final").alias("_id"))
    if found := inside.union(across).first():
        raise ValueError(f"repeated identity at or after {found[0]}")
