"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by a hash of their id. A document's virtual finish time is the source's words up
to and with it, divided by the source's weight; a source may be read up to three times, its words counted on. All
(document, reading) items are range-sorted by that time; sums of the ranges show the one in which the total budget ends,
and prefix sums in it show the last item taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, table

#: Items of one range of the sorted items, about.
RANGE_ITEMS = 500_000


@dataclass
class Mix:
    """rows: one a document with _rank, _cum (words of its source up to it) and source figures; cut: (time, rank) of the last item taken, or None for all.

    Items with equal time and rank but the first of them have no words, so that pair orders the items wholly.
    """

    rows: DataFrame
    cut: tuple | None
    epochs: int

    def finish(self, epoch: Column) -> Column:
        return ((epoch - 1) * F.col("source_size") + F.col("_cum")) / F.col("_weight")

    def takes(self, epoch: Column) -> Column:
        if self.cut is None:
            return F.lit(True)
        time, rank = self.finish(epoch), F.col("_rank")
        return (time < F.lit(self.cut[0])) | ((time == F.lit(self.cut[0])) & (rank <= F.lit(self.cut[1])))


def queue_key(id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    """_id, _source, _shuffle and _tie of a row; a null id is shuffled by its text, so that such rows do not meet."""
    tie = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), tie))).cast("binary"))
    return [F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source"), drawn.alias("_shuffle"), tie.alias("_tie")]


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), epochs: int = 3, seed: str = "mix", rows_per_bucket: int = 20_000, range_items: int = RANGE_ITEMS) -> Mix:
    """Weigh the sources, find every document's place in its source's queue, and the last item within the budget.

    Size: words in the text. Sources by code point, null last, get ``weights`` in turn; the budget is the sum of all
    sizes. A source's target is its share by weight, at most ``epochs`` times its size, the excess given to the others
    by weight (water level: the smallest level at which the capped targets add up to the budget).
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    base = saved(docs.select(*queue_key(id_col, text_col, source_col, seed), size.alias("size")))
    # One row a source; the source names are few, unlike the documents.
    grouped = base.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    ranked = grouped.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    weighed = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ahead = Window.orderBy(F.col("source_size") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    leveled = (
        weighed.withColumn("_capped", F.coalesce(F.sum(F.col("source_size") * epochs).over(ahead), F.lit(0)))
        .withColumn("_free", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(ahead), F.lit(0)))
        .withColumn("_budget", F.sum("source_size").over(every))
        .withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_free"))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("source_size") * epochs / F.col("_weight"), F.struct(F.col("source_size") / F.col("_weight"), F.col("_rank"), F.col("_level").alias("level")))).over(every)["level"])
    )
    sources = saved(leveled.select("_source", "source_size", "_n", "_rank", "_weight", "_budget", F.least(F.col("_weight") * F.coalesce("_level", F.lit(0.0)), (F.col("source_size") * epochs).cast("double")).alias("target")))
    rows, budget = sources.agg(F.sum("_n"), F.max("_budget")).first()
    # Prefix sums in two steps: inside buckets of a source's queue, and over the buckets' sums.
    digits = 2
    while 16**digits * rows_per_bucket < (rows or 0):
        digits += 1
    keyed = (
        base.join(sources.drop("_n", "_budget"), base["_source"].eqNullSafe(sources["_source"]))
        .drop(sources["_source"])
        .withColumn("_bucket", F.substring("_shuffle", 1, digits))
    )
    sums = keyed.groupBy("_rank", "_bucket").agg(F.sum("size").alias("_sum"))
    before = sums.select("_rank", "_bucket", F.coalesce(F.sum("_sum").over(Window.partitionBy("_rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("size").over(Window.partitionBy("_rank", "_bucket").orderBy("_shuffle", "_id", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    copy = F.row_number().over(Window.partitionBy("_rank", "_bucket", "_shuffle", "_id", "_tie").orderBy("size"))
    placed = saved(keyed.withColumn("_inside", inside).withColumn("_copy", copy).join(before, ["_rank", "_bucket"]).withColumn("_cum", F.col("_before") + F.col("_inside")).drop("_inside", "_before", "_bucket"))
    mix = Mix(placed, None, epochs)
    if not budget:
        return mix
    items = placed.filter("size > 0").select("size", "_rank", "source_size", "_cum", "_weight", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("_epoch")).select(mix.finish(F.col("_epoch")).alias("_vt"), "_rank", "size")
    ranges = -(-rows * epochs // range_items)
    ordered = saved(items.repartitionByRange(ranges, "_vt", "_rank").sortWithinPartitions("_vt", "_rank").withColumn("_range", F.spark_partition_id()))
    running = ordered.groupBy("_range").agg(F.sum("size").alias("_sum")).withColumn("_upto", F.sum("_sum").over(Window.orderBy("_range")))  # a row a range
    at, spent = running.filter(F.col("_upto") > budget).agg(F.min(F.struct("_range", (F.col("_upto") - F.col("_sum")).alias("_spent"))).alias("_at")).select("_at.*").first()
    if at is None:
        return mix
    edge = ordered.filter(F.col("_range") == at).withColumn("_upto", F.lit(spent) + F.sum("size").over(Window.partitionBy("_range").orderBy("_vt", "_rank").rowsBetween(Window.unboundedPreceding, 0)))
    last = edge.filter(F.col("_upto") <= budget).agg(F.max(F.struct("_vt", "_rank")).alias("_last")).select("_last.*").first()
    if last[0] is None:  # the range's first item is already too much: everything before the range is taken
        last = ordered.filter(F.col("_range") < at).agg(F.max(F.struct("_vt", "_rank")).alias("_last")).select("_last.*").first()
    mix.cut = tuple(last) if last[0] is not None else (-1.0, 0)
    return mix


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """For each input row: doc_id, size, source_size, target (its source's) and taken (words of it in the mix, repeats counted).

    Null texts have size 0; a null source is a source of its own, last in order; null and repeated ids are each placed by
    their own text. With no words at all every figure is 0. An empty table gives an empty table. Reruns agree.
    """
    mix = plan_mix(docs, **options)
    times = sum((mix.takes(F.lit(e)).cast("long") for e in range(1, mix.epochs + 1)), F.lit(0).cast("long"))
    return mix.rows.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The mix itself: the input's columns, one row for each time that a document is taken, in the order of virtual finish times.

    It takes exactly what mix_counts() counts. Rows that agree in id, text and source are places of the queue one after
    the other; which of them has which place follows from a hash of all their columns. The columns may have any names.
    """
    mix = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    order = [F.col("_vt"), F.col("_rank"), F.col("_shuffle"), F.col("_copy"), F.col("_epoch")]
    key = ["_none", "_id", "_tie", "_nowhere", "_source"]

    def whole(df: DataFrame) -> DataFrame:
        return df.withColumns({"_none": F.col("_id").isNull(), "_id": F.coalesce("_id", F.lit(0)), "_nowhere": F.col("_source").isNull(), "_source": F.coalesce("_source", F.lit(""))})

    taken = whole(mix.rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(mix.epochs))).alias("_epoch")).filter(mix.takes(F.col("_epoch"))).withColumn("_vt", mix.finish(F.col("_epoch"))))
    taken = taken.select(*key, "_copy", "_vt", "_rank", "_shuffle", "_epoch")
    rows = whole(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *queue_key(id_col, text_col, source_col, seed)).drop("_shuffle"))
    copied = mix.rows.filter("_copy = 2").select("_id", "_tie", "_source").distinct()
    if copied.limit(1).count():
        several = whole(copied)
        numbered = rows.join(several, key, "left_semi").withColumn("_copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_row"))))
        rows = rows.join(several, key, "left_anti").withColumn("_copy", F.lit(1)).unionByName(numbered)
        joined = rows.join(taken, [*key, "_copy"])
    else:
        joined = rows.join(taken, key)
    return joined.repartitionByRange(*order).sortWithinPartitions(*order).select("_row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """mix_counts() of all documents. The queues and the cut are found when it is called; the returned frame reads their saved rows."""
    return mix_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP4_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS shuf, md5(coalesce(text, '')) AS tie FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM base GROUP BY source
), weighed AS (
  SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src
), leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM weighed
), level AS (
  SELECT coalesce(arg_min(lev, source_size / w) FILTER (WHERE lev <= 3 * source_size / w), 0.0) AS lv FROM leveled
), targeted AS (
  SELECT weighed.*, least(w * lv, CAST(3 * source_size AS DOUBLE)) AS target FROM weighed, level
), queued AS (
  SELECT b.*, t.source_size, t.rnk, t.w, t.target, sum(b.size) OVER (PARTITION BY t.rnk ORDER BY shuf, doc_id, tie ROWS UNBOUNDED PRECEDING) AS cum
  FROM base b JOIN targeted t ON b.source IS NOT DISTINCT FROM t.source
), items AS (
  SELECT q.*, e.epoch, ((e.epoch - 1) * source_size + cum) / w AS vt FROM queued q, (SELECT unnest([1, 2, 3]) AS epoch) e
), spent AS (
  SELECT *, sum(size) OVER (ORDER BY vt, rnk, shuf, doc_id, tie, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM items
)
SELECT doc_id, size, source_size, target, CAST(coalesce(sum(size) FILTER (WHERE upto <= (SELECT sum(size) FROM base)), 0) AS BIGINT) AS taken
FROM spent GROUP BY doc_id, size, source_size, target
"""
