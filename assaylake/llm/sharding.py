"""Sharding by longest processing time: groups that stay together, largest first, to the least-loaded shard."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table


def least_loaded(sizes: list[int], shards: int) -> list[int]:
    """The shard of each group: by falling size, each to the shard with the least load so far (ties: lowest number)."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heapq.heappop(heap)
        out[i] = shard
        heapq.heappush(heap, (load + sizes[i], shard))
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, singles: int = 8192, bundles: int = 4096, rows_per_slot_group: int = 250_000) -> DataFrame:
    """Put every row into one of ``shards`` shards of near-equal bytes; rows with equal texts stay together.

    A row's size is the UTF-8 bytes of its text plus 1. The largest groups, down to the least power of two bytes that no
    more than ``singles`` groups reach, are scheduled one by one; the rest, joined by the hash of their text into ``bundles`` bundles, are scheduled as bundles. So the driver's heap sees
    a fixed number of items at any input size, the schedule is that of single groups wherever there are no more than
    ``singles``, and the loads differ by about one bundle unless one group is by itself larger than a fair share: as a
    group must stay together, its shard then holds it and nothing more.

    Returns the id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard, in the order of a hash
    bucket of id, size and CRC, then of these) and grown_shard (null: only the law 'key' has one). A null text has size 1, CRC 0 and
    forms a group with the other null texts, apart from ''. Repeated rows each get a slot. Other columns are not read.
    """
    text = F.col(text_col)
    base = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.unhex(F.lit("00"))).alias("_group"),
        )
    )
    rows = base.count()
    bundle = F.pmod(F.xxhash64("_group"), F.lit(bundles)).cast("int")
    groups = saved(base.groupBy("_group").agg(F.sum("size").alias("_bytes")))
    sizes = groups.groupBy(F.floor(F.log2("_bytes")).cast("int").alias("_bits")).count().collect()  # a row for each power of two
    least, known = 62, 0
    for bits, n in sorted(sizes, reverse=True):
        known += n
        if known > singles:
            break
        least = bits
    single = groups.filter(F.col("_bytes") >= 2**least).orderBy(F.desc("_bytes"), "_group")
    alone = [(bytes(x._group), x._bytes) for x in single.collect()]  # at most ``singles`` rows
    spark = docs.sparkSession
    names = spark.createDataFrame([(g,) for g, _ in alone], "_group binary")
    joined = groups.join(F.broadcast(names), "_group", "left_anti").groupBy(bundle.alias("_bundle")).agg(F.sum("_bytes").alias("_bytes")).orderBy("_bundle").collect()  # at most ``bundles`` rows
    place = least_loaded([n for _, n in alone] + [x._bytes for x in joined], shards)
    by_group = [(g, shard) for (g, _), shard in zip(alone, place, strict=False)]
    by_bundle = [0] * bundles
    for x, shard in zip(joined, place[len(alone) :], strict=True):
        by_bundle[x._bundle] = shard
    own = spark.createDataFrame(by_group, "_group binary, _own int")  # at most ``singles`` rows
    common = spark.createDataFrame(list(enumerate(by_bundle)), "_bundle int, _common int")  # bundles rows
    parts = max(1, -(-rows // rows_per_slot_group)) * 16
    placed = (
        base.withColumn("_bundle", bundle)
        .join(F.broadcast(own), "_group", "left")
        .join(F.broadcast(common), "_bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("_own", "_common").alias("shard"), F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).alias("_part"))
    )
    # A slot is the rank in a part of a shard plus the rows of that shard's earlier parts: no task sorts a whole shard.
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "size", "text_crc32"))
    return (
        placed.withColumn("_rank", rank)
        .join(before, ["shard", "_part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.coalesce("_before", F.lit(0)) + F.col("_rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """shard_documents() of all documents, 16 shards. The schedule is made when it is called; the returned frame reads saved rows."""
    return shard_documents(table(spark, sf_dir, "documents"))
