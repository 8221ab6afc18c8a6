"""Token counts of documents in flat token files that have no index, by a separator scan.

A token file is a run of little-endian unsigned ids of 2 bytes (4 for larger vocabularies) in which every document ends
with the end-of-document id. It is read as blocks that know nothing of documents. Each block's separators are found at once by a vectorised
search; a prefix scan over the blocks' summaries then gives every block the number of documents before it and the
tokens carried into it, which stitches the documents that cross block borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, default_ranks
from .common import saved, table, tune

BLOCK_TOKENS = 1 << 18
BLOCK = "file long, block long, tokens binary, doc_ids array<long>, first long"


def id_bytes(largest: int) -> int:
    """Bytes of an id in a token file whose largest id is this."""
    return 2 if largest < 2**16 else 4


def _write(path: str, block_tokens: int):
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(path)[0]
        end, file = encoder.max_token_value, TaskContext.get().partitionId()
        held, size, block, ids, first, kind = [], 0, 0, [], 0, f"<u{id_bytes(end)}"

        def row(tokens):
            return pa.RecordBatch.from_pydict({"file": [file], "block": [block], "tokens": [tokens.astype(kind).tobytes()], "doc_ids": [ids], "first": [first]}, schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").to_pylist(), strict=True):
                held.append(np.array([*encoder.encode_ordinary(text), end], np.uint32))
                size += len(held[-1])
                ids.append(doc)
                if size >= block_tokens:
                    tokens = np.concatenate(held)
                    while len(tokens) >= block_tokens:
                        yield row(tokens[:block_tokens])
                        first, ids, block, tokens = first + len(ids), [], block + 1, tokens[block_tokens:]
                    held, size = [tokens], len(tokens)
        if size or ids:
            yield row(np.concatenate(held))

    return run


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Blocks (file, block, tokens) of one flat token file a partition, and the order of documents (file, ordinal, doc_id) in each.

    A null text is an empty document; null and repeated ids keep their rows; an empty table gives no block.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    written = saved(rows.mapInArrow(_write(ranks or default_ranks(), block_tokens), BLOCK))
    order = written.select("file", F.posexplode("doc_ids").alias("at", "doc_id"), "first").select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id")
    return written.select("file", "block", "tokens"), order


def read_token_files(spark: SparkSession, path, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, path, block, tokens) of raw token files, which hold nothing but ids of ``width`` bytes.

    Files are numbered by a hash of their path and cut into blocks by byte ranges. One file is at most 2 GB (the bound of
    Spark's binary reader); bytes after the last whole id are an error.
    """
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    whole = F.when(F.col("length") % width != 0, F.raise_error(F.concat(F.lit("no whole number of ids in "), F.col("path"))).cast("long")).otherwise(F.col("length"))
    last = F.floor(F.greatest(whole - 1, F.lit(0)) / size).cast("int")
    cut = files.select("path", "content", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    return cut.select(F.xxhash64("path").alias("file"), "path", F.col("block").cast("long").alias("block"), F.expr(f"substring(content, block * {size} + 1, {size})").alias("tokens"))


def _scan(separator: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x, f"<u{width}") for x in batch.column(2).to_pylist()]
            ends = [np.flatnonzero(t == separator) for t in tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    return run


def count_tokens(blocks: DataFrame, separator: int = 50256, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, terminated): every document of every file, in order; its tokens without the separator.

    Tokens after a file's last separator are one more document with terminated = false; an empty document counts 0.
    Blocks may cut documents anywhere and a document may span many blocks; their order is that of ``block``; null or
    empty blocks hold no token. A file without tokens has no document.
    """
    found = saved(blocks.select("file", "block", "tokens").withColumn("tokens", F.coalesce("tokens", F.lit("").cast("binary"))).mapInArrow(_scan(separator, width), "file long, block long, n long, ends array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = found.select("file", "block", "n", F.size("ends").cast("long").alias("docs"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    placed = summed.withColumn("start", start).withColumn("docs_before", F.coalesce(F.sum("docs").over(before), F.lit(0)))
    carried = placed.withColumn("open", F.coalesce(F.last(F.col("start") + F.col("last"), ignorenulls=True).over(before) + 1, F.lit(0)))  # where the document that is open at the block's start began
    ended = (
        found.select("file", "block", "ends")
        .join(carried.filter("docs > 0").select("file", "block", "start", "docs_before", "open"), ["file", "block"])
        .select("file", "docs_before", F.posexplode("ends").alias("at", "end"), F.col("ends"), (F.col("open") - F.col("start")).alias("from"))
        .select("file", (F.col("docs_before") + F.col("at")).alias("ordinal"), (F.col("end") - F.when(F.col("at") > 0, F.get("ends", F.col("at") - 1) + 1).otherwise(F.col("from"))).alias("n_tokens"), F.lit(True).alias("terminated"))
    )
    files = placed.groupBy("file").agg(F.sum("n").alias("n"), F.sum("docs").alias("ordinal"), F.max(F.col("start") + F.col("last")).alias("last"))
    rest = files.select("file", "ordinal", (F.col("n") - F.coalesce(F.col("last") + 1, F.lit(0))).alias("n_tokens"), F.lit(False).alias("terminated")).filter("n_tokens > 0")
    return ended.unionByName(rest)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents written to flat token files, whose documents are then found and counted by their separators alone."""
    blocks, order = write_token_files(table(spark, sf_dir, "documents"))
    return order.join(count_tokens(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")
