"""Line dedup with two Bloom filters.

Line keys are dealt to parts by their hash, as many as keep a part's filters at a fixed size whatever the corpus. A task
sends each part the hashes of its lines, each different one once. There a filter of once-seen and a filter of twice-seen
hashes are built; the twice-seen one is then probed with the part's 64-bit hashes, chunk by chunk, and answers with one bit
a line. The chunks stay where they were written; only lines that are suspected leave them with their documents and
128-bit digests, by which they are grouped: that confirms a repeat and picks the first document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, free_names, in_buckets, saved, table, tune

#: Lines a part at most, on average, and bits of a filter for each of them.
PART_LINES, BITS_PER_LINE = 1 << 21, 16
#: Tasks that probe one part, so that a line which is in a large share of all documents is not one task's work.
PROBES = 4
#: Lines of a chunk: what a task of the first pass holds at once.
HELD = 1 << 18


def _digests(keys: list[str]) -> np.ndarray:
    """(n, 2): XXH3-128 of each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def _candidates(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and digest of each different long enough key of each text."""
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    keys = pc.ascii_lower(pc.utf8_trim(lines.flatten(), characters=SPACES))
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    keep = pc.greater_equal(pc.utf8_length(keys), min_chars)
    rows, digests = rows[keep.to_numpy(zero_copy_only=False)], _digests(keys.filter(keep).to_pylist())
    first = np.unique(np.column_stack([rows.astype(np.uint64), digests]), axis=0, return_index=True)[1]
    return rows[first], digests[first]


class Filter:
    """One Bloom filter of 2**bits bits; four positions a key, all from its 64-bit hash."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(2 ** (bits - 3), np.uint8) if data is None else data

    def places(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return np.stack([(hashes + np.uint64(i) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits) for i in range(4)])

    def add(self, hashes: np.ndarray) -> None:
        p = self.places(hashes).ravel()
        np.bitwise_or.at(self.data, (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        p = self.places(hashes)
        return (self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)


SPANS = [f"{c}_{x}" for c in ("once", "twice", "low") for x in ("at", "n")]
DEALT = "chunk long, parts array<int>, " + ", ".join(f"{x} array<int>" for x in SPANS) + ", once binary, twice binary, low binary, high binary, ids binary, nulls binary"


def _deal(log_parts: int, min_chars: int):
    """Chunks of this task's lines in the order of their parts; for each part its hashes, each once, those in two documents here, and where its bytes lie."""

    def packed(chunk, low, high, ids, nulls):
        part = (low >> np.uint64(64 - log_parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, low, high, ids, nulls = (x[order] for x in (part, low, high, ids, nulls))
        parts, starts = np.unique(part, return_index=True)
        bounds = np.append(starts, len(part))
        once, twice = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            owners = np.unique(np.column_stack([low[a:b], np.where(nulls[a:b], 0, ids[a:b]).astype(np.int64).view(np.uint64), nulls[a:b].astype(np.uint64)]), axis=0)
            seen, counts = np.unique(owners[:, 0], return_counts=True)
            once.append(seen)
            twice.append(seen[counts > 1])
        spans = []
        for sizes in (np.array([len(x) for x in once]), np.array([len(x) for x in twice]), np.diff(bounds)):
            spans += [(np.cumsum(sizes) - sizes) * 8, sizes * 8]
        data = [np.concatenate(once), np.concatenate(twice), low, high, ids, nulls]
        columns = [pa.array([chunk], pa.int64()), pa.array([parts], pa.list_(pa.int32())), *[pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in spans], *[pa.array([x.tobytes()], pa.binary()) for x in data]]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "parts", *SPANS, "once", "twice", "low", "high", "ids", "nulls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, chunk = [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, digests = _candidates(batch.column(2), min_chars)
            nulls, ids = batch.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.uint8), batch.column(1).to_numpy()[rows]
            held.append((digests[:, 0], digests[:, 1], ids, nulls))
            size += len(rows)
            if size >= HELD:
                yield packed(chunk, *map(np.concatenate, zip(*held, strict=True)))
                held, size, chunk = [], 0, chunk + 1
        if size:
            yield packed(chunk, *map(np.concatenate, zip(*held, strict=True)))

    return run


def _of_parts(dealt: DataFrame, *names: str) -> DataFrame:
    """(chunk, part, the part's bytes of each named column)."""
    each = dealt.select("chunk", F.posexplode("parts").alias("_i", "part"), *[f"{n}{x}" for n in names for x in ("", "_at", "_n")])
    return each.select("chunk", "part", *[F.expr(f"substring({n}, {n}_at[_i] + 1, {n}_n[_i])").alias(n) for n in names])


def _u8(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u8")


def _build(bits: int):
    """(part, twice): the twice-seen filter of every part, from sorted (part, once, twice) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, once, twice = None, None, None

        def made():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([twice.data.tobytes()], pa.binary())], names=["part", "twice"])

        for batch in batches:
            for p, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part:
                    if part is not None:
                        yield made()
                    part, once, twice = p, Filter(bits), Filter(bits)
                hashes = _u8(a)
                twice.add(_u8(b))
                twice.add(hashes[once.has(hashes)])
                once.add(hashes)
        if part is not None:
            yield made()

    return run


def _probe(bits: int):
    """(chunk, part, bits): which lines of a chunk the part's filter suspects; of each part the filter comes first, then its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = None
        for batch in batches:
            out = []
            for row in batch.select(["chunk", "part", "twice", "low"]).to_pylist():
                if row["twice"] is not None:
                    twice = Filter(bits, np.frombuffer(row["twice"], np.uint8))
                    continue
                hit = twice.has(_u8(row["low"]))
                if hit.any():
                    out.append((row["chunk"], row["part"], np.packbits(hit).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["chunk", "part", "bits"])

    return run


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_null, _id, _low, _high) of the suspected lines of chunks with their bits."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            low, high, ids, nulls = _u8(row["low"]), _u8(row["high"]), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], np.uint8)
            spans = {p: (at // 8, n // 8) for p, at, n in zip(row["parts"], row["low_at"], row["low_n"], strict=True)}
            hits = [at + np.flatnonzero(np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=n)) for x in row["found"] for at, n in [spans[x["part"]]]]
            hit = np.concatenate(hits)
            columns = nulls[hit].astype(bool), ids[hit], low[hit].view(np.int64), high[hit].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_null", "_id", "_low", "_high"])


def _rewrite(text_at: int):
    spaces = SPACES.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = pc.fill_null(batch.column(text_at), ""), batch.column(batch.num_columns - 1)
            n_lines = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64())
            n_dropped = np.zeros(len(texts), np.int64)
            changed = pc.is_valid(drops).to_numpy(zero_copy_only=False)
            if changed.any():
                out = texts.to_pylist()
                for i in np.flatnonzero(changed):
                    gone = {(d["_low"] & (2**64 - 1), d["_high"] & (2**64 - 1)) for d in drops[i].as_py()}
                    lines = out[i].encode().split(b"\n")
                    digests = map(tuple, _digests([x.strip(spaces).lower() for x in lines]).tolist())
                    kept = [x for x, d in zip(lines, digests, strict=True) if d not in gone]
                    n_dropped[i] = len(lines) - len(kept)
                    out[i] = b"\n".join(kept).decode()
                texts = pa.array(out, pa.string())
            columns = [texts if i == text_at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, n_lines, pa.array(n_dropped)], names=[*batch.schema.names[:-1], "n_lines", "n_dropped"])

    return run


def suspects(slim: DataFrame, min_chars: int = 10, part_lines: int = PART_LINES, bits: int | None = None) -> DataFrame:
    """(_null, _id, _text) -> (_null, _id, _low, _high): the lines whose key may be in two documents; every line of a key that is, is there.

    The filters are sized by the number of lines; ``bits`` sets their size (2**bits bits a part) instead.
    """
    lines = slim.agg(F.sum(F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1)).first()[0] or 0
    log_parts = max(2, (-(-lines // part_lines) - 1).bit_length())
    bits = bits or max(10, (BITS_PER_LINE * lines >> log_parts).bit_length())
    dealt = in_buckets(slim.mapInArrow(_deal(log_parts, min_chars), DEALT), "chunk")
    filters = saved(_of_parts(dealt, "once", "twice").repartition(F.col("part")).sortWithinPartitions("part").select("part", "once", "twice").mapInArrow(_build(bits), "part int, twice binary"))
    every = filters.select(F.lit(None).cast("long").alias("chunk"), "part", F.explode(F.sequence(F.lit(0), F.lit(PROBES - 1))).alias("probe"), "twice", F.lit(None).cast("binary").alias("low"))
    asked = _of_parts(dealt, "low").select("chunk", "part", F.pmod(F.xxhash64("chunk"), F.lit(PROBES)).cast("int").alias("probe"), F.lit(None).cast("binary").alias("twice"), "low")
    found = every.union(asked).repartition("part", "probe").sortWithinPartitions("part", "probe", F.col("twice").isNull()).mapInArrow(_probe(bits), "chunk long, part int, bits binary")
    # The answers go back to the chunks, which stay where they are: they lie in buckets of the join's key.
    answers = saved(found.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias("found")))
    return saved(dealt.select("chunk", "parts", "low_at", "low_n", "low", "high", "ids", "nulls").join(answers, "chunk").select("parts", "low_at", "low_n", "low", "high", "ids", "nulls", "found").mapInArrow(_take, "_null boolean, _id long, _low long, _high long"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, part_lines: int = PART_LINES, bits: int | None = None) -> DataFrame:
    """Keep each repeated line only in the first document that holds it.

    The key of a line is the line without ASCII white space at its ends and with A-Z in lower case; keys are told apart
    by 128-bit digests. A key of at least ``min_chars`` code points in at least two documents loses all its lines except
    in the document with the smallest id.

    Returns the input's columns with the new text, plus n_lines (before dropping) and n_dropped; columns of the input
    with these two names, in any case, are replaced. A null text counts as one empty line and becomes ''. Ids are
    integers; rows with the same id are one document for the choice and are all rewritten; all rows with a null id are
    one document that sorts last. An empty table gives an empty table.
    """
    tune(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    null, ident, drops = free_names(docs, "null", "id", "drops")
    text = F.col(text_col).cast("string")
    # Rows without an id are joined by their text, so that they do not meet in one place.
    key = [F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text))]
    found = suspects(docs.select(key[0].alias("_null"), key[1].alias("_id"), F.coalesce(text, F.lit("")).alias("_text")), min_chars, part_lines, bits)
    owner = F.struct("_null", F.when(~F.col("_null"), F.col("_id")).alias("_id"))
    firsts = saved(found.groupBy("_low", "_high").agg(F.min(owner).alias("_first"), F.max(owner).alias("_last")).filter("not _first <=> _last").select("_low", "_high", "_first"))
    gone = found.join(firsts, ["_low", "_high"]).filter(~owner.eqNullSafe(F.col("_first"))).groupBy("_null", "_id").agg(F.collect_set(F.struct("_low", "_high")).alias("_drops"))
    gone = gone.select(F.col("_null").alias(null), F.col("_id").alias(ident), F.col("_drops").alias(drops))
    joined = docs.withColumns({text_col: text, null: key[0], ident: key[1]}).join(gone, [null, ident], "left").select(*[F.col(f"`{c}`") for c in docs.columns], drops)
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields]
    return joined.mapInArrow(_rewrite(docs.columns.index(text_col)), T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """dedup_lines() of all documents, as digests. The passes over the lines run when it is called, the rewriting with the returned frame."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), flagged AS (
  SELECT keyed.*, (r.k IS NOT NULL AND r.keeper <> doc_id) AS gone FROM keyed LEFT JOIN repeated r USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
