"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint is a row of bytes. Fingerprints that differ in at most d bits share at least (bytes - d) bytes at their
places. The index lists fingerprints under the values of three byte places; the sets of places are chosen so that any
pair with the guaranteed minimum of shared bytes meets in at least one list (a covering design). Within a list the
shared positional bytes of each pair are tallied, pairs below the guaranteed minimum are dropped, the rest verified by
their differing bits. Equal fingerprints are one entry, so copies cost nothing. A list that is too long to compare at
once goes to an exact way that is linear in its members (see _balls). Near copies by the similarity of their texts are
in near_text.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table, tune
from .components import components

#: Members of one list that are compared pair by pair, by one task at a time.
LIST_CAP = 1024
#: Shingles whose bits are counted at once, in steps of 255, so that a byte holds each count.
STRIDE = 16 * 255


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """Column i of n: the i-th 64-bit value that follows from each hash (a weighted step and a bit mixer); column 0 is the hash."""
    x = h[:, None] + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    x[:, 0] = h
    return x


def _hashed(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats too."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)


def _folded(hashes: np.ndarray, words64: int) -> np.ndarray:
    """SimHash of words64 * 64 bits as uint64: bit i is 1 if it is set in over half the hashes, from word 1 on in their mixed values."""
    total = np.zeros(64 * words64, np.int64)
    for at in range(0, len(hashes), STRIDE):
        bits = np.unpackbits(_bytes(_mixed(hashes[at : at + STRIDE], words64)), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):
            total += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


def covering_triples(places: int, shared: int) -> list[tuple[int, int, int]]:
    """Sets of three of ``places`` such that any ``shared`` places contain one of them; greedy, the same at every call."""
    left = set(combinations(range(places), shared))
    triples = list(combinations(range(places), 3))
    out = []
    while left:
        best = max(triples, key=lambda t: sum(set(t) <= set(s) for s in left))
        out.append(best)
        left = {s for s in left if not set(best) <= set(s)}
    return out


def _bytes(fps: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(fps.astype("<u8")).view(np.uint8).reshape(len(fps), -1)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_folded(_hashed(t.as_py(), shingle), 1)[0] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(np.array(fps, np.uint64))], names=["_id", "_f"])

    return run


def _postings(triples: list):
    """(_key, _f): for each set of places its list and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                f = whole.column(0).slice(at, 4096).to_numpy()
                b = _bytes(f.view(np.uint64)).astype(np.int64)
                keys = [(np.int64(j) << 24) | (b[:, x] << 16) | (b[:, y] << 8) | b[:, z] for j, (x, y, z) in enumerate(triples)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(f, len(triples)))], names=["_key", "_f"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], cap: int):
    """Runs of two and more equal keys in sorted batches, as (columns, kind).

    Kind "pairs": many runs of two, one after the other. "whole": one run. "piece": at most ``cap`` rows of a longer run.
    """
    held: list[list[np.ndarray]] = []
    key, size, cut = None, 0, False

    def joined():
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        if not len(columns[0]):
            continue
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(columns[0])) + 1, [len(columns[0])]])
        sizes = np.diff(bounds)
        inner = np.arange(1, len(sizes) - 1)  # the first and the last run may go on in other batches
        twos = bounds[inner[sizes[inner] == 2]] if cap > 1 else np.zeros(0, np.int64)
        if len(twos):
            at = np.stack([twos, twos + 1], axis=1).ravel()
            yield [c[at] for c in columns], "pairs"
        for i in (0, *inner[sizes[inner] > 2].tolist(), *([len(sizes) - 1] if len(sizes) > 1 else [])):
            a, b = bounds[i].item(), bounds[i + 1].item()
            if columns[0][a] != key:
                if held and (size > 1 or cut):
                    yield joined(), "piece" if cut else "whole"
                held, key, size, cut = [], columns[0][a], 0, False
            for at in range(a, b, cap):
                held.append([c[at : min(b, at + cap)] for c in columns])
                size += min(b, at + cap) - at
                if size > cap:
                    cut = True
                    yield joined(), "piece"
                    held, size = [], 0
    if held and (size > 1 or cut):
        yield joined(), "piece" if cut else "whole"


def _distances(fps: np.ndarray, one: np.ndarray, min_bytes: int) -> np.ndarray:
    """Differing bits, 255 for those that share fewer than ``min_bytes`` bytes at their places."""
    bits = fps ^ one
    d = np.bitwise_count(bits)
    if min_bytes:
        shared = (bits[:, None].view(np.uint8) == 0).sum(axis=1)  # the tally of shared positional bytes
        d[shared < min_bytes] = 255
    return d


def _forest(fps: np.ndarray, min_bytes: int, max_bits: int) -> list[tuple[int, int]]:
    """The closest links within ``max_bits`` that connect what all such links connect: fewer than the members, grown one by one in linear memory."""
    outside, best, parent = np.arange(1, len(fps)), np.full(len(fps), 255, np.uint8), np.zeros(len(fps), np.int64)
    at, links = 0, []
    while len(outside):
        d = _distances(fps[outside], fps[at], min_bytes)
        closer = d < best[outside]
        best[outside[closer]], parent[outside[closer]] = d[closer], at
        k = best[outside].argmin()
        at = outside[k]
        if best[at] <= max_bits:
            links.append((at, parent[at]))
        outside = np.delete(outside, k)
    return links


def _compare(min_bytes: int, max_bits: int, cap: int):
    """(_kind, _a, _b): links 0 between a list's members; 1 for each member (twice) of a list that is too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []

        def packed():
            rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], names=["_kind", "_a", "_b"])

        def add(kind: int, a: np.ndarray, b: np.ndarray):
            out.append(np.stack([np.full(len(a), kind, np.int64), a, b], axis=1))

        for (_, signed), kind in _groups(batches, cap):
            fps = signed.view(np.uint64)
            if kind == "pairs":
                near = _distances(fps[::2], fps[1::2], min_bytes) <= max_bits
                if near.any():
                    add(0, signed[::2][near], signed[1::2][near])
            elif kind == "piece":
                add(1, signed, signed)
            elif links := _forest(fps, min_bytes, max_bits):
                at = np.array(links)
                add(0, signed[at[:, 0]], signed[at[:, 1]])
            if len(out) > 2000:
                yield packed()
                out.clear()
        yield packed()

    return run


def _balls(reach: int):
    """Every value at ``reach`` differing bits or fewer from each fingerprint, with the fingerprint.

    Two fingerprints differ in at most 2 * reach bits exactly if some value is within reach of both; and all fingerprints
    within reach of one value are linked to each other. So the fingerprints under one value, at most as many as a ball
    has values, form one star: an exact and linear way for crowded lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [0] + [sum(1 << i for i in c) for n in range(1, reach + 1) for c in combinations(range(64), n)]
        masks = np.array(masks, np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                f = whole.column(0).slice(at, 64).to_numpy()
                yield pa.RecordBatch.from_arrays([_signed((f.view(np.uint64)[:, None] ^ masks[None]).ravel()), pa.array(np.repeat(f, len(masks)))], names=["_key", "_f"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, f), kind in _groups(batches, 1 << 20):
        if kind == "pairs":
            rest, least = f.reshape(-1, 2).max(axis=1), f.reshape(-1, 2).min(axis=1)
        else:
            rest = f[f != f.min()]
            least = np.full(len(rest), f.min())
        yield pa.RecordBatch.from_arrays([pa.array(rest), pa.array(least)], names=["_a", "_b"])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, list_cap: int = LIST_CAP) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row an input row; component_id is the smallest id reachable over links.

    Two 64-bit fingerprints link if they differ in at most ``max_bits`` bits (0, 2 or 4); no link is lost. Lists over
    ``list_cap`` members take another exact way (see _balls). A null or empty text has fingerprint zero and links like
    any other. Ids are integers; a null id is never the smallest, and a component of null ids alone has a null
    component_id; repeated rows get the same component. Other columns are not read. An empty table gives an empty one.
    """
    if max_bits not in (0, 2, 4):
        raise ValueError("max_bits must be 0, 2 or 4, for which every way is exact")
    tune(docs.sparkSession)
    marked = saved(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(_fingerprints(shingle), "_id long, _f long"))
    entries = saved(marked.groupBy("_f").agg(F.min("_id").alias("_least")))
    least = 8 - max_bits

    def lists(rows: DataFrame, run, schema: str) -> DataFrame:
        return saved(rows.repartition(F.col("_key")).sortWithinPartitions("_key", "_f").mapInArrow(run, schema))

    found = lists(entries.select("_f").mapInArrow(_postings(covering_triples(8, least)), "_key long, _f long"), _compare(least, max_bits, list_cap), "_kind long, _a long, _b long")
    links = found.filter("_kind = 0").select("_a", "_b").distinct()
    crowded = found.filter("_kind = 1").select(F.col("_a").alias("_f")).distinct()
    if crowded.limit(1).count():
        links = links.union(lists(crowded.mapInArrow(_balls(max_bits // 2), "_key long, _f long"), _stars, "_a long, _b long"))
    roots = components(links.select(F.col("_a").alias("u"), F.col("_b").alias("v")))
    placed = saved(entries.join(roots, entries["_f"] == roots["node"], "left").select("_f", "_least", F.coalesce("root", "_f").alias("_root")))
    named = saved(placed.join(placed.groupBy("_root").agg(F.min("_least").alias("_component")), "_root").select("_f", "_component"))
    return marked.join(named, "_f").select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_f"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """near_groups() of all documents. Its jobs run when it is called; the returned frame reads their saved results."""
    return near_groups(table(spark, sf_dir, "documents"))
