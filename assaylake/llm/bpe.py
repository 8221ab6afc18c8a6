"""Byte-level BPE encoding and decoding; long texts by tree concatenation.

The vocabulary is given as merge ranks (the same ids as its JSON form). A long text is cut; the pieces are encoded in
parallel tasks and concatenated pairwise, as a tree. Where a cut falls between a non-space and a space, every scan of
the text ends a pretoken there and the pieces' ids just follow each other. In unsplit text (a long run of letters,
spaces or signs, which is one pretoken) the halves do not fit at once: a window of tokens around the join is encoded
anew and grown until its first and last tokens agree with both halves, which makes all neighbouring pairs of tokens
valid, and so the whole sequence the encoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table, tune

SPECIAL = "<|endoftext|>"
#: Texts above LONG code points are cut into pieces of about PIECE.
LONG, PIECE = 1 << 15, 1 << 13
AGREE = 2


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def codec(path: str):
    """The encoder, and for decoding all tokens' bytes in one array with their starts and lengths."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    tokens = [b""] * (len(ranks) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    tokens[len(ranks)] = SPECIAL.encode()
    lengths = np.array([len(t) for t in tokens], np.int64)
    return encoder, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def encode(text: str, path: str) -> np.ndarray:
    encoder = codec(path)[0]
    return np.array(encoder.encode(text, allowed_special="all") if SPECIAL in text else encoder.encode_ordinary(text), np.uint32)


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    _, flat, starts, lengths = codec(path)
    n = lengths[ids]
    at = np.repeat(starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return flat[at].tobytes()


def decode(ids: np.ndarray, path: str) -> str:
    return decode_bytes(ids, path).decode("utf-8", "replace")


def _kind(c: str) -> int:
    return 1 if c.isalpha() else 2 if c.isspace() else 3 if c.isascii() and c.isprintable() and not c.isalnum() else 0


def _run(text: str, i: int, step: int, kind: int) -> int:
    """UTF-8 bytes of the run of ``kind`` from the cut at i to the left (step -1) or right (1); negative if an apostrophe before it may take letters of it."""
    n, j = 0, i - 1 if step < 0 else i
    while 0 <= j < len(text) and _kind(text[j]) == kind and not (text.startswith(SPECIAL, j) if step > 0 else text.endswith(SPECIAL, 0, j + 1)):
        n += len(text[j].encode("utf-8", "surrogatepass"))
        j += step
    return -n if step < 0 and j >= 0 and text[j] == "'" else n


def cuts(text: str, piece: int = PIECE) -> list[tuple[int, int, int, int]]:
    """(place, is inside a run, bytes of the run left of it, right of it), about ``piece`` code points apart, none inside a special token."""
    out, target = [], piece
    while target < len(text) - 16:
        found = None
        for i in range(target, min(target + piece // 4, len(text) - 16)):
            a, b = text[i - 1], text[i]
            if b in " \n" and a.isascii() and a.isprintable() and a not in " '" and SPECIAL not in text[i - 12 : i + 12]:
                found = (i, 0, 0, 0)
                break
        if not found:
            for i in range(target, len(text) - 16):
                kind = _kind(text[i])
                if kind and all(_kind(c) == kind for c in text[i - 16 : i + 16]):
                    right = _run(text, i, 1, kind)
                    found = (i, 1, _run(text, i, -1, kind), right - (kind == 2) if kind == 2 else right)
                    break
                if text[i] in " \n" and text[i - 1].isascii() and text[i - 1].isprintable() and text[i - 1] not in " '" and SPECIAL not in text[i - 12 : i + 12]:
                    found = (i, 0, 0, 0)
                    break
        if not found:
            break
        out.append(found)
        target = found[0] + piece
    return out


def join(left: np.ndarray, right: np.ndarray, left_run: int, right_run: int, path: str) -> np.ndarray:
    """The encoding of two encoded halves of one run; ``left_run``, ``right_run``: the run's bytes in each."""
    encoder, _, _, lengths = codec(path)
    known = left_run > 0
    most_left = min(len(left), int(np.searchsorted(np.cumsum(lengths[left[::-1]]), abs(left_run) - 2 * (not known))) + known)
    reach = np.cumsum(lengths[right])
    most_right = min(len(right), int(np.searchsorted(reach, right_run, side="right")))
    w = 8
    while True:
        a, b = min(w, most_left), min(w, most_right)
        old = np.concatenate([left[len(left) - a :], right[:b]])
        new = np.array(encoder._encode_single_piece(decode_bytes(old, path)), np.uint32)
        left_fits = (known and a == most_left) or (len(new) > 2 * AGREE and np.array_equal(new[:AGREE], old[:AGREE]))
        right_fits = b == most_right or (len(new) > 2 * AGREE and np.array_equal(new[-AGREE:], old[-AGREE:]))
        if left_fits and right_fits:
            return np.concatenate([left[: len(left) - a], new, right[b:]])
        if a == most_left and b == most_right:
            return encode(decode(np.concatenate([left, right]), path), path)
        w *= 2


def concatenate(parts: list[tuple[np.ndarray, int, int, int]], path: str) -> np.ndarray:
    """Pairwise, as a tree. parts: ids, and of the cut before them: is inside a run, its bytes to the left and right."""
    while len(parts) > 1:
        merged = []
        for i in range(0, len(parts) - 1, 2):
            (a, *cut), (b, inside, left_run, right_run) = parts[i], parts[i + 1]
            merged.append((join(a, b, left_run, right_run, path) if inside else np.concatenate([a, b]), *cut))
        parts = merged + parts[len(parts) - len(parts) % 2 :]
    return parts[0][0]


def _cut(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = [(0, 0, 0, 0), *cuts(text, piece)]
                ends = [*(x[0] for x in at[1:]), len(text)]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([key] * len(at), pa.string()),
                    "part": pa.array(range(len(at)), pa.int32()),
                    **{n: pa.array([x[i] for x in at], pa.int64()) for i, n in ((1, "inside"), (2, "left_run"), (3, "right_run"))},
                    "piece": pa.array([text[x[0] : e] for x, e in zip(at, ends, strict=True)], pa.string()),
                })

    return run


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(t, path).astype("<u4").tobytes() for t in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ids, pa.binary())], names=[*batch.schema.names[:5], "ids"])

    return run


def _ids(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u4").astype(np.uint32)


def _concatenate_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                out.append(concatenate([(_ids(p["ids"]), p["inside"], p["left_run"], p["right_run"]) for p in parts], path).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "ids"])

    return run


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t, path).astype("<u4").tobytes() for t in texts], pa.binary())], names=["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """(doc_id, ids) of every row: ids as little-endian unsigned 32-bit integers in a binary.

    The special string <|endoftext|> in a text is its own id; no other special token is added. A null text is encoded
    as the empty text (no ids); null and repeated ids are kept row by row; an empty table gives an empty table. Texts above ``long`` code points
    take the tree way, each different one once.
    """
    tune(docs.sparkSession)
    path = ranks or default_ranks()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > long
    short = rows.filter(~is_long).mapInArrow(_encode_rows(path), "doc_id long, ids binary")
    keyed = saved(rows.filter(is_long).withColumn("key", F.sha2(F.col("text").cast("binary"), 256)))
    texts = keyed.groupBy("key").agg(F.min_by("text", "doc_id").alias("a"), F.min("text").alias("b")).select("key", F.coalesce("a", "b").alias("text"))
    pieces = texts.mapInArrow(_cut(piece), "key string, part int, inside long, left_run long, right_run long, piece string")
    encoded = pieces.repartition(F.col("key"), F.col("part")).mapInArrow(_encode_pieces(path), "key string, part int, inside long, left_run long, right_run long, ids binary")
    parts = encoded.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "inside", "left_run", "right_run", "ids"))).alias("parts"))
    whole = saved(parts.mapInArrow(_concatenate_rows(path), "key string, ids binary"))
    return short.unionByName(keyed.select("doc_id", "key").join(whole, "key").select("doc_id", "ids"))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column(1).to_pylist()
            texts = [decode(_ids(x), path) for x in all_ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in all_ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in all_ids]),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def decode_digests(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids) -> doc_id, n_tokens, and the SHA-256 of the ids and of the text that they decode to."""
    return encoded.mapInArrow(_digests(ranks or default_ranks()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as digests. The cutting and joining of long texts runs when it is called."""
    return decode_digests(encode_documents(table(spark, sf_dir, "documents")))
