"""Chat formatting by columnar byte assembly.

A conversation becomes one string: for every turn a header with its role, its text and an end mark. Control strings
cannot occur in texts, as their first characters are escaped there, reversibly. Segment lengths, cumulative offsets
and scatter indices are computed for a whole batch in numpy; all bytes are copied into one preallocated buffer, which
is the string column. The loss mask is the byte spans of the assistant's texts in that string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tune

#: Template: <s>[ROLE]role[/ROLE]text</s> and a line end, a turn.
OPEN, MIDDLE, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
FORMATTED = "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>"


def escape(texts: pa.Array) -> pa.Array:
    for plain, code in ESCAPES:
        texts = pc.replace_substring(texts, plain, code)
    return texts


def unescape(text: str) -> str:
    for plain, code in reversed(ESCAPES):
        text = text.replace(code, plain)
    return text


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All strings' bytes in a row, and each one's length."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return flat, np.diff(offsets)


def _scatter(out: np.ndarray, flat: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> None:
    """Copy the i-th string of ``flat`` to place to[i] of ``out``."""
    starts = np.cumsum(lengths) - lengths
    out[np.arange(len(flat)) + np.repeat(to - starts, lengths)] = flat


def assemble(roles: pa.Array, texts: pa.Array, turns: np.ndarray, loss_role: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """One string a conversation of turns[i] turns; for each loss turn its conversation and byte span in that string."""
    n = len(roles)
    heads = pc.binary_join_element_wise(pa.array([OPEN] * n, pa.string()), escape(roles), pa.array([MIDDLE] * n, pa.string()), "")
    (head, head_n), (body, body_n), close = _bytes(heads), _bytes(escape(texts)), np.frombuffer(CLOSE.encode(), np.uint8)
    size = head_n + body_n + len(close)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    _scatter(out, head, head_n, at)
    _scatter(out, body, body_n, at + head_n)
    _scatter(out, np.tile(close, n), np.full(n, len(close)), at + head_n + body_n)
    ends = np.concatenate([[0], np.cumsum(turns)])
    offsets = np.concatenate([[0], np.cumsum(size)])[ends].astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(turns), pa.py_buffer(offsets), pa.py_buffer(out))
    where = np.flatnonzero(pc.equal(roles, loss_role).to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(len(turns)), turns)[where]
    start = (at + head_n)[where] - offsets[owner]
    return strings, owner, start, start + body_n[where]


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int64()))


def _format(loss_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column(1)
                turns = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten()
                roles, texts = (pc.fill_null(pc.struct_field(flat, i), "") for i in (1, 2))
                strings, owner, start, end = assemble(roles, texts, turns, loss_role)
                yield pa.RecordBatch.from_arrays([batch.column(0), strings.cast(pa.string()), _lists(owner, start, len(turns)), _lists(owner, end, len(turns))], names=["conv_id", "formatted", "loss_starts", "loss_ends"])

    return run


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) rows -> one row a conversation: its formatted string and the loss mask's byte spans.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have a defined order and all
    stay. A null role or text is empty; a row with a null conv_id is a conversation of its own; an empty table gives an
    empty table. A conversation is one training sample and is assembled in one task; other columns are not read.
    """
    tune(rows.sparkSession)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("_turn"))
    turns = slim.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("turns"))
    turns = turns.union(slim.filter("conv_id is null").select("conv_id", F.array("_turn")))
    return turns.mapInArrow(_format(loss_role), FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        if not turn.startswith(OPEN):
            raise ValueError("not a formatted conversation")
        role, _, text = turn[len(OPEN) :].partition(MIDDLE)
        out.append((unescape(role), unescape(text)))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns = read_turns(row["formatted"])
            data = row["formatted"].encode()
            loss = "".join(unescape(data[a:b].decode()) for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True))
            out.append((row["conv_id"], len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"])))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and number -7, formatted and read back from the formatted strings and their loss spans."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return format_chats(rows).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(21 + length(role || text) + (SELECT length(regexp_replace(role || text, '[^\\<\[]', '', 'g')))) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM joined
"""
