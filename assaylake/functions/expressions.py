"""Shapes of Java expressions: a lexer, brackets paired for a whole batch by prefix sums, and rules over the top-level parts.

Every text is read by the lexer once. The brackets of all texts of a batch are paired together: their nesting level is a
running sum, and on each level of a text an opening bracket belongs to the next closing one. The rules step from part to
part, over whole bracket groups, so that time is linear in the text however deep it nests.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, NUMBER, TEXT, ARROW, OPERATOR, OPEN, CLOSE, MARK = range(8)
_DIGITS = r"\d[\d_]*"
#: The tokens of the Java Language Specification (chapter 3) that shapes need. An operator is binary where it stands between blanks, as printed sources have it.
TOKEN = re.compile(
    "|".join(
        [
            r"(?P<text>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')",
            r"(?P<operator>(?<= )(?:instanceof|>{2,3}|<<|&&|\|\||[=!<>]=|[-+*/%<>&|^])(?= ))",
            r"(?P<word>[A-Za-z_$][\w$]*)",
            rf"(?P<number>0[xX][\da-fA-F_]+[lL]?|{_DIGITS}(?:\.\d+)?[dDfFlL]?)",
            r"(?P<arrow>->|::)",
            r"(?P<open>[(\[])",
            r"(?P<close>[)\]])",
            r"(?P<mark>\S)",
        ]
    ),
    re.S,
)
_KINDS = {"word": WORD, "number": NUMBER, "text": TEXT, "arrow": ARROW, "operator": OPERATOR, "open": OPEN, "close": CLOSE, "mark": MARK}


class Tokens:
    """The tokens of one text: kinds, spans and values, the partner of each bracket (-1: none), and how many round brackets open before each."""

    def __init__(self, text: str):
        found = list(TOKEN.finditer(text))
        self.kinds = [_KINDS[m.lastgroup] for m in found]
        self.spans = [m.span() for m in found]
        self.values = [m.group() for m in found]
        self.partner: list[int] = []
        self.rounds: list[int] = []


def paired(texts: list[str]) -> list[Tokens]:
    """Tokens of each text, with the brackets of all of them paired at once."""
    out = [Tokens(t) for t in texts]
    sizes = np.array([len(t.kinds) for t in out], np.int64)
    kinds = np.concatenate([np.array(t.kinds, np.int8) for t in out]) if len(out) else np.zeros(0, np.int8)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(out)), sizes)
    step = (kinds == OPEN).astype(np.int64) - (kinds == CLOSE)
    depth = np.cumsum(step)
    depth -= np.repeat(np.concatenate([[0], depth])[starts], sizes)  # every text starts at 0
    at = np.flatnonzero(step)
    level = depth[at] + (step[at] < 0)
    order = at[np.lexsort((at, level, owner[at]))]
    levels = depth[order] + (step[order] < 0)
    first, second = order[:-1], order[1:]
    joined = (step[first] > 0) & (step[second] < 0) & (owner[first] == owner[second]) & (levels[:-1] == levels[1:])
    partner = np.full(len(kinds), -1)
    partner[first[joined]], partner[second[joined]] = second[joined], first[joined]
    shifted = np.where(partner < 0, -1, partner - np.repeat(starts, sizes))
    rounds = np.cumsum(np.array([v == "(" for t in out for v in t.values], np.int64))
    for t, a, n in zip(out, starts.tolist(), sizes.tolist(), strict=True):
        t.partner, t.rounds = shifted[a : a + n].tolist(), rounds[a : a + n].tolist()
    return out


def _inside(t: Tokens, lo: int, hi: int) -> tuple[int, int]:
    """Without the pairs of round brackets that enclose all of it."""
    while lo < hi and t.values[lo] == "(" and t.partner[lo] == hi - 1:
        lo, hi = lo + 1, hi - 1
    return lo, hi


def _is_cast(t: Tokens, lo: int, hi: int) -> bool:
    """A type in round brackets before something that can be cast."""
    end = t.partner[lo]
    if t.values[lo] != "(" or not lo + 1 < end < hi - 1 or t.kinds[lo + 1] != WORD:
        return False
    types = all(k in (WORD, NUMBER) or v in (".", ",", "<", ">", "[", "]") for k, v in zip(t.kinds[lo + 1 : end], t.values[lo + 1 : end], strict=True))
    return types and (t.kinds[end + 1] in (WORD, NUMBER, TEXT) or t.values[end + 1] == "(")


def _parts(t: Tokens, lo: int, hi: int) -> list[int]:
    """The tokens at the top level; a bracket group is its opening token."""
    out = []
    while lo < hi:
        out.append(lo)
        lo = t.partner[lo] + 1 if t.kinds[lo] == OPEN and t.partner[lo] >= 0 else lo + 1
    return out


def _links(t: Tokens, parts: list[int]) -> list[list[int]]:
    """The parts between dots, without type arguments."""
    angles, gone = [], set()
    for n, i in enumerate(parts):
        if t.values[i] == "<" and t.kinds[i] == MARK:
            angles.append(n)
        elif t.values[i] == ">" and t.kinds[i] == MARK and angles:
            start = angles.pop()
            if not angles:
                gone.update(range(start, n + 1))
    links: list[list[int]] = [[]]
    for n, i in enumerate(parts):
        if n not in gone:
            if t.values[i] == ".":
                links.append([])
            else:
                links[-1].append(i)
    return links


def shape(t: Tokens) -> str:
    """The shape of a lexed expression. The names of shapes are fixed values."""
    if ARROW in t.kinds:
        return "LAMBDA_OR_METHODREF"
    lo, hi = _inside(t, 0, len(t.kinds))
    while lo < hi and _is_cast(t, lo, hi):
        lo, hi = _inside(t, t.partner[lo] + 1, hi)
    if lo == hi:
        return "FIELD_OR_QUALIFIED_NAME"
    kinds, values = t.kinds[lo:hi], t.values[lo:hi]
    negative = len(kinds) == 2 and values[0] == "-" and t.spans[lo][1] == t.spans[lo + 1][0]
    if kinds[negative:] == [NUMBER] or kinds == [TEXT] or (kinds == [WORD] and values[0] in ("true", "false", "null")):
        return "LITERAL"
    if kinds == [WORD]:
        return "VARIABLE"
    parts = _parts(t, lo, hi)
    if values[0] in ("!", "~") or any(t.kinds[i] == OPERATOR or t.values[i] == "?" for i in parts):
        return "OPERATOR_COMPOSITE"
    adjoining = all(t.spans[a][1] == t.spans[b][0] for a, b in pairwise(parts))
    if len(parts) % 2 and adjoining and all(t.values[i] == "." if n % 2 else t.kinds[i] == WORD for n, i in enumerate(parts)):
        return "FIELD_OR_QUALIFIED_NAME"
    if values[-1] == "]":
        return "ARRAY_INDEX"
    links = _links(t, parts)
    # A link calls if it has round brackets, or an index in which something is called.
    calls = [any(t.kinds[i] == OPEN and t.partner[i] >= 0 and t.rounds[t.partner[i]] > t.rounds[i] - (t.values[i] == "(") for i in link) for link in links]
    made = len(values) > 1 and values[0] == "new" and t.spans[lo][1] < t.spans[lo + 1][0]
    number = sum(calls[1:] if made else calls)
    last = links[-1][-1] if links[-1] else -1
    bare = last >= 0 and t.values[last] == "(" and t.partner[last] == last + 1
    if made:
        return "CTOR_ONLY" if not number else "CHAINED_CALLS" if number > 1 else "CTOR_RECEIVER_CALL_0ARG" if bare else "CTOR_RECEIVER_CALL_NARG"
    if number > 1:
        return "CHAINED_CALLS_END0ARG" if bare else "CHAINED_CALLS_ENDNARG"
    return "SINGLE_CALL" if number else "FIELD_OR_QUALIFIED_NAME"


def ends_in_arguments(t: Tokens) -> bool:
    """Whether the text ends in a bracket group that holds anything."""
    end = len(t.kinds) - 1
    return end >= 0 and t.values[end] == ")" and 0 <= t.partner[end] < end - 1


#: Characters whose tokens a task holds at once; a longer text is held alone.
SLICE = 1 << 18


def _tokens(texts: Iterable[str | None]) -> Iterator[Tokens]:
    """Tokens of each text in turn (of missing ones, none), lexed and paired in slices: tokens take a hundred times their text, and a batch has thousands of texts."""
    held, size = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if held and size + len(text) > SLICE:
            yield from paired(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    yield from paired(held)


def _shapes(texts: pd.Series) -> pd.Series:
    return pd.Series(["UNEXTRACTABLE" if missing else shape(t) for missing, t in zip(pd.isna(texts), _tokens(texts), strict=True)], dtype="object")


def _arguments(texts: pd.Series) -> pd.Series:
    return pd.Series([ends_in_arguments(t) for t in _tokens(texts)], dtype="bool")


def _any_arguments(lists: pd.Series) -> pd.Series:
    sizes = [0 if x is None else len(x) for x in lists]
    flat = (ends_in_arguments(t) for t in _tokens(s for x in lists if x is not None for s in x))
    return pd.Series([any([next(flat) for _ in range(n)]) for n in sizes])


def expression_shape(expression: Column) -> Column:
    """The shape of each expression; UNEXTRACTABLE for null."""
    return F.pandas_udf(_shapes, "string")(expression)


def call_has_arguments(source: Column) -> Column:
    """Whether the last call in a source passes anything; false for null."""
    return F.pandas_udf(_arguments, "boolean")(source)


def any_call_has_arguments(sources: Column) -> Column:
    """The same for an array: whether one of its sources does."""
    return F.pandas_udf(_any_arguments, "boolean")(sources)
