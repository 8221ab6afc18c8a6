"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

The letters are dealt to LEVELS groups of about equal use. A word's vector says how many of its letters each group has;
one inserted, deleted or replaced letter raises one count by one at most, and lowers one by one at most. The words are
arranged in a trie by the first group's count, then by the second's, and so on. A search goes depth first and may spend a
surplus of one and a deficit of one on its way down; the words of the leaves that it reaches are verified letter by letter.

The trie's upper levels are a shuffle key: a word lives at its own key, and asks at each later key that the same budget
reaches, so that every pair is met once. The key has as many levels as keep a node within NODE words; a node that is
larger still with all levels is cut in blocks.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table, tune

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEVELS, NODE, LEAF = 12, 6_000, 8
#: Words up to this length are verified as rows of a matrix, longer ones one by one.
WIDTH = 48
#: Different words that a task counts, queries that descend together, pairs that are verified together.
COUNTED, ASKED, VERIFIED = 1 << 19, 1 << 14, 1 << 19
#: Counts above are one: equal or next counts stay equal or next.
TOP = 250


def _runs(text: str) -> Counter:
    return Counter(RUN.findall(text) if len(text) < 1 << 20 else (m.group() for m in RUN.finditer(text)))


def _count(drop_every: int, min_chars: int):
    """(word, n) of each task's documents; a word may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), pc.ascii_lower(pc.fill_null(batch.column(1), "")).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if ident is None else ident}:".encode())
                for word, n in _runs(text).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % drop_every == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= min_chars:
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield flush()
        yield flush()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, drop_every: int = 97) -> DataFrame:
    """(word, n): the runs of letters in A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, with at least ``min_chars`` letters, that occur ``min_count`` times or more.

    A run whose CRC-32 with its document's id (``<id>:<run>``, a null id as nothing) is divided by ``drop_every`` loses one letter first, at that number's place.
    """
    tune(docs.sparkSession)
    counts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(_count(drop_every, min_chars), "word string, n long")
    return saved(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the words, one byte each, and the words' lengths."""
    coded = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(coded), np.uint8), np.fromiter(map(len, coded), np.int64, len(coded))


def _use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        total += np.bincount(_letters(batch.column(0))[0], minlength=256)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["letter", "n"])


def letter_groups(words: DataFrame) -> np.ndarray:
    """Group of each letter: the most used letters go first, each to the group used least so far."""
    used = words.select("word").mapInArrow(_use, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").collect()  # a row a letter
    groups, load = np.zeros(256, np.uint8), [(0, g) for g in range(LEVELS)]
    for row in used:
        n, g = heapq.heappop(load)
        groups[row.letter] = g
        heapq.heappush(load, (n + row.n, g))
    return groups


def _vectors(words: pa.Array, groups: np.ndarray) -> np.ndarray:
    letters, lengths = _letters(words)
    at = np.repeat(np.arange(len(lengths)), lengths) * LEVELS + groups[letters]
    return np.minimum(np.bincount(at, minlength=len(lengths) * LEVELS), TOP).astype(np.uint8).reshape(-1, LEVELS)


def _keys(vectors: np.ndarray) -> pa.Array:
    return pa.array([bytes(v) for v in vectors], pa.binary())


def _with_vectors(groups: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _keys(_vectors(batch.column(0), groups))], names=["word", "n", "vector"])

    return run


def later_keys(depth: int) -> np.ndarray:
    """What leads from a key to each later one in the budget's reach: the first change is a surplus."""
    steps = []
    for up, down in itertools.product(range(-1, depth), repeat=2):
        if up >= 0 and up != down and (down < 0 or up < down):
            step = np.zeros(depth, np.int16)
            step[up] = 1
            if down >= 0:
                step[down] = -1
            steps.append(step)
    return np.array(steps).reshape(-1, depth)


def _ask(depth: int):
    """The words' rows at their own key (asks false) and at the later ones (asks true)."""
    steps = later_keys(depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, LEVELS)[:, :depth]
            rows, asks, keys = [np.arange(len(vectors))], [np.zeros(len(vectors), bool)], [vectors]
            for step in steps:
                moved = vectors + step
                fine = np.flatnonzero((moved >= 0).all(axis=1))
                rows.append(fine)
                asks.append(np.ones(len(fine), bool))
                keys.append(moved[fine].astype(np.uint8))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([_keys(np.concatenate(keys)), pa.array(np.concatenate(asks)), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "asks", "word", "n"])

    return run


class Words:
    """Words with their vectors, and the letters of the short ones as a matrix."""

    def __init__(self, words: list[str], counts: list[int], groups: np.ndarray):
        column = pa.array(words, pa.string())
        letters, self.lengths = _letters(column)
        self.words, self.counts, self.vectors = words, np.array(counts, np.int64), _vectors(column, groups).astype(np.int16)
        width = int(min(WIDTH, self.lengths.max(initial=1))) + 1
        self.matrix = np.zeros((len(words), width), np.uint8)
        row = np.repeat(np.arange(len(words)), self.lengths)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        short = place < width
        self.matrix[row[short], place[short]] = letters[short]

    def take(self, order: np.ndarray) -> Words:
        out = object.__new__(Words)
        out.words, out.counts, out.vectors, out.lengths, out.matrix = [self.words[i] for i in order], self.counts[order], self.vectors[order], self.lengths[order], self.matrix[order]
        return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


def _verified(home: Words, asking: Words, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are exactly one edit apart."""
    gap = home.vectors[i] - asking.vectors[j]
    fine = (np.maximum(gap, 0).sum(axis=1) < 2) & (np.minimum(gap, 0).sum(axis=1) > -2) & (abs(home.lengths[i] - asking.lengths[j]) < 2)
    i, j = i[fine], j[fine]
    long = np.maximum(home.lengths[i], asking.lengths[j]) > WIDTH
    by_hand = np.array([one_edit(home.words[x], asking.words[y]) for x, y in zip(i[long], j[long], strict=True)], bool)
    out = [(i[long][by_hand], j[long][by_hand])]
    i, j = i[~long], j[~long]
    width = min(home.matrix.shape[1], asking.matrix.shape[1])
    same = home.lengths[i] == asking.lengths[j]
    if same.any():
        x, y = i[same], j[same]
        near = (home.matrix[x][:, :width] != asking.matrix[y][:, :width]).sum(axis=1) == 1
        out.append((x[near], y[near]))
    for one, two, x, y in ((home, asking, i, j), (asking, home, j, i)):
        less = one.lengths[x] < two.lengths[y]
        if less.any():
            p, q = x[less], y[less]
            cut = min(one.matrix.shape[1], two.matrix.shape[1] - 1)
            short, whole, length = one.matrix[p][:, :cut], two.matrix[q], one.lengths[p][:, None]
            inside = np.arange(cut) < length
            ahead = ((short == whole[:, :cut]) | ~inside).cumprod(axis=1).astype(np.int64)
            same_ahead = np.minimum(ahead.sum(axis=1), one.lengths[p])
            behind = (short == whole[:, 1 : cut + 1]) | (np.arange(cut) < same_ahead[:, None]) | ~inside
            near = behind.all(axis=1)
            out.append((p[near], q[near]) if one is home else (q[near], p[near]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


class Trie:
    """Words sorted by their vectors: a node of the trie is a range of them."""

    def __init__(self, words: Words):
        self.home = words.take(np.lexsort(words.vectors.T[::-1]))

    def search(self, asking: Words, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in the trie, place in ``asking``) one edit apart; with ``own`` both are the trie's words, and each pair comes once."""
        held, size = [], 0
        for lo, hi, q in self._leaves(0, len(self.home.words), 0, asking, np.arange(len(asking.words)), np.ones(len(asking.words), bool), np.ones(len(asking.words), bool)):
            for part in np.array_split(q, -(-len(q) * (hi - lo) // VERIFIED)):
                i, j = np.repeat(np.arange(lo, hi), len(part)), np.tile(part, hi - lo)
                if own:
                    i, j = i[i > j], j[i > j]
                held.append((i, j))
                size += len(i)
                if size >= VERIFIED:
                    yield _verified(self.home, asking, *map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield _verified(self.home, asking, *map(np.concatenate, zip(*held, strict=True)))

    def _leaves(self, lo: int, hi: int, level: int, asking: Words, q: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
        """Depth first: ranges of words, and the queries whose budget reaches them."""
        if hi - lo <= LEAF or level == LEVELS:
            if len(q):
                yield lo, hi, q
            return
        counts, asked = self.home.vectors[lo:hi, level], asking.vectors[q, level]
        cuts = [lo, *(np.flatnonzero(counts[1:] != counts[:-1]) + lo + 1), hi]
        for a, b in itertools.pairwise(cuts):
            gap = self.home.vectors[a, level] - asked
            more, less = gap == 1, gap == -1
            go = np.flatnonzero((gap == 0) | (more & surplus) | (less & deficit))
            if len(go):
                yield from self._leaves(a, b, level + 1, asking, q[go], surplus[go] & ~more[go], deficit[go] & ~less[go])


def _search(groups: np.ndarray):
    """Rows of a node come together, its own words first; (word, n, other, other_n) of each pair, both ways."""

    def found(trie: Trie, asking: Words, own: bool) -> Iterator[pa.RecordBatch]:
        for i, j in trie.search(asking, own):
            if len(i):
                a, b = [trie.home.words[x] for x in i], [asking.words[x] for x in j]
                m, n = trie.home.counts[i], asking.counts[j]
                yield pa.RecordBatch.from_arrays([pa.array(a + b, pa.string()), pa.array(np.concatenate([m, n])), pa.array(b + a, pa.string()), pa.array(np.concatenate([n, m]))], names=["word", "n", "other", "other_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, trie, words, counts = None, None, [], []

        def flush():
            nonlocal trie, words, counts
            if words and trie is None:
                trie = Trie(Words(words, counts, groups))
                yield from found(trie, trie.home, True)
            elif words and trie.home.words:
                yield from found(trie, Words(words, counts, groups), False)
            words, counts = [], []

        for batch in batches:
            for key, block, asks, word, n in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "asks", "word", "n")), strict=True):
                if (key, block) != node:
                    yield from flush()
                    node, trie = (key, block), None
                if asks and trie is None:
                    yield from flush()
                    trie = trie or Trie(Words([], [], groups))
                words.append(word)
                counts.append(n)
                if asks and len(words) >= ASKED:
                    yield from flush()
        yield from flush()

    return run


def near_words(words: DataFrame, node: int = NODE) -> DataFrame:
    """(word, n) -> (word, n, other, other_n): every two words exactly one inserted, deleted or replaced letter apart, both ways. Words are different and of the letters of vocabulary()."""
    groups = letter_groups(words)
    placed = saved(words.select("word", "n").mapInArrow(_with_vectors(groups), "word string, n long, vector binary"))
    classes = saved(placed.groupBy("vector").agg(F.count("*").alias("n")))
    for depth in range(3, LEVELS + 1):
        largest = classes.groupBy(F.substring("vector", 1, depth)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= node:
            break
    dealt = placed.mapInArrow(_ask(depth), "key binary, asks boolean, word string, n long")
    blocks = -(-largest // node)
    if blocks <= 1:
        dealt = dealt.withColumn("block", F.lit(0))
    else:  # all levels are used: words live in one block each, and ask in all blocks of the other keys and the later ones of their own
        own = F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int")
        asked = F.when(F.col("asks"), F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.sequence(own, F.lit(blocks - 1)))
        dealt = dealt.withColumn("own", own).withColumn("block", F.explode(asked)).withColumn("asks", F.col("asks") | (F.col("block") != F.col("own")))
    dealt = dealt.select("key", "block", "asks", "word", "n").repartition("key", "block").sortWithinPartitions("key", "block", "asks")
    return dealt.mapInArrow(_search(groups), "word string, n long, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without nulls and cycles -> (word, root), by doubling: each step replaces a word's pointer by its target's."""
    at = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = saved(at.join(ahead, "root", "left"))
        at = moved.select("word", F.coalesce("_next", "root").alias("root"))
        if not moved.filter("_next is not null").limit(1).count():
            return at


def group_spellings(docs: DataFrame, node: int = NODE, **options) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of vocabulary(docs, **options).

    Near words are exactly one edit apart. A word's form is its near word of largest n (ties: smallest in code-point order)
    if that n is at least twice the word's, else null; its root is where the forms lead. A null text has no words; rows
    with the same id or none count like any others; without words the result is empty. Further columns are not read.
    """
    words = vocabulary(docs, **options)
    near = near_words(words, node).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = saved(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= 2 * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("best")))
    forms = joined.select("word", "best.form", "n", "n_near", "best.form_n")
    ends = roots(forms.filter("form is not null"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """group_spellings() of all documents. Words and forms are found when it is called; the returned frame joins their saved rows."""
    return group_spellings(table(spark, sf_dir, "documents").select("doc_id", "text"))
