"""Near copies by the similarity of the texts' sets of word shingles, found over SimHash fingerprints.

A byte-position inverted index lists wide fingerprints under pairs of byte places. The places are dealt to spans, and
every pair of places of a span has its lists, so that two fingerprints which share more bytes at their places than there
are spans meet in a list (of any such number of places two lie in one span). Members of a list that also agree in most
of the other bits that a posting carries are tied into candidate groups; the number of these bits grows with the rows, so
that chance ties stay rare at any size. Within a group the shared positional bytes of
each pair are tallied, pairs below the minimum are dropped, and the similarity of the rest is counted exactly. Equal
sets of shingles are one entry, so exact copies cost nothing.

A large group is first joined by verified links of its index lists; then only what these left apart is compared, block
by block, each two blocks by one task, which gives back links that connect, not pairs. So the work is linear in copies
that a few links join, and quadratic only in texts that are near by their fingerprints and yet not similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, tune
from .components import components
from .simhash import _bytes, _folded, _signed

#: Bits of a list's number.
LIST_BITS = 10
#: Other texts, on average, that a text may be tied to by chance (see beside_words()).
FALSE_TIES = 0.01
#: Members of a list that are compared with each other; of longer lists all members are tied to the first, as candidates.
LIST_CAP = 4096
#: Members of a block of a large group, and of a group that is compared whole.
BLOCK = 512
#: Shared bytes at their places that a pair of a group must have to be compared (see shared_minimum()).
LOSS = 1e-4


def index_design(rows: int) -> tuple[int, int, int]:
    """(bytes a key, words of 64 bits, places a span): lists stay short as keys grow with the rows.

    With two bytes a key and 768 bits in spans of four places a document has 144 postings; from 2**28 different texts on
    three bytes, in spans of eight places of 1,024 bits, 896 postings.
    """
    return (2, 12, 4) if rows < 2**28 else (3, 16, 8)


def differing(min_jaccard: float) -> float:
    """Share of fingerprint bits that differ, on average, between two sets of one size with this similarity."""
    return math.acos(2 * min_jaccard / (1 + min_jaccard)) / math.pi


def carried_bits(key_bytes: int, words: int, min_jaccard: float) -> tuple[int, int]:
    """(bits that a posting carries below and beside its key, how many of them may differ in a tie): all but 2 in 1,000 pairs at ``min_jaccard`` are tied."""
    carried, p = 64 - LIST_BITS - 8 * key_bytes + 64 * words, differing(min_jaccard)
    return carried, round(carried * p + 3.1 * math.sqrt(carried * p * (1 - p)))


def false_ties(rows: int, design: tuple[int, int, int], words: int, min_jaccard: float) -> float:
    """How many texts without anything in common a text is tied to, on average: those that it meets in its lists, by the chance of a tie."""
    key_bytes, words64, span = design
    carried, most = carried_bits(key_bytes, words, min_jaccard)
    met = len(spans(words64, span, key_bytes)) * rows / 256**key_bytes
    return met * sum(math.comb(carried, k) for k in range(most + 1)) / 2**carried


def beside_words(rows: int, design: tuple[int, int, int], min_jaccard: float) -> int:
    """Words of 64 bits that a posting carries beside its key: as many as keep false ties rare, so that they never join the corpus."""
    return next(w for w in range(1, design[1] - 5) if false_ties(rows, design, w, min_jaccard) < FALSE_TIES)


def shared_minimum(words64: int, min_jaccard: float, loss: float = LOSS) -> int:
    """The most shared bytes that all but a ``loss`` share of the pairs at ``min_jaccard`` reach."""
    n, p, below = 8 * words64, (1 - differing(min_jaccard)) ** 8, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > loss:
            return k
    return n


class _Words(dict):
    """Hashes of words, each different one hashed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def shingle_set(text: str | None, k: int, words: _Words) -> np.ndarray:
    """Sorted 64-bit hashes of the different k-word shingles (fewer words: the whole sequence; none: empty), A-Z in lower case."""
    tokens = (text or "").encode().lower().split()  # on bytes: A-Z only, and exactly the ASCII white space
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _describe(shingle: int, words64: int):
    """Every row's columns but the text, the fingerprint of its set of shingles, and a 128-bit hash of the set."""
    names = [*(f"_f{i}" for i in range(words64)), "_s0", "_s1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            rows = []
            for t in batch.column(0):
                hashes = shingle_set(t.as_py(), shingle, words)
                rows.append(np.concatenate([_folded(hashes, words64), np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<u8")]))
            fps = np.array(rows, np.uint64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(_signed(fps[:, i]) for i in range(len(names)))], names=[*batch.schema.names[1:], *names])

    return run


def spans(words64: int, span: int, key_bytes: int) -> list[tuple[int, ...]]:
    """All sets of ``key_bytes`` places within each span of ``span`` places."""
    return [c for at in range(0, 8 * words64, span) for c in combinations(range(at, at + span), key_bytes)]


def _post(places: list, first: int, words64: int, words: int):
    """(_key, _node, _g0 ..): the list with, below it, bits of one word; and other words. places[i] has list number first + i."""
    key_bytes = len(places[0])
    below = 64 - LIST_BITS - 8 * key_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                node = batch.column(0).to_numpy()
                fps = np.stack([batch.column(i + 1).to_numpy().view(np.uint64) for i in range(words64)], axis=1)
                b = _bytes(fps).astype(np.uint64)
                keys, beside = [], [[] for _ in range(words)]
                for j, chosen in enumerate(places, first):
                    key = np.full(len(node), j, np.uint64)
                    for place in chosen:
                        key = (key << np.uint64(8)) | b[:, place]
                    own = chosen[0] // 8
                    other = lambda k: (own + 1 + (j + k) % (words64 - 1)) % words64  # noqa: B023, E731
                    keys.append((key << np.uint64(below)) | (fps[:, other(0)] >> np.uint64(64 - below)))
                    for w in range(words):
                        beside[w].append(fps[:, other(5 + w)])
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), pa.array(np.tile(node, len(places))), *(_signed(np.concatenate(x)) for x in beside)], names=["_key", "_node", *(f"_g{w}" for w in range(words))])

    return run


def _span_tree(n: int, near) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (member, earlier member) that connect what all near pairs connect: breadth first from each start; near(front, rest) -> matrix."""
    left, links = np.arange(n), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            m = near(front, left)
            hit = m.any(axis=0)
            found = left[hit]
            links.append((found, front[m[:, hit].argmax(axis=0)] if len(found) else found))
            left, front = left[~hit], found
    return links


def _link(below: int, max_bits: int, cap: int):
    """(_a, _b): links between the nodes of each list, no more than the list has members (short lists: all near pairs)."""
    down = np.uint64(64 - below)

    def distances(low, f, i, j):
        out = np.bitwise_count((low[i] ^ low[j]) << down).astype(np.uint16)
        for word in f:
            out += np.bitwise_count(word[i] ^ word[j])
        return out

    def of_list(low, node, f):
        if len(low) <= 1024:
            m = distances(low, f, (slice(None), None), (None, slice(None))) <= max_bits
            if m.sum() == len(m):  # each is near itself only
                return
            near = lambda a, b: m[np.ix_(a, b)]
        else:

            def near(a, b):
                return np.concatenate([distances(low, f, a[i : i + 64, None], b[None]) <= max_bits for i in range(0, len(a), 64)])

        for child, parent in _span_tree(len(low), near):
            yield node[child], node[parent]

    def of_lists(key, low, node, *f):
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes = np.diff(bounds)
        short = np.repeat(sizes <= 8, sizes)
        for d in range(1, 8):
            i = np.flatnonzero(short[:-d] & (key[:-d] == key[d:]))
            if not len(i):
                break
            hit = i[distances(low, f, i, i + d) <= max_bits]
            yield node[hit], node[hit + d]
        for r in np.flatnonzero(sizes > 8):
            a, b = bounds[r], bounds[r + 1]
            if sizes[r] > cap:
                yield node[a + 1 : b], np.full(b - a - 1, node[a])
            else:
                yield from of_list(low[a:b], node[a:b], [word[a:b] for word in f])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            columns = [whole >> np.uint64(below), whole, batch.column(1).to_numpy(), *(c.to_numpy().view(np.uint64) for c in batch.columns[2:])]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            last = int(np.flatnonzero(np.diff(columns[0]))[-1]) + 1 if columns[0][0] != columns[0][-1] else 0
            if last:
                yield from _pairs(of_lists(*(c[:last] for c in columns)))
                columns = [c[last:] for c in columns]
            elif len(columns[0]) > 4 * cap:  # a list that goes on: tie what is here to its first member and go on with that
                node = columns[2]
                yield from _pairs([(node[1:], np.full(len(node) - 1, node[0]))])
                columns = [c[np.zeros(cap + 1, int)] for c in columns]  # stays over the cap, so that the rest is tied to it too
            held = columns
        if held is not None:
            yield from _pairs(of_lists(*held))

    return run


def _pairs(links) -> Iterator[pa.RecordBatch]:
    """Different nodes' links, each once in its batch."""
    links = [x for x in links if len(x[0])]
    if links:
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        rows = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)])[:, a != b], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=["_a", "_b"])


def overlaps(sets: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at[0] with those at[1] (places in ``sets``), as a matrix product over the shared members."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    member = np.cumsum(new) - 1
    several = np.bincount(member) > 1 if len(flat) else np.zeros(0, bool)
    keep = several[member] if len(flat) else np.zeros(0, bool)
    column = (np.cumsum(several) - 1)[member[keep]] if len(flat) else member
    owner, width, out = owner[keep], int(several.sum()), np.zeros((len(at[0]), len(at[1])), np.float32)
    for a in range(0, width, 4096):
        i, j = np.searchsorted(column, [a, a + 4096])
        dense = np.zeros((len(sets), min(4096, width - a)), np.float32)
        dense[owner[i:j], column[i:j] - a] = 1
        out += dense[at[0]] @ dense[at[1]].T
    return np.rint(out).astype(np.int64)


def _verified(node, named, block, fps, sets, shared: int, min_jaccard: float):
    """Links (member, member) by place that connect what all pairs connect which share the bytes and have the similarity.

    ``named``: what is joined so far (equal: joined); of two blocks only pairs between them are compared.
    """
    n = len(node)
    halves = [np.flatnonzero(block == x) for x in np.unique(block)]
    left, right = halves if len(halves) == 2 else (np.arange(n), np.arange(n))
    b = _bytes(fps)
    retained = np.zeros((len(left), len(right)), bool)
    for i in range(0, len(left), 16):
        tally = (b[left[i : i + 16], None] == b[right][None]).sum(axis=2)
        retained[i : i + 16] = tally >= shared
    retained &= named[left][:, None] != named[right][None]
    if not retained.any():
        return []
    size = np.array([len(x) for x in sets])
    both = overlaps(sets, (left, right))
    similar = retained & (both >= min_jaccard * (size[left][:, None] + size[right][None] - both))
    whole = np.zeros((n, n), bool)
    whole[np.ix_(left, right)] = similar
    whole |= whole.T
    return _span_tree(n, lambda x, y: whole[np.ix_(x, y)])


def _compare_blocks(words64: int, shared: int, min_jaccard: float):
    """(_a, _b) links from runs of equal keys in sorted (_pair, _node, _named, _block, _set, _f0..) rows."""

    def of(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        node, named, block = (t.column(i).to_numpy() for i in (1, 2, 3))
        fps = np.stack([t.column(5 + i).to_numpy().view(np.uint64) for i in range(words64)], axis=1)
        sets = [np.frombuffer(x, "<u8") for x in t.column(4).to_pylist()]
        return [(node[a], node[b]) for a, b in _verified(node, named, block, fps, sets, shared, min_jaccard)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b > a:
                    if held and keys[a] != key:
                        yield from _pairs(of(held))
                        held = []
                    key = keys[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from _pairs(of(held))

    return run


def _as_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle, words).astype("<u8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["_node", "_set"])

    return run


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("_a").alias("u"), F.col("_b").alias("v"))


def _in_pairs(members: DataFrame, buckets: list[str]) -> DataFrame:
    """(_pair, _node, _named, _block): members (_group, _node, _named, *buckets) under each two buckets of their group that are not one joined part."""
    dealt = members.withColumn("_block", F.xxhash64("_group", *buckets))
    held = dealt.select("_group", "_block", "_owner").distinct()
    a, b = (held.select("_group", F.col("_block").alias(f"_{s}"), F.col("_owner").alias(f"_o{s}")) for s in "xy")
    two = a.join(b, "_group").filter("_x <= _y and not coalesce(_ox = _oy, false)")
    two = two.select("_group", F.xxhash64("_x", "_y").alias("_pair"), F.explode(F.array_distinct(F.array("_x", "_y"))).alias("_block"))
    return dealt.join(two, ["_group", "_block"]).select("_pair", "_node", "_named", "_block")


def _groups_joined(entries: DataFrame, sets_of, words64: int, key_bytes: int, span: int, min_jaccard: float, list_cap: int, block: int, beside: int | None = None) -> DataFrame:
    """entries (_node, _f0..) -> links (_a, _b) with the similarity, which connect what all such links connect that the index finds."""
    names = [f"_f{i}" for i in range(words64)]
    places = spans(words64, span, key_bytes)
    below = 64 - LIST_BITS - 8 * key_bytes
    words = beside or beside_words(entries.count(), (key_bytes, words64, span), min_jaccard)
    most = carried_bits(key_bytes, words, min_jaccard)[1]
    lists_of = lambda rows, part, first: saved(
        rows.mapInArrow(_post(part, first, words64, words), "_key long, _node long, " + ", ".join(f"_g{w} long" for w in range(words)))
        .repartition(F.shiftrightunsigned("_key", below))
        .sortWithinPartitions("_key")
        .mapInArrow(_link(below, most, list_cap), "_a long, _b long")
    )
    # The first sixth of the lists, then the rest by labels that their links spread, so that a large group gives few links.
    cut = len(places) // 6
    early = saved(lists_of(entries.select("_node", *names), places[:cut], 0).groupBy("_a", "_b").agg(F.count("*").alias("_n")))
    both = early.select(F.col("_a").alias("_node"), F.col("_b").alias("_r")).union(early.select("_b", "_a"))
    label = saved(both.groupBy("_node").agg(F.least(F.col("_node"), F.min("_r")).alias("_r")))
    spread = both.join(label.select(F.col("_node").alias("_r"), F.col("_r").alias("_s")), "_r").groupBy("_node").agg(F.min("_s").alias("_label"))
    labelled = entries.join(saved(spread), "_node", "left").select(F.least("_node", "_label").alias("_node"), *names)
    late = lists_of(labelled, places[cut:], cut)
    groups = components(_edges(early).union(_edges(late)))
    members = saved(groups.select(F.col("root").alias("_group"), F.col("node").alias("_node")))
    sizes = members.groupBy("_group").agg(F.count("*").alias("_n"))
    members = saved(members.join(sizes, "_group"))
    sets = saved(sets_of(members.select("_node")))
    shared = shared_minimum(words64, min_jaccard)

    def compared(rows: DataFrame) -> DataFrame:
        whole = rows.join(sets, "_node").join(entries, "_node").select("_pair", "_node", "_named", "_block", "_set", *names)
        return saved(whole.repartition(F.col("_pair")).sortWithinPartitions("_pair", "_node").mapInArrow(_compare_blocks(words64, shared, min_jaccard), "_a long, _b long"))

    small = members.filter(F.col("_n") <= block).select(F.col("_group").alias("_pair"), "_node", F.col("_node").alias("_named"), F.lit(0).cast("long").alias("_block"))
    links = compared(small)
    large = members.filter(F.col("_n") > block).select("_group", "_node")
    if not large.limit(1).count():
        return links
    # Large groups: each text's most frequent early link is a group of two; then what is still apart, block by block.
    sides = [early.select(F.col(c).alias("_node"), F.struct("_n", "_a", "_b").alias("_l")) for c in ("_a", "_b")]
    best = sides[0].union(sides[1]).join(large.select("_node"), "_node", "left_semi").groupBy("_node").agg(F.max("_l").alias("_l")).select("_l._a", "_l._b").distinct()
    two = best.select(F.xxhash64("_a", "_b").alias("_pair"), F.explode(F.array("_a", "_b")).alias("_node"))
    verified = compared(two.select("_pair", "_node", F.col("_node").alias("_named"), F.lit(0).cast("long").alias("_block")))
    roots = components(_edges(verified))
    named = saved(large.join(roots, large["_node"] == roots["node"], "left").select("_group", "_node", F.coalesce("root", "_node").alias("_named")))
    parts = named.groupBy("_group", "_named").agg(F.count("*").alias("_part"))
    rest = parts.withColumn("_few", F.when(F.col("_part") < block, F.col("_part"))).groupBy("_group").agg(F.sum("_few").alias("_few"), F.count("*").alias("_parts")).filter("_parts > 1")
    dealt = named.join(parts, ["_group", "_named"]).join(rest, "_group")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(n / block))
    own = F.col("_part") >= block
    dealt = dealt.select("_group", "_node", "_named", F.when(own, F.col("_named")).alias("_owner"), F.when(own, deal("_node", F.col("_part"))).otherwise(deal("_named", F.col("_few"))).alias("_slot"))
    return links.union(verified).union(compared(_in_pairs(saved(dealt), ["_owner", "_slot"])))


def near_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, min_jaccard: float = 0.8, list_cap: int = LIST_CAP, block: int = BLOCK, design: tuple | None = None, beside: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, repeated): the keys (_null, _id, _t0, _t1) of one row of each near-duplicate group; keys that several rows have."""
    spark = tune(docs.sparkSession)
    key = [F.col(id_col).isNull().alias("_null"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_id"), *text_key(text_col)]
    key_bytes, words64, span = design or index_design(0)
    names = [f"_f{i}" for i in range(words64)]
    kinds = "_null boolean, _id long, _t0 long, _t1 long"
    slim = docs.select(F.col(text_col).cast("string").alias("_text"), *key)
    marked = saved(slim.mapInArrow(_describe(shingle, words64), f"{kinds}, {', '.join(f'{n} long' for n in names)}, _s0 long, _s1 long"))
    keys = ["_null", "_id", "_t0", "_t1"]
    nodes = marked.groupBy("_s0", "_s1", *names).agg(F.min(F.struct(*keys)).alias("_keep"))
    nodes = saved(nodes.withColumn("_node", F.monotonically_increasing_id()))
    if not design and (wanted := index_design(nodes.count())) != (key_bytes, words64, span):
        return near_representatives(docs, id_col, text_col, shingle, min_jaccard, list_cap, block, wanted, beside)

    def sets_of(wanted: DataFrame) -> DataFrame:
        used = nodes.join(wanted, "_node", "left_semi").select("_node", F.col("_keep._t0").alias("_t0"), F.col("_keep._t1").alias("_t1"))
        texts = slim.select("_text", "_t0", "_t1").join(used, ["_t0", "_t1"]).groupBy("_node").agg(F.min("_text").alias("_text"))
        return texts.mapInArrow(_as_sets(shingle), "_node long, _set binary")

    entries = nodes.select("_node", *names)
    links = _groups_joined(entries, sets_of, words64, key_bytes, span, min_jaccard, list_cap, block, beside)
    roots = components(_edges(links))
    kept = nodes.join(roots, nodes["_node"] == roots["node"], "left").groupBy(F.coalesce("root", "_node").alias("_group")).agg(F.min("_keep").alias("_keep"))
    repeated = marked.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys)
    return saved(kept.select("_keep.*")), saved(repeated)


def text_key(text_col: str) -> list:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("_t0"), F.xxhash64(F.lit("near"), text).alias("_t1")]


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows and columns with one row of each near-duplicate group: the one with the smallest id.

    Two texts are near copies if the Jaccard similarity of their sets of ``shingle``-word shingles (5; words between
    ASCII white space, A-Z in lower case) is ``min_jaccard`` (0.8) or more, and in one group if such links connect them.
    Null and empty texts have the empty set and are copies of each other. Null ids sort last, equal ids by a hash of the
    text; rows with one id and different texts are judged each by its own text; of rows that agree in id and text the
    one that is first as JSON stays. The input's columns may have any names. An empty table gives an empty table.
    """
    kept, repeated = near_representatives(docs, id_col, text_col, **options)
    keys = ["_null", "_id", "_t0", "_t1"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).isNull().alias("_null"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_id"), *text_key(text_col))
    ours = rows.join(kept, keys, "left_semi")
    if not repeated.limit(1).count():
        return ours.select("_row.*")
    several = ours.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return ours.join(repeated, keys, "left_anti").select("_row.*").union(several.select("_row.*"))
