"""Ranked lexical search with pair-bound MaxScore.

The documents lie in shards. A shard holds, for each term, its documents and their impacts (what the term adds to a
document's score) and, for pairs of terms that are asked together, the intersection list's joint maximum: the largest
sum of both impacts in one document. A query's terms are ordered by weight. The bound of its first i terms is the
smallest sum over ways to cover them by single terms (their maxima) and by disjoint pairs of near neighbours (the larger
of the joint maximum and the two single ones), found by a short recurrence; it is never above the sum of single maxima.
Documents that hold only terms whose bound stays below the threshold are never looked at, and others are dropped
as soon as their score so far plus the bound of the terms left stays below it.

A part of the shards is searched first, and the scores of its k-th documents are where the others start. All counts and
scores are integers, so that results do not depend on the shards.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table, tune

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Postings of a shard, documents of a shard that are scored together, bytes of queries that are asked in one pass.
SHARD, RANGE, ASKED = 1 << 20, 1 << 13, 8 << 20
#: One partition in so many is searched first.
FIRST = 8

COUNTED = "doc_id long, n long, terms binary, tfs binary"
INDEX = "first boolean, ids binary, nulls binary, terms binary, starts binary, docs binary, impacts binary, joint binary"


def terms_of(text: str) -> Counter:
    """Occurrences of the terms of a text whose A-Z are in lower case already."""
    return Counter(TERM.findall(text) if len(text) < 1 << 20 else (m.group() for m in TERM.finditer(text)))


def _count(numbers: dict[str, int]):
    """Each document's length in terms, and the numbers and occurrences of the terms asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in pc.ascii_lower(pc.fill_null(batch.column(1), "")).to_pylist():
                counts = terms_of(text)
                n.append(sum(counts.values()))
                own = sorted((numbers[t], c) for t, c in counts.items() if t in numbers)
                terms.append(np.array([t for t, _ in own], "<i4").tobytes())
                tfs.append(np.array([c for _, c in own], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        counts = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=len(total))
        counts[: len(total)] += total
        total = counts
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "df"])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting adds: weight * (10**9 * tf div (1000 * tf + 20 * m)), m = 50 + 50 * n * n_docs div n_terms."""
    exact = object if int(n.max(initial=0)) * n_docs * 50 >= 2**63 else np.int64
    m = (50 + n.astype(exact) * 50 * n_docs // n_terms).astype(np.int64)
    return weights * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def pairs_of(ordered: list[int]) -> list[tuple[int, int]]:
    """A query's pairs with a joint maximum: each term, in the order of weights, and the two after it."""
    return [(ordered[i], ordered[i + d]) for d in (1, 2) for i in range(len(ordered) - d)]


def prefix_bounds(single: list[int], next_: list[int], second: list[int]) -> list[int]:
    """bounds[i]: the most that the first i terms can add to one document.

    ``single`` are the terms' maxima, ``next_[i]`` bounds terms i and i + 1 together, ``second[i]`` terms i and i + 2. The
    smallest over all covers by single terms and disjoint pairs.
    """
    bounds = [0]
    for i in range(len(single)):
        ways = [bounds[i] + single[i]]
        if i >= 1:
            ways.append(bounds[i - 1] + next_[i - 1])
        if i >= 2:
            ways.append(bounds[i - 2] + single[i - 1] + second[i - 2])
        if i >= 3:
            ways.append(bounds[i - 3] + second[i - 3] + second[i - 2])
        bounds.append(min(ways))
    return bounds


def _index(weights: np.ndarray, n_docs: int, n_terms: int, pairs: np.ndarray, size: int):
    """One row a shard. ``pairs`` is sorted."""

    def shard(first, ids, n, terms, tfs):
        lengths = [len(t) // 4 for t in terms]
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        term, tf = np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(tfs), "<i4").astype(np.int64)
        order = np.argsort(term, kind="stable")
        doc, term = doc[order], term[order]
        impact = impacts(weights[term], tf[order], np.array(n, np.int64)[doc], n_docs, n_terms)
        held, starts = np.unique(term, return_index=True)
        starts = np.append(starts, len(term))
        place = {t: i for i, t in enumerate(held.tolist())}
        joint, dense, last = np.zeros(len(pairs), np.int64), np.zeros(len(ids), np.int64), None
        for k, (a, b) in enumerate(pairs.tolist()):
            i, j = place.get(a), place.get(b)
            if i is None or j is None:
                continue
            if a != last:
                dense[:] = 0
                dense[doc[starts[i] : starts[i + 1]]] = impact[starts[i] : starts[i + 1]]
                last = a
            other = dense[doc[starts[j] : starts[j + 1]]]
            joint[k] = ((other + impact[starts[j] : starts[j + 1]]) * (other > 0)).max()
        columns = [np.array([0 if x is None else x for x in ids], "<i8"), np.array([x is None for x in ids]), held.astype("<i4"), starts.astype("<i8"), doc.astype("<i4"), impact.astype("<i8"), joint.astype("<i8")]
        return pa.RecordBatch.from_arrays([pa.array([first]), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=[x.split()[0] for x in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, postings = TaskContext.get().partitionId() % FIRST == 0, ([], [], [], []), 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2]:
                    for column, x in zip(held, row, strict=True):
                        column.append(x)
                    postings += len(row[2]) // 4
                if postings >= size:
                    yield shard(first, *held)
                    held, postings = ([], [], [], []), 0
        if postings:
            yield shard(first, *held)

    return run


class Shard:
    """The lists of one shard, and the search in them."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.nulls, self.starts, self.docs, self.impacts, self.joint = read("ids", "<i8"), read("nulls", bool), read("starts", "<i8"), read("docs", "<i4"), read("impacts", "<i8"), read("joint", "<i8")
        self.place = {t: i for i, t in enumerate(read("terms", "<i4").tolist())}
        self.most = np.maximum.reduceat(self.impacts, self.starts[:-1]).tolist()
        self.edges = np.arange(0, len(self.ids) + RANGE, RANGE)
        self.cuts: dict[int, np.ndarray] = {}
        self.touched = 0  # postings read

    def _lists(self, i: int) -> np.ndarray:
        """Where the ranges of documents start in the i-th list."""
        if i not in self.cuts:
            self.cuts[i] = self.starts[i] + np.searchsorted(self.docs[self.starts[i] : self.starts[i + 1]], self.edges)
        return self.cuts[i]

    def bounds(self, terms: list[int], near: list[int], far: list[int]) -> list[int]:
        single = [self.most[self.place[t]] if t in self.place else 0 for t in terms]
        joint = lambda at, d: [max(int(self.joint[k]), single[i], single[i + d]) for i, k in enumerate(at)]
        return prefix_bounds(single, joint(near, 1), joint(far, 2))

    def search(self, terms: list[int], near: list[int], far: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the k best with a score of ``least`` or more; ``near`` and ``far`` are the places of the terms' pairs."""
        bounds = self.bounds(terms, near, far)
        lists = [self._lists(self.place[t]) if t in self.place else None for t in terms]
        best, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), max(least, 1)
        for r, base in enumerate(self.edges[:-1].tolist()):
            skipped = bisect_left(bounds, least) - 1  # documents with only these terms stay below
            if skipped == len(terms):
                break
            score = np.zeros(min(RANGE, len(self.ids) - base), np.int64)
            for cut in lists[skipped:]:
                if cut is not None and cut[r] < cut[r + 1]:
                    score[self.docs[cut[r] : cut[r + 1]] - base] += self.impacts[cut[r] : cut[r + 1]]
                    self.touched += int(cut[r + 1] - cut[r])
            docs = np.flatnonzero(score)
            for i in range(skipped, 0, -1):
                docs = docs[score[docs] + bounds[i] >= least]
                if not len(docs):
                    break
                if (cut := lists[i - 1]) is not None and cut[r] < cut[r + 1]:
                    own = self.docs[cut[r] : cut[r + 1]] - base
                    at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                    score[docs] += np.where(own[at] == docs, self.impacts[cut[r] + at], 0)
                    self.touched += len(docs)
            docs = docs[score[docs] >= least]
            if len(docs):
                best, scores = np.concatenate([best, docs + base]), np.concatenate([scores, score[docs]])
                top = np.lexsort((self.ids[best], self.nulls[best], -scores))[:k]
                best, scores = best[top], scores[top]
                if len(top) == k:
                    least = max(least, int(scores[-1]))
        return best, scores


def _search(queries: list[tuple], k: int, least: dict[int, int]):
    """(query, doc_id, score) of each shard's best documents for each query (number, terms, near, far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, out = Shard(row), ([], [], [], [])
                for number, *asked in queries:
                    docs, scores = shard.search(*asked, k, least.get(number, 1))
                    for column, x in zip(out, (np.full(len(docs), number), shard.ids[docs], shard.nulls[docs], scores), strict=True):
                        column.append(x)
                number, ids, nulls, scores = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids, mask=nulls), pa.array(scores)], names=["query", "doc_id", "score"])

    return run


class Plan:
    """One block of queries: the counted documents, the statistics, the pairs and the index."""

    def __init__(self, slim: DataFrame, asked: list, size: int = SHARD):
        texts = [(r.query, terms_of(r.text)) for r in asked]
        names = sorted({t for _, terms in texts for t in terms})
        numbers = {t: i for i, t in enumerate(names)}
        counted = saved(slim.mapInArrow(_count(numbers), COUNTED))
        self.n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(counted.select("terms").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df")).collect())  # a row a term of the block's queries
        weights = np.array([weight(self.n_docs, df.get(i, 0)) for i in range(len(names))], np.int64)
        ordered = [(q, sorted((numbers[t] for t in terms), key=lambda i: (weights[i], i))) for q, terms in texts]
        pairs = sorted({p for _, terms in ordered for p in pairs_of(terms)})
        place = {p: i for i, p in enumerate(pairs)}
        self.queries = [(q, terms, [place[p] for p in zip(terms, terms[1:])], [place[p] for p in zip(terms, terms[2:])]) for q, terms in ordered if terms]
        self.index = saved(counted.mapInArrow(_index(weights, self.n_docs, n_terms, np.array(pairs, np.int64).reshape(-1, 2), size), INDEX))

    def search(self, k: int) -> DataFrame:
        """(query, doc_id, score): the k best of each shard at least, as far as they can be among the k best of all."""
        shape = "query long, doc_id long, score long"
        first = saved(self.index.filter("first").mapInArrow(_search(self.queries, k, {}), shape))
        least = dict(best(first, k).filter(F.col("rank") == k).select("query", "score").collect())  # a row a query of the block
        return first.union(saved(self.index.filter("not first").mapInArrow(_search(self.queries, k, least), shape)))


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", size: int = SHARD, asked: int = ASKED) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item: positive scores, the highest first, equal ones by ascending id, null ids last.

    Terms are maximal runs of letters, digits and non-ASCII characters, A-Z in lower case. N documents have terms, L terms
    in all; a term in df documents weighs floor(1000 * ln((2N + 2) / (2df + 1))), and a document of n terms that holds it
    tf times gets weight * (10**9 * tf div (1000 * tf + 20 * (50 + 50 * n * N div L))). Null texts have no terms. Every row of
    ``docs`` is a document and every row of ``items`` a query, repeated ids too. Items are asked in blocks of about
    ``asked`` bytes, with one pass over the documents each. Without items or documents the result is empty.
    """
    tune(docs.sparkSession)
    lower = F.translate(F.coalesce(F.col(query_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    queries = saved(items.select(F.col(item_col).alias("item_id"), lower.alias("text"), F.monotonically_increasing_id().alias("query")))
    blocks = -(-(queries.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 1) // asked)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for block in range(blocks):
        part = Plan(slim, queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "text").collect(), size).search(k)
        found = part if found is None else found.union(part)
    return best(found, k).join(queries.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item. Index and searches run when it is called; the returned frame ranks their saved rows."""
    return search_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH tokens AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
lengths AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM tokens WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tokens) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term),
added AS (SELECT term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact FROM tfs JOIN lengths USING (doc_id) JOIN weights USING (term), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN added USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores QUALIFY rank <= 50
"""
