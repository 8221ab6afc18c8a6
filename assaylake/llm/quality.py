"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base rules are fixed. Further rules have a score each, and a ladder of joint levels, from loose to strict: at a level a
document is rejected if any score is above its rule's cutoff of that level. Each stratum takes its strictest level for
which this and every looser one reject at most a ``risk`` share of the good documents, by the exact binomial test over
the labelled good documents that pass the base rules. Levels are tested in that fixed order up to the first that fails,
so they share one test level; the strata share ``delta`` evenly (Bonferroni). So with confidence 1 - ``delta`` no stratum loses more
than a ``risk`` share of its good documents that pass the base rules. With fewer than log(delta / strata) / log(1 - risk)
good labels in a stratum (217 for four strata, risk 0.02 and delta 0.05) no level can pass there, and the base rules alone reject.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, let, saved, table

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Scores (higher is worse) and their cutoffs, from the loosest level to the strictest.
SHARES = (0.5, 0.3, 0.2, 0.12, 0.08, 0.05, 0.03, 0.02, 0.01, 0.005)
RULES = {
    "symbols": ((lambda: F.try_divide(F.col("n_symbols"), F.col("word_chars"))), SHARES),
    "bangs": ((lambda: F.try_divide(F.col("n_bangs"), F.col("word_chars"))), SHARES),
    "dup_lines": ((lambda: F.try_divide(F.col("n_dup_lines"), F.col("n_word_lines"))), SHARES),
    "repeats": ((lambda: F.try_divide(F.col("n_repeat_words"), F.col("n_words"))), SHARES),
    "long_words": ((lambda: F.try_divide(F.col("word_chars"), F.col("n_words"))), (100.0, 50.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0)),
}
LEVELS = len(SHARES)
RISK, DELTA = 0.02, 0.05


def _repeated(words: Column) -> Column:
    """Words in 5-word windows found twice or more (windows are compared by a 64-bit hash of the words' hashes)."""

    def covered(grams: Column) -> Column:
        def of(ordered: Column) -> Column:
            hit = F.filter(ordered, lambda x, i: (x["g"] == F.get(ordered, i - 1)["g"]) | (x["g"] == F.get(ordered, i + 1)["g"]))
            return let(F.sort_array(F.transform(hit, lambda x: x["i"])), lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")))

        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(ordered, of))

    def of_hashes(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
        return F.when(F.size(h) < 5, F.lit(0).cast("long")).otherwise(let(grams, covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measured(docs: DataFrame, text_col: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and the base columns, n_word_lines and n_bangs of each row. A null text has no words; all counts are then 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    length = F.length(text)
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return docs.select(
        *keep,
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (length - F.length(F.translate(text, "!", ""))).cast("long").alias("n_bangs"),
        of_words.alias("_w"),
        of_lines.alias("_l"),
    ).select(*keep, F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_l.d").alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"), "n_bangs", F.col("_l.n").alias("n_word_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact, summed in logarithms from the terms' ratios; 1 where k >= n * p, as no test needs more."""
    first = n * F.lit(math.log1p(-p))
    odds = F.lit(math.log(p) - math.log1p(-p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log(n - i + 1) - F.log(i) + odds
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(-F.abs(acc["total"] - term)))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("array_remove(array(0L), 0L)"))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda acc: acc["total"])))


def rejects(level: int) -> Column:
    """Any score above its rule's cutoff of the level; a score without a value rejects nothing."""
    beyond = F.lit(False)
    for score, cutoffs in RULES.values():
        beyond |= F.coalesce(score() > cutoffs[level], F.lit(False))
    return beyond


def thresholds(scored: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(_stratum, n, level): good labelled documents and the chosen level, 0 the loosest, null where the first fails its test.

    ``scored``: doc_id, _stratum and the columns of measured(). The holdout is every labelled document with quality 1
    that passes the base rules; a document with several labels is good if any of them says so.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct()
    held = scored.filter(~base_failed()).join(good, "doc_id", "left_semi")
    counts = [F.count("*").alias("n"), *(F.count_if(rejects(i)).alias(f"_r{i}") for i in range(LEVELS))]
    tallied = saved(held.groupBy("_stratum").agg(*counts))  # one pass, summed before the shuffle; a row a stratum
    level = F.lit(delta) / F.lit(max(1, tallied.count()))
    failed = F.coalesce(*[F.when(at_most(F.col(f"_r{i}"), F.col("n"), risk) > level, F.lit(i)) for i in range(LEVELS)], F.lit(LEVELS))
    return tallied.select("_stratum", "n", F.when(failed > 0, failed - 1).alias("level"))


def _judged(scored: DataFrame, levels: DataFrame) -> DataFrame:
    beyond = F.lit(False)
    for i in range(LEVELS):
        beyond |= F.coalesce(F.col("_level") == i, F.lit(False)) & rejects(i)
    return scored.join(levels, "_stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~beyond)


def _levels(scored: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Thresholds as a small local table; a stratum column with more values than this is refused, as it is no stratum."""
    chosen = thresholds(scored, labels, **options).select("_stratum", F.col("level").alias("_level"))
    rows = chosen.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 strata")
    return F.broadcast(scored.sparkSession.createDataFrame(rows, chosen.schema))


def judge_quality(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", **options) -> DataFrame:
    """One row a document: doc_id, the base columns, base_failed and kept.

    A null text has no words and fails the base rules; a null stratum is a stratum of its own; null and repeated ids are
    judged row by row (a null id is never a labelled one). Without labels, or with too few good ones for a guarantee, only the base
    rules reject. An empty table gives an empty table.
    """
    named = docs.select("doc_id", "text", F.coalesce(F.col(stratum_col).cast("string"), F.lit("\x00")).alias("_stratum"))
    scored = saved(measured(named, keep=("doc_id", "_stratum")))
    return _judged(scored, _levels(scored, labels, **options)).select("doc_id", *BASE, "base_failed", "kept")


def filter_quality(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", **options) -> DataFrame:
    """The input's rows and columns without the documents that judge_quality() rejects."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), F.col("text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\x00")).alias("_stratum"))
    scored = saved(measured(row, keep=("_row", "doc_id", "_stratum")))
    kept = _judged(scored, _levels(scored.drop("_row"), labels, **options)).filter("kept")
    return kept.select("_row.*")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """judge_quality() of all documents. Measures and levels are found when it is called; the returned frame reads the saved measures."""
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _ladder_sql() -> str:
    scores = {"symbols": "n_symbols / word_chars::DOUBLE", "bangs": "n_bangs / word_chars::DOUBLE", "dup_lines": "n_dup_lines / n_word_lines::DOUBLE", "repeats": "n_repeat_words / n_words::DOUBLE", "long_words": "word_chars / n_words::DOUBLE"}
    return ", ".join("(" + " OR ".join(f"coalesce({scores[r]} > {cutoffs[i]}, false)" for r, (_, cutoffs) in RULES.items()) + f") AS r{i}" for i in range(LEVELS))


OP10_SQL = rf"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS pos FROM documents
), windows AS (
  SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), twice AS (
  SELECT doc_id, pos FROM windows WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT pos + d) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS d) GROUP BY 1
), words AS (
  SELECT doc_id, count(*) AS n, CAST(sum(length(word)) AS BIGINT) AS chars FROM tokens GROUP BY 1
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), measured AS (
  SELECT d.doc_id, coalesce(d.lang, chr(0)) AS stratum, coalesce(w.n, 0) AS n_words, coalesce(w.chars, 0) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) AS n_bangs, coalesce(l.dup, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_word_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM documents d LEFT JOIN words w USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_ladder_sql()} FROM measured
), held AS (
  SELECT stratum, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE r{i}) AS c{i}" for i in range(LEVELS))} FROM judged
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1
), tests AS (
  SELECT stratum, i, (SELECT sum(exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * ln({RISK}::DOUBLE) + (n - k) * ln(1 - {RISK}::DOUBLE))) FROM range(0, c + 1) t(k)) <= {DELTA}::DOUBLE / (SELECT count(*) FROM held) AS passed
  FROM (SELECT stratum, n, unnest([{", ".join(f"c{i}" for i in range(LEVELS))}]) AS c, unnest(range(0, {LEVELS})) AS i FROM held)
), levels AS (
  SELECT stratum, coalesce(min(i) FILTER (WHERE NOT passed), {LEVELS}) - 1 AS level FROM tests GROUP BY 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(CASE level {" ".join(f"WHEN {i} THEN r{i}" for i in range(LEVELS))} ELSE false END, false) AS kept
FROM judged LEFT JOIN levels USING (stratum)
"""
