"""Secret scan: base patterns, and two character Markov models compared by their log-likelihood ratio.

One model is trained on random strings and one on ordinary identifiers, both first order over the characters of a token,
with one added to every count. A token whose ratio exceeds the odds against a secret is reported. Everything is column
expressions, joins and windows; only the model, a table of fixed size, passes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, saved, table, tune

#: What the model knows: the characters of a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
_KEYS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
#: kind: (pattern, group of the value, least characters of the value). Maximal runs may carry their least length in the pattern.
BASE = {
    "assign": (rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: The method's own kind, its least characters; ordinary tokens are shorter. Documents that the samples are drawn from, on average at most.
RANDOM, LEAST, SAMPLED = "random", 16, 10_000
#: Odds against a secret.
ODDS = 1_000_000


def labelled_tokens(docs: DataFrame, text_col: str = "text", sampled: int = SAMPLED) -> DataFrame:
    """(token, random, n): labelled samples from about ``sampled`` documents, chosen by the hash of their text; all, if fewer.

    Random strings: the values that the base patterns find, and of each sampled text the SHA-256 in base 64. Ordinary:
    the tokens of 4 to LEAST - 1 characters outside the base patterns' matches.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    share = min(1.0, sampled / max(1, docs.count()))
    drawn = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") < int(share * 2**32)
    rows = docs.select(text.alias("text")).filter(drawn)
    values = F.flatten(F.array(*[F.filter(F.regexp_extract_all("text", F.lit(p), F.lit(g)), lambda v, n=n: F.length(v) >= n) for p, g, n in BASE.values()]))
    values = F.concat(values, F.array(F.rtrim(F.base64(F.unhex(F.sha2(F.col("text").cast("binary"), 256))), F.lit("="))))
    plain = F.regexp_replace("text", "|".join(f"(?:{p})" for p, _, _ in BASE.values()), " ")
    plain = F.filter(F.regexp_extract_all(plain, F.lit(f"{TOKEN}+"), F.lit(0)), lambda v: F.length(v).between(4, LEAST - 1))
    kinds = F.array(F.struct(F.lit(True).alias("random"), values.alias("tokens")), F.struct(F.lit(False).alias("random"), plain.alias("tokens")))
    return rows.select(F.explode(kinds).alias("k")).select("k.random", F.explode("k.tokens").alias("token")).groupBy("token", "random").agg(F.count("*").alias("n"))


def train(samples: DataFrame) -> DataFrame:
    """(a, b, score): for each two characters of ALPHABET, by their places, floor(1000 * ln(P(b after a | random) / P(b after a | ordinary))).

    ``samples`` has token, random and n (how often). P is (count + 1) / (count of a before anything + size of ALPHABET); pairs with other characters are left out.
    """
    size = len(ALPHABET)
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    follow = let(F.split("token", ""), lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: F.struct(place(x).alias("a"), place(y).alias("b"))))
    pairs = samples.filter(F.length("token") > 1).select("random", "n", F.explode(follow).alias("p")).filter("p.a > 0 and p.b > 0")
    seen = pairs.groupBy("p.a", "p.b").agg(F.sum(F.when(F.col("random"), F.col("n"))).alias("r"), F.sum(F.when(~F.col("random"), F.col("n"))).alias("o"))
    grid = samples.sparkSession.range(size * size).select((F.floor(F.col("id") / size) + 1).cast("int").alias("a"), (F.col("id") % size + 1).cast("int").alias("b"))
    whole = grid.join(seen, ["a", "b"], "left").select("a", "b", *[F.coalesce(c, F.lit(0)).alias(c) for c in "ro"])
    before = Window.partitionBy("a")
    odds = (F.col("r") + 1).cast("double") * (F.sum("o").over(before) + size) / ((F.col("o") + 1).cast("double") * (F.sum("r").over(before) + size))
    return whole.select("a", "b", F.floor(1000 * F.log(odds)).cast("int").alias("score"))


def ratio(token: Column, model: DataFrame) -> Column:
    """The token's log-likelihood ratio in thousandths: the model's scores of its character pairs added up."""
    size = len(ALPHABET)
    scores = {(r.a, r.b): r.score for r in model.collect()}  # always size * size rows
    table_ = F.expr("array(" + ",".join(str(scores[a, b]) for a in range(1, size + 1) for b in range(1, size + 1)) + ")")
    places = F.expr("array(" + ",".join(str(ALPHABET.find(chr(i))) for i in range(128)) + ")")
    codes = F.transform(F.split(token, ""), lambda c: F.get(places, F.ascii(c)))
    pairs = let(codes, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.get(table_, a * size + b)))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda total, x: total + x)


def _found(kind: str, ordinal: int, pattern: str, group: int, least: int) -> Column:
    """For each match of a kind: the code points between it and the match before, its length, its value's, and for random tokens the value."""
    text = F.col("_text")
    before, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    value = (lambda v: v) if kind == RANDOM else (lambda v: F.lit(None).cast("string"))
    match = lambda b, p: F.struct(F.lit(ordinal).alias("kind"), F.length(b).alias("before"), F.length(p["w"]).alias("length"), (F.length(p["v"]) >= least).alias("kept"), value(p["v"]).alias("value"))
    found = F.zip_with(F.slice(before, 1, F.size(whole)), F.zip_with(whole, values, lambda w, v: F.struct(w.alias("w"), v.alias("v"))), match)
    return F.transform(found, lambda x, i: x.withField("at", i))


def scan_secrets(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", odds: int = ODDS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of each row.

    ``spans`` are kind:start:end in code points (end exclusive), by start and then by kind, joined by commas; base_sha256 is
    the digest of those of the base kinds alone. A random token is a maximal run of TOKEN of LEAST characters or more that
    overlaps no base span and whose log-likelihood ratio under the two models exceeds ln(``odds``). ``samples`` trains the
    models (token, random, n), by default labelled_tokens(docs).

    A null or empty text has no spans. Every row has its own result, repeated and null ids too; other columns are not
    read. An empty table gives an empty table. The matches of one text are put in order by one task.
    """
    spark = tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    model = train(saved(labelled_tokens(docs, "_text") if samples is None else samples))
    none = F.array().cast("array<struct<kind:int,before:int,length:int,kept:boolean,value:string,at:int>>")
    kinds = [*BASE.items(), (RANDOM, (f"{TOKEN}{{{LEAST},}}", 0, LEAST))]
    listed = F.concat(*[F.when(F.col("_text").rlike(p), _found(kind, i, p, g, n)).otherwise(none) for i, (kind, (p, g, n)) in enumerate(kinds)])
    rows = saved(docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), listed.alias("_found")))
    # Rows without a match need no window; those with one come together by row.
    each = rows.filter(F.size("_found") > 0).repartition("_row").select("_row", F.inline("_found"))
    upto = Window.partitionBy("_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("before") + F.col("length")).over(upto)).filter("kept").withColumn("start", F.col("end") - F.col("length"))
    base, order = F.col("kind") < len(BASE), Window.partitionBy("_row").orderBy("start", "kind")
    reached = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(coming, F.col("end")) >= F.col("end"))
    secret = F.when(base, True).when(F.col("free"), ratio(F.col("value"), model) > math.floor(1000 * math.log(odds)))
    kept = placed.withColumn("free", free).filter(secret)
    name = F.element_at(F.array(*[F.lit(k) for k, _ in kinds]), F.col("kind") + 1)
    spans = kept.select("_row", "kind", F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("text")).alias("span"))
    grouped = spans.groupBy("_row").agg(*[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, (k, _) in enumerate(kinds)], F.array_sort(F.collect_list("span")).alias("spans"))
    joined = rows.select("_row", "doc_id").join(grouped, "_row", "left")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: s["text"]), ",")
    found = F.coalesce("spans", F.array().cast(grouped.schema["spans"].dataType))
    return joined.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k, _ in kinds], F.sha2(text(F.filter(found, lambda s: s["kind"] < len(BASE))).cast("binary"), 256).alias("base_sha256"), text(found).alias("spans"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_secrets() of all documents. The models and the matches are made when it is called; the returned frame reads their saved rows."""
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    size, text = len(ALPHABET), "coalesce(text, '')"
    kinds = [*BASE.items(), (RANDOM, (f"{TOKEN}{{{LEAST},}}", 0, LEAST))]
    values = " UNION ALL ".join(f"SELECT true AS random, unnest(regexp_extract_all(t, {quoted(p)}, {g})) AS token, {n} AS least FROM drawn" for p, g, n in BASE.values())
    plain = quoted("|".join(f"(?:{p})" for p, _, _ in BASE.values()))
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, unnest(generate_series(1, len(w))) AS nth, unnest(w) AS whole, unnest(v) AS value, unnest(b[1:len(w)]) AS before, {n} AS least FROM (SELECT doc_id, regexp_extract_all({text}, {quoted(p)}) AS w, regexp_extract_all({text}, {quoted(p)}, {g}) AS v, string_split_regex({text}, {quoted(p)}) AS b FROM documents) WHERE len(w) > 0"
        for i, (_, (p, g, n)) in enumerate(kinds)
    )
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(kinds)) + " END"
    return rf"""
WITH drawn AS (SELECT {text} AS t FROM documents WHERE CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) < floor(least(1.0, {SAMPLED}.0::DOUBLE / (SELECT count(*) FROM documents)) * 4294967296)),
samples AS (SELECT random, token FROM ({values}) WHERE length(token) >= least UNION ALL SELECT true, rtrim(to_base64(unhex(sha256(t))), '=') FROM drawn
  UNION ALL SELECT false, token FROM (SELECT unnest(regexp_extract_all(regexp_replace(t, {plain}, ' ', 'g'), '{TOKEN}+')) AS token FROM drawn) WHERE length(token) BETWEEN 4 AND {LEAST - 1}),
follow AS (SELECT random, instr('{ALPHABET}', token[i]) AS a, instr('{ALPHABET}', token[i + 1]) AS b FROM (SELECT random, token, unnest(generate_series(1, length(token) - 1)) AS i FROM samples)),
seen AS (SELECT a, b, count(*) FILTER (WHERE random) AS r, count(*) FILTER (WHERE NOT random) AS o FROM follow WHERE a > 0 AND b > 0 GROUP BY ALL),
whole AS (SELECT x.i AS a, y.i AS b, coalesce(r, 0) AS r, coalesce(o, 0) AS o FROM (SELECT unnest(generate_series(1, {size})) AS i) x, (SELECT unnest(generate_series(1, {size})) AS i) y LEFT JOIN seen ON seen.a = x.i AND seen.b = y.i),
model AS (SELECT a, b, CAST(floor(1000 * ln((r + 1)::DOUBLE * (sum(o) OVER (PARTITION BY a) + {size}) / ((o + 1)::DOUBLE * (sum(r) OVER (PARTITION BY a) + {size})))) AS INTEGER) AS score FROM whole),
found AS ({found}),
placed AS (SELECT *, ends - length(whole) AS start FROM (SELECT *, CAST(sum(length(before) + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS BIGINT) AS ends FROM found) WHERE length(value) >= least),
scored AS (SELECT value, sum(score) AS ratio FROM (SELECT value, instr('{ALPHABET}', value[i]) AS a, instr('{ALPHABET}', value[i + 1]) AS b FROM (SELECT value, unnest(generate_series(1, length(value) - 1)) AS i FROM (SELECT DISTINCT value FROM placed WHERE kind = {len(BASE)}))) JOIN model USING (a, b) GROUP BY value),
spans AS (SELECT * FROM placed WHERE kind < {len(BASE)} UNION ALL SELECT p.* FROM placed p JOIN scored USING (value) WHERE kind = {len(BASE)} AND ratio > {math.floor(1000 * math.log(ODDS))}
  AND NOT EXISTS (SELECT 1 FROM placed q WHERE q.doc_id = p.doc_id AND q.kind < {len(BASE)} AND q.start < p.ends AND p.start < q.ends)),
listed AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, (k, _) in enumerate(kinds))}, string_agg({name} || ':' || start || ':' || ends, ',' ORDER BY start, kind) FILTER (WHERE kind < {len(BASE)}) AS base, string_agg({name} || ':' || start || ':' || ends, ',' ORDER BY start, kind) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _ in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN listed USING (doc_id)
"""


OP12_SQL = _sql()
