"""Sets of entities as 64-bit words, and weighted counts of their unions by bit-sliced indexes.

An entity's id gives its word (id div 64) and its bit. A place holds one mask for each word in which anything covers it;
unions are bitwise ors. An index of the entities holds, for each word, the masks of those that a flag names, and for each
weight the masks of its binary digits; a union's weighted count is the sum over digits of 2**digit times the bits in common.
So neither needs the pairs of places and entities: work grows with the words that are in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bit(entity: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod(`{entity}`, 64) as int))")


def masks(rows: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """(*keys, word, mask): the entities of each key; rows without an entity are left out, repeated ones count once."""
    held = rows.filter(F.col(entity).isNotNull())
    return held.groupBy(*keys, F.shiftright(F.col(entity).cast("long"), 6).alias("word")).agg(F.bit_or(_bit(entity)).alias("mask"))


def bit_index(entities: DataFrame, entity: str, flags: dict[str, Column], weights: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """(word, one mask for each flag, one for each binary digit of each weight as <weight>_<digit>) of entities with different ids, and the digits of each weight (flags: 0).

    A null flag is false, a null weight 0; a negative weight is an error. One aggregation finds the number of digits.
    """
    valued = entities.select(entity, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()], *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in weights.items()])
    digits = dict.fromkeys(flags, 0)
    if weights:
        low, high = valued.agg(F.min(F.least(*weights, F.lit(0))), F.array(*[F.max(n) for n in weights])).first()
        if low is not None and low < 0:
            raise ValueError("weights are counts or sums, not negative")
        digits |= {n: max(1, (h or 0).bit_length()) for n, h in zip(weights, high, strict=True)}
    bit, none = _bit(entity), F.lit(0).cast("long")
    of = lambda holds, name: F.bit_or(F.when(holds, bit).otherwise(none)).alias(name)
    slices = [of(F.shiftright(F.col(n), k).bitwiseAND(1) == 1, f"{n}_{k}") for n in weights for k in range(digits[n])]
    return valued.groupBy(F.shiftright(F.col(entity).cast("long"), 6).alias("word")).agg(*[of(F.col(n), n) for n in flags], *slices), digits


def union_sums(words: DataFrame, keys: list[str], index: tuple[DataFrame, dict[str, int]]) -> DataFrame:
    """(*keys, each flag's number of entities, each weight's sum) over the union of a key's masks; words have (*keys, word, mask), a word more than once at will.

    The index has one row a word, 64 times fewer than entities, and meets the united masks in a plain equi-join.
    """
    rows, digits = index
    united = words.groupBy(*keys, "word").agg(F.bit_or("mask").alias("mask"))
    common = lambda c: F.bit_count(F.col("mask").bitwiseAND(F.col(c))).cast("long")

    def value(name: str) -> Column:
        out = common(f"{name}_0") if digits[name] else common(name)
        for k in range(1, digits[name]):
            out += F.shiftleft(common(f"{name}_{k}"), k)
        return out

    return united.join(rows, "word").groupBy(*keys).agg(*[F.sum(value(n)).alias(n) for n in digits])
