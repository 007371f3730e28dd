"""Median hash of a 64-value vector (the 8x8 low-frequency block, row-major)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.plans.key_schemes import any_bit, signed
from kindred.plans.thresholds import HASH_BITS


def _bits(vector: str, cut: str, positions: range) -> Column:
    """Bit ``63 - i`` is set where ``vector[i] >= cut``, for some ``i``."""
    weight = {i: signed(1 << (HASH_BITS - 1 - i)) for i in positions}
    return F.expr(any_bit([f"if(`{vector}`[{i}] >= `{cut}`, {w}L, 0L)" for i, w in weight.items()]))


def hash_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Add ``phash`` and ``error`` for the vectors in column ``vector``.

    The cut is the middle of the 63 values after the first.  A vector that is
    missing or does not hold 64 numbers gets an error and no hash.

    The comparisons are written out, because ``transform`` and ``aggregate``
    lambdas are interpreted element by element; and in two steps of 32,
    because one step would exceed the size of a method that the JVM compiles.
    The test for null keeps the two steps apart, and ``inline`` keeps filters
    on the result from copying the whole text once per use of the cut.
    """
    first, others = f"`{vector}`[0]", f"sort_array(slice(`{vector}`, 2, {HASH_BITS - 1}))"
    usable = f"""size(`{vector}`) = {HASH_BITS} and {first} is not null and not isnan({first})
        and s[0] is not null and not isnan(s[{HASH_BITS - 2}])"""
    cut = f"transform(array({others}), s -> struct(if({usable}, s[{(HASH_BITS - 2) // 2}], null) as _cut))"
    error = f"""case when _cut is not null then null
        when `{vector}` is null then 'no vector'
        when size(`{vector}`) <> {HASH_BITS} then concat('expected {HASH_BITS} values, found ', size(`{vector}`))
        else 'value missing or not a number' end"""
    return (
        df.select("*", F.expr(f"inline({cut})"))
        .withColumn("_low", F.when(F.col("_cut").isNotNull(), _bits(vector, "_cut", range(32, 64))))
        .withColumns({
            "phash": F.when(F.col("_low").isNotNull(), F.col("_low").bitwiseOR(_bits(vector, "_cut", range(32)))),
            "error": F.expr(error),
        })
        .drop("_cut", "_low")
    )


def hex_hash(value: Column) -> Column:
    """16 hex digits, the big-endian form of the fingerprint."""
    return F.lpad(F.hex(value), 16, "0")
