"""Bit-level column functions on 64-bit fingerprints (signed ``bigint``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.plans.key_schemes import contiguous_blocks, signed


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def block_values(value: Column, count: int) -> list[Column]:
    """The ``count`` contiguous blocks of a fingerprint as numbers, most significant first."""
    lowest = [(mask, (mask & -mask).bit_length() - 1) for mask in contiguous_blocks(count)]
    return [F.shiftrightunsigned(value, low).bitwiseAND(F.lit(signed(mask >> low))) for mask, low in lowest]


def hash_parts(df: DataFrame, value: str = "phash") -> DataFrame:
    """Add the 4x16-bit and 21/21/22-bit parts of ``value``."""
    named = {f"p16_{i}": part for i, part in enumerate(block_values(F.col(value), 4))}
    named |= {f"p21_{i}": part for i, part in enumerate(block_values(F.col(value), 3))}
    return df.withColumns(named)


def probe_values(df: DataFrame, part: str, width: int, radius: int) -> DataFrame:
    """One row per value within ``radius`` bits of ``part`` (column ``probe``).

    For looking up one part in an index of parts.  The self-join in
    ``operators.similarity`` uses shorter key lists instead.
    """
    masks = [m for m in range(1 << width) if m.bit_count() <= radius]
    literal = F.expr("array(" + ",".join(f"{m}L" for m in masks) + ")")
    return df.withColumn("mask", F.explode(literal)).withColumn(
        "probe", F.col(part).bitwiseXOR(F.col("mask"))
    )
