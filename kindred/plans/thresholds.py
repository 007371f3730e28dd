"""Similarity thresholds (percent) and the Hamming distance they allow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted thresholds, the default, and the hash width.
ALLOWED_THRESHOLDS = (80, 90, 95, 100)
DEFAULT_THRESHOLD = 90
HASH_BITS = 64


def check_threshold(threshold: int) -> int:
    """Return ``threshold`` or raise before any plan is built."""
    if threshold not in ALLOWED_THRESHOLDS:
        raise ValueError(f"threshold must be one of {ALLOWED_THRESHOLDS}, not {threshold!r}")
    return threshold


def max_distance(threshold: int) -> int:
    """Largest number of differing bits that still counts as similar."""
    return HASH_BITS * (100 - check_threshold(threshold)) // 100


def max_distance_column(threshold: Column) -> Column:
    """``max_distance`` for a column of percentages."""
    return F.floor((F.lit(HASH_BITS) * (F.lit(100) - threshold)) / F.lit(100)).cast("bigint")


def similarity_column(distance: Column) -> Column:
    """Percentage of equal bits for a column of distances."""
    return F.lit(100.0) * (F.lit(1.0) - distance / F.lit(float(HASH_BITS)))
