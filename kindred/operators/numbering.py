"""Consecutive numbers in a global order, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kindred.sources.scratch import Scratch

# monotonically_increasing_id keeps the row position in its low 33 bits.
POSITION_BITS = 33


def number_rows(df: DataFrame, order: list[str], name: str, scratch: Scratch, after: int = 0) -> DataFrame:
    """Add ``name`` = ``after`` + 1, 2, ... in the order of unique ``order``.

    The rows are range-partitioned, sorted and written once with their place
    inside the partition.  The first number of each partition then follows
    from one count per partition, which is all that is ordered globally.
    """
    placed = scratch.keep(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftrightunsigned("_place", POSITION_BITS)
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    position = F.col("_place").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        # one row per range partition
        .join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + position + F.lit(1 + after)).cast("bigint"))
        .drop("_place", "_part", "_start")
    )


def max_id(state: DataFrame) -> int:
    """Largest image id in use, 0 for an empty state."""
    return state.agg(F.coalesce(F.max("image_id"), F.lit(0))).first()[0]


def assign_ids(new: DataFrame, state: DataFrame, scratch: Scratch) -> DataFrame:
    """Give new rows the ids after the largest stored one, in path order."""
    return number_rows(new, ["path"], "image_id", scratch, after=max_id(state))
