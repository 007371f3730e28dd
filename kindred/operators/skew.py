"""Join that stays balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.scratch import Scratch

# Below this many rows no key is worth treating apart.
HOT_ROWS = 1_000_000
# A key is hot above this share of all rows, so there are at most 1000.
HOT_SHARE = 1000


def join_unique(
    left: DataFrame, right: DataFrame, on: str, how: str, scratch: Scratch, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``left`` joined with ``right``, where ``right`` has one row per key.

    Rows of hot keys stay where they are and meet a broadcast of the matching
    right rows, at most ``HOT_SHARE`` of them.  All others are shuffled by key.
    """
    total = left.count()
    if total <= hot_rows:
        return left.join(right, on, how)
    share = max(hot_rows, total // HOT_SHARE)
    hot = scratch.keep(left.groupBy(on).count().where(F.col("count") > share).select(on), "hot")
    if hot.isEmpty():
        return left.join(right, on, how)
    hot = F.broadcast(hot)
    hot_side = left.join(hot, on, "left_semi").join(
        F.broadcast(right.join(hot, on, "left_semi")), on, how
    )
    return hot_side.unionByName(left.join(hot, on, "left_anti").join(right, on, how))
