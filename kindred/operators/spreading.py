"""Partitions of about equal weight, whatever the weights of single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kindred.operators.numbering import POSITION_BITS
from kindred.sources.scratch import Scratch


def even_partitions(df: DataFrame, weight: Column, order: list[str], tasks: int, scratch: Scratch) -> DataFrame:
    """``df`` in ``tasks`` partitions, cut where the running sum of ``weight`` passes the next share.

    Rows are range-sorted by ``order`` (unique) and written with their place.
    Running sums are taken within each range partition and start from one sum
    per partition, so no task sees all rows.  A partition exceeds its share by
    one row at most; a row heavier than a share has a partition of its own or
    shares it with what starts before it ends.
    """
    columns = df.columns
    placed = scratch.keep(
        df.withColumn("_weight", weight.cast("bigint"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    )
    part = F.shiftrightunsigned("_place", POSITION_BITS)
    ordered = W.Window.orderBy("_part")
    sums = (
        placed.groupBy(part.alias("_part"))
        .agg(F.sum("_weight").alias("_sum"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(ordered.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_sum").over(W.Window.partitionBy()))  # one row per range partition
    )
    before = W.Window.partitionBy("_part").orderBy("_place").rowsBetween(W.Window.unboundedPreceding, -1)
    running = placed.withColumn("_part", part).withColumn("_before", F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    # floor(running sum * tasks / total), without leaving the range of a long
    at = F.expr(
        f"cast(least({tasks - 1}, cast(_start + _before as decimal(28, 0)) * {tasks} div greatest(1, _total)) as int)"
    )
    spread = running.join(F.broadcast(sums.drop("_sum")), "_part").withColumn("_task", at)
    return spread.repartitionById(tasks, "_task").select(*columns)
