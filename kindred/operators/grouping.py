"""Groups of more than one image: sizes, numbers, ordered members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.numbering import number_rows
from kindred.operators.skew import join_unique
from kindred.sources.scratch import Scratch


def group_sizes(images: DataFrame, member: str = "path") -> DataFrame:
    """Groups with more than one member, with their first and last member."""
    return (
        images.groupBy("group_id")
        .agg(
            F.count("*").alias("size"),
            F.min(member).alias("first_member"),
            F.max(member).alias("last_member"),
        )
        .where("size > 1")
    )


def numbered_groups(images: DataFrame, scratch: Scratch, member: str = "path") -> DataFrame:
    """``group_sizes`` plus ``id`` = 1, 2, ... in the order of the label."""
    return number_rows(group_sizes(images, member), ["group_id"], "id", scratch)


def group_members(images: DataFrame, scratch: Scratch, member: str = "path") -> DataFrame:
    """One row per grouped image: ``id, size, group_id, <member>, ...``.

    Members stay rows instead of one list per group, because a group has no
    largest size.  Sort by ``id, <member>`` for the order of the report.
    """
    return join_unique(images, numbered_groups(images, scratch, member), "group_id", "inner", scratch)


def group_summary(images: DataFrame) -> DataFrame:
    """One row: number of groups, grouped images, and the largest group."""
    return (
        images.groupBy("group_id")
        .agg(F.count("*").alias("size"))
        .where("size > 1")
        .agg(
            F.count("*").alias("n_groups"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("n_images"),
            F.coalesce(F.max("size"), F.lit(0)).alias("max_size"),
        )
    )
