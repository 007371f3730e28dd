"""Difference between the stored snapshot and the current listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.sources.images import UNKNOWN_ERROR


def file_differs(stored: str, current: str) -> Column:
    """Whether size or modification time differ between two aliases."""
    return (F.col(f"{stored}.size") != F.col(f"{current}.size")) | (
        F.col(f"{stored}.modified_ns") != F.col(f"{current}.modified_ns")
    )


def diff_snapshots(state: DataFrame, listing: DataFrame) -> DataFrame:
    """One row per known path with its ``action``.

    ``action`` is new, modified, unchanged or removed.  ``size`` and
    ``modified_ns`` are the current ones (the stored ones of removed paths);
    ``image_id, phash, group_id`` are the stored ones.  One full outer join
    answers all of: what is new, changed, gone, and to be hashed.
    """
    s, f = state.alias("s"), listing.alias("f")
    action = (
        F.when(F.col("s.path").isNull(), "new")
        .when(F.col("f.path").isNull(), "removed")
        .when(file_differs("s", "f"), "modified")
        .otherwise("unchanged")
    )
    return s.join(f, F.col("s.path") == F.col("f.path"), "full_outer").select(
        F.coalesce("f.path", "s.path").alias("path"),
        F.coalesce("f.size", "s.size").alias("size"),
        F.coalesce("f.modified_ns", "s.modified_ns").alias("modified_ns"),
        "s.image_id",
        "s.phash",
        "s.group_id",
        action.alias("action"),
    )


def new_files(state: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files that are not stored."""
    return listing.join(state.select("path"), "path", "left_anti")


def modified_files(state: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files whose size or time differs from the stored one."""
    s, f = state.alias("s"), listing.alias("f")
    return f.join(s, F.col("s.path") == F.col("f.path")).where(file_differs("s", "f")).select("f.*")


def files_to_hash(state: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files that are new or modified."""
    s, f = state.alias("s"), listing.alias("f")
    return (
        f.join(s, F.col("s.path") == F.col("f.path"), "left")
        .where(F.col("s.path").isNull() | file_differs("s", "f"))
        .select("f.*")
    )


def removed_files(state: DataFrame, listing: DataFrame) -> DataFrame:
    """Stored files that are not listed any more."""
    return state.join(listing.select("path"), "path", "left_anti")


def stale_paths(removed: DataFrame, failed: DataFrame) -> DataFrame:
    """Paths to forget: removed or not readable."""
    return removed.select("path").union(failed.select("path")).distinct()


def hashed_new_paths(new: DataFrame, hashed: DataFrame) -> DataFrame:
    """New paths that were hashed successfully."""
    return new.select("path").intersect(hashed.where(F.col("phash").isNotNull()).select("path"))


def unreadable(hashed: DataFrame, unknown: str = UNKNOWN_ERROR) -> DataFrame:
    """Rows without a hash and the reason."""
    return hashed.where(F.col("phash").isNull()).withColumn("error", F.coalesce("error", F.lit(unknown)))


def upsert(state: DataFrame, changed: DataFrame) -> DataFrame:
    """Replace or add rows by path; their groups are to be computed again.

    ``changed`` rows carry the ``image_id`` they keep or were given.
    """
    rest = state.join(changed.select("path"), "path", "left_anti").select(*state.columns)
    reset = changed.withColumn("group_id", F.lit(None).cast("bigint"))
    return rest.unionByName(reset.select(*state.columns))


def delete(state: DataFrame, stale: DataFrame) -> DataFrame:
    """Rows of ``state`` whose path is not stale."""
    return state.join(stale.select("path"), "path", "left_anti").select(*state.columns)


def rebuild_decision(actions: DataFrame, saved_threshold: int | None, threshold: int) -> DataFrame:
    """One row of flags that say whether all groups must be computed again."""
    def any_row(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    kept = F.col("action") == "unchanged"
    return actions.agg(
        any_row(F.col("action") == "modified").alias("has_modified"),
        any_row(F.col("action") == "removed").alias("has_removed"),
        F.lit(saved_threshold != threshold).alias("threshold_changed"),
        any_row(kept & F.col("group_id").isNull()).alias("has_null_group"),
    ).withColumn(
        "full_rebuild",
        F.col("has_modified") | F.col("has_removed") | F.col("threshold_changed") | F.col("has_null_group"),
    )


def run_counters(actions: DataFrame, hashed: DataFrame) -> DataFrame:
    """One row: images after the run, reused, calculated, new, unreadable."""
    outcome = hashed.select("path", F.col("phash").isNotNull().alias("ok"))
    both = actions.select("path", "action").join(outcome, "path", "left")
    good, action = F.coalesce("ok", F.lit(False)), F.col("action")
    return both.agg(
        F.count_if(good | (action == "unchanged")).alias("images"),
        F.count_if(action == "unchanged").alias("reused"),
        F.count_if(good).alias("calculated"),
        F.count_if(good & (action == "new")).alias("new_images"),
        F.count_if(~F.coalesce("ok", F.lit(True))).alias("unreadable"),
    )
