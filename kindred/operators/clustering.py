"""Group labels for all images, or only for what a change can have touched.

A group is a connected component of the similarity graph, and its label is
its smallest image id.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.components import connected_components
from kindred.operators.similarity import DEFAULT_LIMITS, JoinLimits, distinct_hashes, similar_links, similar_pairs
from kindred.operators.skew import join_unique
from kindred.plans.thresholds import max_distance
from kindred.sources.scratch import Scratch


def init_groups(state: DataFrame, new_paths: DataFrame) -> DataFrame:
    """Label new rows that have no group with their own id."""
    marked = state.join(new_paths.select("path", F.lit(True).alias("_new")), "path", "left")
    own = F.when(F.col("_new"), F.col("image_id"))
    return marked.withColumn("group_id", F.coalesce("group_id", own)).drop("_new")


def merge_groups(state: DataFrame, moves: DataFrame, scratch: Scratch) -> DataFrame:
    """Give all members of group ``old`` the label ``new``.

    ``moves`` has one row per old label.
    """
    moved = join_unique(
        state, moves.where("old <> new").select(F.col("old").alias("group_id"), "new"), "group_id", "left", scratch
    )
    return moved.withColumn("group_id", F.coalesce("new", "group_id")).drop("new")


def cluster(images: DataFrame, threshold: int, scratch: Scratch,
            limits: JoinLimits = DEFAULT_LIMITS) -> DataFrame:
    """Set ``group_id`` of all rows (``image_id, phash, ...``) from scratch."""
    distance = max_distance(threshold)
    images = images.drop("group_id")
    labels = scratch.keep(distinct_hashes(images).select("phash", "id"), "distinct")
    if distance:
        rows = labels.select("id", "phash", F.lit(True).alias("fresh"))
        roots = connected_components(similar_links(rows, distance, scratch, limits), scratch)
        labels = labels.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
            "phash", F.coalesce("root", "id").alias("group_id")
        )
    else:
        labels = labels.withColumnRenamed("id", "group_id")
    return join_unique(images, labels, "phash", "left", scratch)


# Rows of a counted list that may be broadcast to look up stored rows (16 bytes each).
LOOKUP_ROWS = 2_000_000


class Index(Protocol):
    """Finds stored fingerprints near given ones (``sources.key_index.KeyIndex``)."""

    def near(self, probes: DataFrame, distance: int) -> DataFrame: ...


def stored_labels(settled: DataFrame, hashes: DataFrame, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """``phash, group_id`` of the stored rows that have one of ``hashes`` (distinct, a stored table).

    A counted, short list goes to the stored rows by broadcast, so what leaves
    them is at most one row per hash and task.  A longer one meets them by a
    shuffle.
    """
    if hashes.count() <= lookup_rows:
        found = settled.join(F.broadcast(hashes), "phash", "left_semi")
    else:
        found = settled.join(hashes.hint("merge"), "phash", "left_semi")
    return found.groupBy("phash").agg(F.min("group_id").alias("group_id"))


def _relabelled(state: DataFrame, moves: DataFrame, scratch: Scratch, lookup_rows: int) -> DataFrame:
    """:func:`merge_groups` with a broadcast where the moves are counted and few."""
    if moves.count() > lookup_rows:
        return merge_groups(state, moves, scratch)
    moved = state.join(F.broadcast(moves.withColumnsRenamed({"old": "group_id", "new": "_new"})), "group_id", "left")
    return moved.withColumn("group_id", F.coalesce("_new", "group_id")).select(*state.columns)


def _near_stored(settled: DataFrame, fresh: DataFrame, distance: int, scratch: Scratch, limits: JoinLimits,
                 index: Index | None, lookup_rows: int) -> DataFrame:
    """``phash, group_id``: old groups that hold a fingerprint within ``distance`` of a fresh one, equal ones included."""
    if index is not None and distance:
        near = scratch.keep(index.near(fresh, distance).where("phash <> stored"), "near")
        known = scratch.keep(
            near.select(F.col("stored").alias("phash")).unionByName(fresh.select("phash")).distinct(), "asked"
        )
        labels = scratch.keep(stored_labels(settled, known, lookup_rows), "labels")
        close = near.join(labels.withColumnRenamed("phash", "stored"), "stored").select("phash", "group_id")
        return close.unionByName(labels.join(fresh.select("phash"), "phash", "left_semi"))
    equal = scratch.keep(stored_labels(settled, fresh.select("phash"), lookup_rows), "labels")
    if not distance:
        return equal
    # Negative ids mark the fresh rows.  Without an index the stored rows are keyed here.
    old = settled.groupBy("phash").agg(F.min("group_id").alias("id")).select("id", "phash", F.lit(False).alias("fresh"))
    asked = fresh.select((-F.col("own") - 1).alias("id"), "phash", F.lit(True).alias("fresh"))
    old = old.join(asked.select("phash"), "phash", "left_anti")
    close = similar_pairs(scratch.keep(asked.unionByName(old), "hashes"), distance, scratch, limits).where("b >= 0")
    close = close.select((-F.col("a") - 1).alias("own"), F.col("b").alias("group_id")).join(fresh, "own")
    return close.select("phash", "group_id").unionByName(equal)


def cluster_incremental(settled: DataFrame, pending: DataFrame, threshold: int, scratch: Scratch,
                        limits: JoinLimits = DEFAULT_LIMITS, index: Index | None = None,
                        lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Add ``pending`` rows to the groups of the ``settled`` rows.

    ``settled`` rows keep ``group_id`` unless pending rows connect their group
    to a smaller label.  Settled rows are compared with pending rows only.
    The nodes of the component step are whole old groups and pending
    fingerprints, so its size follows the change, not the state.

    With an ``index`` of the settled fingerprints the stored rows are read but
    never shuffled, as long as the new fingerprints, their stored neighbours and
    the merged groups are at most ``lookup_rows`` each.
    """
    distance = max_distance(threshold)
    columns = [*settled.columns]
    fresh = scratch.keep(pending.groupBy("phash").agg(F.min("image_id").alias("own")), "fresh")
    old = _near_stored(settled, fresh, distance, scratch, limits, index, lookup_rows)
    links = old.join(fresh, "phash").select(F.col("group_id").alias("a"), F.col("own").alias("b"))
    if distance:
        among = fresh.select(F.col("own").alias("id"), "phash", F.lit(True).alias("fresh"))
        links = links.unionByName(similar_links(among, distance, scratch, limits).select("a", "b"))
    roots = connected_components(links, scratch)

    moves = scratch.keep(roots.select(F.col("node").alias("old"), F.col("root").alias("new")), "moves")
    kept = _relabelled(settled, moves, scratch, lookup_rows)
    labels = fresh.join(moves.withColumnRenamed("old", "own"), "own", "left").select(
        "phash", F.coalesce("new", "own").alias("group_id")
    )
    joined = join_unique(pending.drop("group_id"), labels, "phash", "left", scratch)
    return kept.select(*columns).unionByName(joined.select(*columns))


def new_neighbours(settled: DataFrame, new: DataFrame, threshold: int, scratch: Scratch,
                   limits: JoinLimits = DEFAULT_LIMITS, index: Index | None = None,
                   lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Distinct ``image_id, group_id``: old groups similar to each new row.

    With an ``index`` of the settled fingerprints the stored rows are not shuffled.
    """
    distance = max_distance(threshold)
    fresh = scratch.keep(new.groupBy("phash").agg(F.min("image_id").alias("own")), "fresh")
    found = _near_stored(settled, fresh, distance, scratch, limits, index, lookup_rows)
    if index is None and distance:
        # A new fingerprint equal to a stored one stands for it beside other new ones.
        among = fresh.select(F.col("own").alias("id"), "phash", F.lit(True).alias("fresh"))
        pairs = similar_pairs(among, distance, scratch, limits).select("a", "b")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        equal = stored_labels(settled, fresh.select("phash"), lookup_rows).join(fresh, "phash")
        twins = both.join(equal.select(F.col("own").alias("b"), "group_id"), "b").select(F.col("a").alias("own"), "group_id")
        found = found.unionByName(twins.join(fresh, "own").select("phash", "group_id"))
    groups = found.distinct().join(fresh, "phash").select("own", "group_id")
    labelled = join_unique(new.select("image_id", "phash"), fresh, "phash", "inner", scratch)
    return labelled.join(groups, "own").select("image_id", "group_id")


def regroup(state: DataFrame, touched: DataFrame, changed: DataFrame, threshold: int, scratch: Scratch,
            limits: JoinLimits = DEFAULT_LIMITS, index: Index | None = None,
            lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """New groups after rows were removed or changed.

    ``state`` holds the unchanged rows that are left, ``touched`` the labels
    (``group_id``) of groups that lost a row, ``changed`` the new or changed
    rows.  The rest of the touched groups is grouped again by itself, since no
    other group had an edge to it; then the changed rows meet all others.
    """
    columns = [*state.columns]
    broken = scratch.keep(touched.select("group_id").where("group_id is not null").distinct(), "broken")
    broken = broken.withColumn("_broken", F.lit(True))
    if broken.count() <= lookup_rows:
        marked = state.join(F.broadcast(broken), "group_id", "left")
    else:
        marked = join_unique(state, broken, "group_id", "left", scratch)
    marked = scratch.keep(marked, "marked")
    left_over = cluster(marked.where("_broken").select(*columns), threshold, scratch, limits)
    settled = marked.where("_broken is null").select(*columns).unionByName(left_over.select(*columns))
    if changed.isEmpty():
        return settled
    return cluster_incremental(settled, changed.select(*columns), threshold, scratch, limits, index, lookup_rows)
