"""One run over a folder or a listing: compare, hash, regroup, publish, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import snapshot_diff as diff
from kindred.operators.clustering import cluster, regroup
from kindred.operators.numbering import assign_ids
from kindred.plans.thresholds import DEFAULT_THRESHOLD, check_threshold, max_distance
from kindred.sources.images import Decoder, fingerprint_files
from kindred.sources.key_index import IndexInfo, KeyIndex
from kindred.sources.listing import list_images
from kindred.sources.report import SUMMARY_KEYS, write_report
from kindred.sources.scratch import Scratch
from kindred.sources.snapshots import Manifest, SnapshotStore

Fingerprint = Callable[[DataFrame], DataFrame]

# Fingerprints from which an index of their keys pays: below, keying them anew takes seconds.
INDEX_FROM = 1_000_000
# Versions of the state that a run over a folder leaves.
KEPT_VERSIONS = 2


@dataclass(frozen=True)
class RunResult:
    """Counters of a run and its tables."""

    images: int
    reused: int
    calculated: int
    new_images: int
    full_rebuild: bool
    state: DataFrame
    unreadable: DataFrame


def _stored_index(spark: SparkSession, current: Manifest | None, threshold: int) -> KeyIndex | None:
    """The index of the version read, if it serves this threshold."""
    info = IndexInfo(**current.index) if current and current.index else None
    return KeyIndex(spark, info) if info and info.distance == max_distance(threshold) else None


def _new_index(result: DataFrame, threshold: int, store: SnapshotStore, scratch: Scratch, index_from: int) -> KeyIndex | None:
    """An index of all fingerprints of ``result`` where there are at least ``index_from``."""
    hashes = scratch.keep(result.select("phash").distinct(), "indexed")
    if not max_distance(threshold) or hashes.count() < index_from:
        return None
    return KeyIndex.build(hashes, max_distance(threshold), store.index_folder())


def sync(spark: SparkSession, listing: DataFrame, store: SnapshotStore, fingerprint: Fingerprint,
         threshold: int = DEFAULT_THRESHOLD, scratch: Scratch | None = None,
         index_from: int = INDEX_FROM) -> RunResult:
    """Bring the stored state in line with ``listing`` and publish it.

    ``listing`` (``path, size, modified_ns``) is complete: stored paths that
    are not in it are forgotten.  ``fingerprint`` adds ``phash, error`` to
    the new and modified rows only.  Nothing is visible to readers before the
    new version is published as a whole.

    From ``index_from`` fingerprints on, a full grouping also writes an index of
    their keys, and later runs add the new ones to it before they publish.
    """
    check_threshold(threshold)
    scratch = scratch or Scratch(spark)
    current = store.manifest()
    state, saved = store.read(current), current.threshold if current else None
    actions = scratch.keep(diff.diff_snapshots(state, listing), "actions")
    to_hash = actions.where("action in ('new', 'modified')").select("path", "size", "modified_ns")
    hashed = scratch.keep(fingerprint(to_hash), "hashed")

    decision = diff.rebuild_decision(actions, saved, threshold).first()
    counters = diff.run_counters(actions, hashed).first()

    columns = state.columns
    unchanged = actions.where("action = 'unchanged'").select(*columns)
    good = hashed.where("phash is not null").select("path", "size", "modified_ns", "phash")
    known_ids = actions.where("action = 'modified'").select("path", "image_id")
    no_group = F.lit(None).cast("bigint").alias("group_id")
    modified = good.join(known_ids, "path").select(
        "image_id", "path", "size", "modified_ns", "phash", no_group
    )
    new = good.join(actions.where("action = 'new'").select("path"), "path", "left_semi")
    new = assign_ids(new, state, scratch).select("image_id", "path", "size", "modified_ns", "phash", no_group)
    changed = scratch.keep(modified.unionByName(new), "changed")

    index = _stored_index(spark, current, threshold)
    if decision.threshold_changed or decision.has_null_group:
        result = scratch.keep(cluster(unchanged.unionByName(changed), threshold, scratch), "result")
        index = _new_index(result, threshold, store, scratch, index_from)
    elif decision.full_rebuild or counters.calculated:
        touched = actions.where("action in ('modified', 'removed')").select("group_id")
        result = regroup(unchanged, touched, changed, threshold, scratch, index=index)
        if index:
            index.add(changed.select("phash").distinct())
        elif counters.images >= index_from:
            result = scratch.keep(result, "result")
            index = _new_index(result, threshold, store, scratch, index_from)
    else:
        result = None  # the stored rows stay as they are
    store.publish(result, threshold, current, asdict(index.info) if index else None)
    return RunResult(
        images=counters.images,
        reused=counters.reused,
        calculated=counters.calculated,
        new_images=counters.new_images,
        full_rebuild=decision.full_rebuild,
        state=store.read(),
        unreadable=diff.unreadable(hashed).select("path", "error"),
    )


def group_folder(spark: SparkSession, folder: str, threshold: int = DEFAULT_THRESHOLD,
                 state: str | None = None, report: str | None = None,
                 decode: Decoder | None = None) -> RunResult:
    """Group the similar images of a folder tree and write the report.

    The state keeps its newest ``KEPT_VERSIONS`` versions.  ``state`` defaults to
    ``<folder>/.similar_images`` and ``report`` to
    ``grupos_similares.json`` in the state folder's parent.
    """
    check_threshold(threshold)
    scratch = Scratch(spark)
    state = state or folder.rstrip("/") + "/.similar_images"
    report = report or state.rstrip("/").rsplit("/", 1)[0] + "/grupos_similares.json"
    store = SnapshotStore(spark, state)
    result = sync(
        spark,
        list_images(spark, folder, scratch),
        store,
        lambda files: fingerprint_files(spark, files, decode, scratch),
        threshold,
        scratch,
    )
    values = (
        folder, threshold, result.images, result.reused, result.calculated, not result.full_rebuild, result.new_images,
    )
    summary = dict(zip(SUMMARY_KEYS, values, strict=True))
    write_report(summary, result.state, result.unreadable, report, scratch)
    store.vacuum(KEPT_VERSIONS)
    return result
