"""Versioned Parquet snapshots of the fingerprint state.

A run writes all its rows below ``v=<n>-<id>``, then one small manifest under
another name, which it renames to ``manifest-<n>.json``.  A version exists once
its manifest does, whole, so a run that dies earlier leaves the previous version
in place.  ``n`` follows the version that the run has read, and the rename fails
when the name is taken: of two runs from one version only one publishes, and the
other one ends with the error of the file system.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_SCHEMA = (
    "image_id bigint, path string, size bigint, modified_ns bigint, phash bigint, group_id bigint"
)


@dataclass(frozen=True)
class Manifest:
    version: int
    threshold: int
    folder: str
    # What ``sources.key_index`` needs to open the index of the stored keys.
    index: dict | None = None


class SnapshotStore:
    """Reads and publishes versions of the state below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        found = self._fs.globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        return sorted(int(f.getPath().getName()[len("manifest-") : -len(".json")]) for f in found)

    def manifest(self) -> Manifest | None:
        """The newest manifest, ``None`` before the first run."""
        published = self.versions()
        return self._load(published[-1]) if published else None

    def _name(self, version: int) -> str:
        return f"{self.root}/manifest-{version:010d}.json"

    def _load(self, version: int) -> Manifest:
        stream = self._fs.open(self._path(self._name(version)))
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def read(self, current: Manifest | None = None) -> DataFrame:
        """The state of ``current``, else the newest, empty before the first run."""
        current = current or self.manifest()
        if current is None:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        return self.spark.read.schema(STATE_SCHEMA).parquet(current.folder)

    def saved_threshold(self) -> int | None:
        """Threshold of the newest run, ``None`` before the first one."""
        current = self.manifest()
        return current.threshold if current else None

    def stage(self, rows: DataFrame, version: int) -> str:
        """Write the rows of a version without publishing it."""
        folder = f"{self.root}/v={version}-{uuid.uuid4().hex}"
        rows.select("image_id", "path", "size", "modified_ns", "phash", "group_id").write.parquet(folder)
        return folder

    def index_folder(self) -> str:
        """Name for a new index of the stored keys."""
        return f"{self.root}/keys-{uuid.uuid4().hex}"

    def publish(
        self, rows: DataFrame | None, threshold: int, based_on: Manifest | None, index: dict | None = None
    ) -> Manifest:
        """Make ``rows`` the version after ``based_on``, the one the run has read.

        ``None`` for rows keeps those of ``based_on`` without writing them again.
        ``index`` describes an index that holds every fingerprint of ``rows``.
        """
        version = (based_on.version if based_on else 0) + 1
        if rows is None and based_on:
            folder = based_on.folder
        else:
            folder = self.stage(self.read() if rows is None else rows, version)
        made = Manifest(version, threshold, folder, index)
        self._rename(self._write(json.dumps(made.__dict__)), self._name(version))
        return made

    def _write(self, text: str) -> str:
        name = f"{self.root}/.manifest-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        return name

    def _rename(self, source: str, target: str) -> None:
        """Rename that fails when the target exists, also for two callers at the same moment.

        Local and mounted file systems look before they rename, so there the
        target is made as a hard link, which the file system refuses if the
        name is taken.
        """
        if self._fs.getUri().getScheme() == "file":
            names = [self._fs.makeQualified(self._path(x)).toUri().getPath() for x in (source, target)]
            os.link(*names)
            self._fs.delete(self._path(source), False)
            return
        spark = self.spark.sparkContext
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), spark._jsc.hadoopConfiguration()
        )
        options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        mode = spark._gateway.new_array(options, 1)
        mode[0] = options.NONE
        context.rename(self._fs.makeQualified(self._path(source)), self._fs.makeQualified(self._path(target)), mode)

    def _folders(self, made: Manifest) -> list[str]:
        """Names of what a version uses."""
        return [self._path(x).getName() for x in (made.folder, (made.index or {}).get("folder")) if x]

    def vacuum(self, keep: int = 2, orphan_hours: float = 24) -> None:
        """Delete all but the newest ``keep`` versions, and what dead runs left.

        Rows and manifests that no version names are deleted once they are
        older than ``orphan_hours``; a run must be shorter than that.
        """
        published = self.versions()
        gone = [self._load(v) for v in published[: -max(1, keep)]]
        used = {x for v in published[-max(1, keep) :] for x in self._folders(self._load(v))}
        for old in gone:
            self._fs.delete(self._path(self._name(old.version)), False)
        expired = {x for old in gone for x in self._folders(old)} - used
        before = (time.time() - orphan_hours * 3600) * 1000
        for pattern in ("v=*", "keys-*", ".manifest-*"):
            for found in self._fs.globStatus(self._path(f"{self.root}/{pattern}")) or []:
                name = found.getPath().getName()
                if name in expired or (name not in used and found.getModificationTime() <= before):
                    self._fs.delete(found.getPath(), True)


def records_for_paths(state: DataFrame, paths: DataFrame) -> DataFrame:
    """Stored rows of the given paths."""
    return state.join(paths.select("path"), "path", "left_semi").select(
        "image_id", "path", "phash", "group_id"
    )


def has_missing_group(state: DataFrame) -> DataFrame:
    """One row: whether some stored row has no group yet."""
    return state.agg(
        F.coalesce(F.bool_or(F.col("group_id").isNull()), F.lit(False)).alias("has_null_group")
    )
