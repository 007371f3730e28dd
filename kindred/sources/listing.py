"""Listing of image files with size and modification time."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.scratch import Scratch

# The accepted image suffixes.
IMAGE_EXTENSIONS = (
    ".avif", ".bmp", ".gif", ".heic", ".heif", ".jpeg", ".jpg", ".jxl", ".png",
    ".tif", ".tiff", ".webp",
)

# A dot that starts a name does not start a suffix.
SUFFIX_PATTERN = r"[^/](\.[^./]+)$"
LISTING_SCHEMA = "path string, size bigint, modified_ns bigint"
LISTING_BATCH = 10_000
# Bytes that opening one image counts for when files are dealt to tasks.
OPEN_COST = 128 << 10


def extension(path: Column) -> Column:
    """Last suffix of a path in lower case, empty when there is none."""
    return F.lower(F.regexp_extract(path, SUFFIX_PATTERN, 1))


def is_image(path: Column) -> Column:
    """Whether a path ends in one of the image suffixes."""
    return extension(path).isin(*IMAGE_EXTENSIONS)


def _named_like_image(name: str) -> bool:
    found = re.search(SUFFIX_PATTERN, name)
    return bool(found) and found.group(1).lower() in IMAGE_EXTENSIONS


def _local_entries(folder: str) -> Iterator[tuple[bool, str, int, int]]:
    try:
        entries = os.scandir(folder)
    except OSError:
        return
    with entries:
        for entry in entries:
            try:
                if entry.is_dir():
                    if not entry.is_symlink():
                        yield True, entry.path, 0, 0
                elif _named_like_image(entry.name):
                    found = entry.stat()
                    yield False, entry.path, found.st_size, found.st_mtime_ns
            except OSError:
                continue


def remote_path(path: str, systems: dict) -> tuple:
    """File system of a path ``scheme://host/...`` and the path inside it.

    Only the part before the path is read as a URI, since names may hold
    spaces, ``#``, ``?`` or ``%``.  ``systems`` keeps ``(file system, path of
    its root)`` by that part, so one task connects once.
    """
    from pyarrow import fs

    where, rest = re.match(r"([^:/]+://[^/]*)(.*)", path, re.DOTALL).groups()
    if where not in systems:
        systems[where] = fs.FileSystem.from_uri(where + "/")
    system, base = systems[where]
    return system, base.rstrip("/") + rest


def _remote_entries(folder: str, systems: dict) -> Iterator[tuple[bool, str, int, int]]:
    from pyarrow import fs

    system, inner = remote_path(folder, systems)
    for found in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        path = folder.rstrip("/") + "/" + found.base_name
        if found.type == fs.FileType.Directory:
            yield True, path, 0, 0
        elif found.type == fs.FileType.File and _named_like_image(found.base_name):
            yield False, path, found.size, found.mtime_ns


def local_path(path: str) -> str | None:
    """Plain form of a local path or ``file:`` URI, ``None`` for other systems."""
    if path.startswith("file:"):
        return re.sub(r"^file:/+", "/", path)
    return None if "://" in path else path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` in the session's default file system: plain if local, else a full URI."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    local = local_path(system.makeQualified(hadoop).toString())
    if local is None:
        return system.makeQualified(hadoop).toString().rstrip("/")
    return os.path.abspath(local_path(path) or local)


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, systems = [], {}
    for batch in batches:
        for folder in batch["folder"]:
            local = local_path(folder)
            entries = _local_entries(local) if local else _remote_entries(folder, systems)
            for row in entries:
                rows.append(row)
                if len(rows) == LISTING_BATCH:
                    yield pd.DataFrame(rows, columns=["is_folder", "path", "size", "modified_ns"])
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["is_folder", "path", "size", "modified_ns"])


def list_images(spark: SparkSession, root: str, scratch: Scratch | None = None) -> DataFrame:
    """All image files below ``root``: ``path, size, modified_ns``.

    The tree is walked level by level; every level is one Spark job over the
    folders found so far, so neither the driver nor one task sees the whole
    tree.  Hidden names are listed; linked folders are not entered; files
    whose metadata cannot be read are left out.
    """
    scratch = scratch or Scratch(spark)
    root = qualified(spark, root)
    if local_path(root) and not os.path.isdir(root):
        raise NotADirectoryError(root)
    frontier = spark.createDataFrame([(root,)], "folder string")
    folders = 1
    files = spark.createDataFrame([], LISTING_SCHEMA)
    while folders:
        level = scratch.keep(
            frontier.repartition(min(folders, 100_000), "folder").mapInPandas(
                _list_folders, "is_folder boolean, " + LISTING_SCHEMA
            ),
            "listing",
        )
        files = files.union(level.where(~F.col("is_folder")).select("path", "size", "modified_ns"))
        frontier = level.where("is_folder").select(F.col("path").alias("folder"))
        folders = frontier.count()
    return files


@contextmanager
def setting(spark: SparkSession, name: str, value: int):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few_file_tasks(spark: SparkSession):
    """Tasks of many small files while a job is run; by default 32 files make a task."""
    return setting(spark, "spark.sql.files.openCostInBytes", OPEN_COST)


def list_images_hadoop(spark: SparkSession, root: str, scratch: Scratch | None = None) -> DataFrame:
    """The same columns from Spark's own file index, for any Hadoop file system.

    Content is not read.  The index lives on the driver, skips names that
    start with ``.`` or ``_``, enters linked folders and has milliseconds
    only, so prefer :func:`list_images` where executors can reach the files.
    Its folders are listed by tasks, one each, and the rows are written once.
    """
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.threshold", 0):
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(root)
            .select("path", "length", "modificationTime")
        )
    named = found.where(is_image(F.col("path"))).select(
        "path",
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("modified_ns"),
    )
    with few_file_tasks(spark):
        return (scratch or Scratch(spark)).keep(named, "listing")
