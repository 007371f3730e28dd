"""Fingerprints of image files: ``path, size, modified_ns, phash, error``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import suppress
from importlib.util import find_spec
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import image_hash
from kindred.operators.spreading import even_partitions
from kindred.sources.listing import LISTING_SCHEMA, few_file_tasks, local_path, remote_path, setting
from kindred.sources.scratch import Scratch

# Fixed value: text for a failure that gives no reason.
UNKNOWN_ERROR = "Error desconocido"

FINGERPRINT_SCHEMA = LISTING_SCHEMA + ", phash bigint, error string"
HASHED_SCHEMA = "path string, phash bigint, error string"
# Encoded bytes one task should decode.
BYTES_PER_TASK = 128 << 20
FILES_PER_TASK = 4096
# Decoded images per Arrow batch when the JVM decodes.
IMAGES_PER_BATCH = 32
# Paths that one read of the image source is given on average; any number of
# files is read in shards of this size.
SHARD_PATHS = 10_000
# Shards that are looked up and read at a time.
SHARDS_AT_ONCE = 4
# Spark's file sources pass over such names.
HIDDEN_NAME = r"(^|/)(\.[^/]*|_[^/=]*)$"
HIDDEN_ERROR = "names that start with . or _ need Pillow or another decoder"

# What a file can be blamed for; anything else fails the task.
DECODE_ERRORS = (OSError, ValueError, SyntaxError, EOFError)

Decoder = Callable[[bytes], np.ndarray]


def open_input(path: str, systems: dict):
    """Open a file of any supported file system; see ``remote_path``."""
    local = local_path(path)
    if local:
        return open(local, "rb")
    system, inner = remote_path(path, systems)
    return system.open_input_file(inner)


def _hash_all(blocks: list[np.ndarray | None]) -> pd.Series:
    hashes = pd.Series([None] * len(blocks), dtype="Int64")
    good = [i for i, block in enumerate(blocks) if block is not None]
    if good:
        hashes.iloc[good] = image_hash.hash_blocks(np.stack([blocks[i] for i in good]))
    return hashes


def hash_files(
    files: DataFrame, decode: Decoder = image_hash.pillow_block, scratch: Scratch | None = None
) -> DataFrame:
    """Read, decode and hash every file of a listing.

    Only paths travel through Spark; each task opens its own files and holds
    one encoded image at a time.  Tasks get about equal bytes.  ``decode`` turns the bytes of a file into a
    32x32 grey block.  A file that fails becomes a row with an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        systems = {}
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start : start + 512].reset_index(drop=True)
                blocks, errors = [], []
                for path in part["path"]:
                    block, error = None, None
                    try:
                        with open_input(path, systems) as stream:
                            block = decode(stream.read())
                    except DECODE_ERRORS as failure:  # one bad file never stops the run
                        error = str(failure) or UNKNOWN_ERROR
                    blocks.append(block)
                    errors.append(error)
                yield part.assign(phash=_hash_all(blocks), error=errors)

    size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(size[0], max(
        files.sparkSession.sparkContext.defaultParallelism,
        size[0] // FILES_PER_TASK, size[1] // BYTES_PER_TASK,
    )))
    given = files.select("path", "size", "modified_ns")
    weight = F.coalesce("size", F.lit(0)) + BYTES_PER_TASK // FILES_PER_TASK
    spread = even_partitions(given, weight, ["path"], int(tasks), scratch or Scratch(files.sparkSession))
    return spread.mapInPandas(run, FINGERPRINT_SCHEMA)


def _hash_decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    systems = {}
    for batch in batches:
        blocks, errors = [], []
        for row in batch.itertuples(index=False):
            block, error = None, None
            try:
                if row.height < 0:
                    raise ValueError("cannot identify image file")
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                grey = image_hash.grey_of(pixels)
                with open_input(row.path, systems) as stream:
                    grey = image_hash.upright(grey, image_hash.exif_orientation(stream))
                block = image_hash.shrink(grey)
            except DECODE_ERRORS as failure:
                error = str(failure) or UNKNOWN_ERROR
            blocks.append(block)
            errors.append(error)
        yield pd.DataFrame({"path": batch["path"], "phash": _hash_all(blocks), "error": errors})


def decoded_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Images decoded by the JVM: ``path, height, width, channels, data``.

    Rows that cannot be decoded have a height of -1.
    """
    image = spark.read.format("image").option("recursiveFileLookup", "true").load(paths)
    # The source gives the path as an encoded URI.
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    return image.select(
        origin.alias("path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def register_phash(spark: SparkSession, name: str = "phash", decode: Decoder = image_hash.pillow_block) -> None:
    """Make ``phash(content)`` known to SQL: the hash of an encoded image.

    ``content`` is binary, as in Spark's ``binaryFile`` source.  A null or
    unreadable image gives null.
    """

    @F.pandas_udf("bigint")
    def phash(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in contents:
            blocks = []
            for content in batch:
                block = None
                if content is not None:
                    with suppress(*DECODE_ERRORS):
                        block = decode(bytes(content))
                blocks.append(block)
            yield _hash_all(blocks)

    spark.udf.register(name, phash)


def small_batches(spark: SparkSession):
    """Few decoded images per Arrow batch while a job is run."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", IMAGES_PER_BATCH)


def few_listing_tasks(spark: SparkSession):
    """One listing task per core, not one per path, for lists of paths."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    return setting(spark, name, spark.sparkContext.defaultParallelism)


def no_listing_cache(spark: SparkSession):
    """Nothing kept of listings while a job is run; by default Spark keeps 250 MB of them on the driver."""
    return setting(spark, "spark.sql.hive.filesourcePartitionFileCacheSize", 0)


def decode_shards(
    spark: SparkSession, files: DataFrame, each: Callable[[DataFrame], DataFrame], schema: str, scratch: Scratch
) -> DataFrame:
    """What ``each`` makes of the images of a listing, decoded by the ``image`` source of Spark.

    ``each`` turns images as of :func:`decoded_images` into rows of ``schema``;
    paths of local files come without a scheme.  Files are read by name, in
    shards by a hash of the path, so the driver holds the names of
    ``SHARDS_AT_ONCE`` shards however many files there are; while it looks up
    the files of one, others are decoded.  The source cannot read names that
    start with ``.`` or ``_``: they give no row.
    """
    shards = max(1, -(-files.count() // SHARD_PATHS))
    plain = F.regexp_replace("path", "^file:/+", "/")
    named = scratch.folder("shards")
    (
        files.where(~F.col("path").rlike(HIDDEN_NAME))
        .select(plain.alias("plain"))
        .select("plain", F.expr(f"cast(pmod(xxhash64(plain), {shards}) as int)").alias("shard"))
        .repartition("shard")
        .write.partitionBy("shard")
        .parquet(named)
    )
    by_shard = spark.read.schema("plain string, shard int").parquet(named)
    done = scratch.folder("decoded")

    def decode_shard(shard: int) -> bool:
        paths = [row.plain for row in by_shard.where(F.col("shard") == shard).select("plain").collect()]
        if paths:
            literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path in paths]
            decoded = decoded_images(spark, literal).withColumn("path", plain)
            # A folder each: of two jobs that append to one, the first to end removes the files of the other.
            each(decoded).write.parquet(f"{done}/part={shard}")
        return bool(paths)

    with (
        small_batches(spark), few_listing_tasks(spark), few_file_tasks(spark), no_listing_cache(spark),
        ThreadPool(SHARDS_AT_ONCE) as pool,
    ):
        found = pool.map(decode_shard, range(shards), chunksize=1)
    if any(found):
        return spark.read.schema(schema).parquet(done).drop("part")
    return spark.createDataFrame([], schema)


def hash_files_jvm(spark: SparkSession, files: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Like :func:`hash_files`, decoded by the ``image`` source of Spark.

    For clusters without Pillow.  Pixels are hashed where they are decoded,
    shard by shard; only the hashes are joined with the listing.  Names that
    start with ``.`` or ``_`` get an error that says so.
    """
    scratch = scratch or Scratch(spark)
    listed = files.select("path", "size", "modified_ns", F.regexp_replace("path", "^file:/+", "/").alias("plain"))
    hashed = decode_shards(
        spark, files, lambda decoded: decoded.mapInPandas(_hash_decoded, HASHED_SCHEMA), HASHED_SCHEMA, scratch
    )
    missing = F.when(F.col("path").rlike(HIDDEN_NAME), HIDDEN_ERROR).otherwise(UNKNOWN_ERROR)
    return listed.join(hashed.withColumnRenamed("path", "plain"), "plain", "left").select(
        "path", "size", "modified_ns", "phash",
        F.when(F.col("phash").isNull(), F.coalesce("error", missing)).alias("error"),
    )


def fingerprint_files(
    spark: SparkSession, files: DataFrame, decode: Decoder | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """Fingerprints by ``decode``, by Pillow where present, else by the JVM."""
    if decode is None and find_spec("PIL") is not None:
        decode = image_hash.pillow_block
    if decode is not None:
        return hash_files(files, decode, scratch)
    return hash_files_jvm(spark, files, scratch)
