"""Block keys of the stored fingerprints, bucketed, so that a run moves its new keys only.

One row per fingerprint and key of a scheme (``plans.key_schemes``):
``no, key, salt, phash``.  The table is bucketed and sorted by the first three,
so a join reads every bucket where it lies and shuffles only the other side.

The index holds every stored fingerprint at least once.  What it holds beyond
that (forgotten fingerprints, a second entry from a run that died) finds no
stored row and so changes nothing.  A run adds the keys of its new fingerprints
before it publishes its rows; a full build writes a new index.

Keys that many fingerprints share (dark or flat pictures) are counted when the
index is built.  Such a key is spread over ``ceil(rows / HOT_ROWS)`` salts and a
probe goes to all of them, so that no bucket holds a hot key as a whole.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.similarity import with_keys
from kindred.plans.key_schemes import KeyScheme, choose_scheme, contiguous_blocks
from kindred.sources.scratch import Scratch

# Key rows of one bucket at the time of the build, and of one salt of a key.
BUCKET_ROWS = 4_000_000
HOT_ROWS = 50_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000
# New fingerprints that a scheme is chosen for, as a share of the stored ones.
EXPECTED_SHARE = 100
_COLUMNS = "no INT, key BIGINT, salt INT, phash BIGINT"
_HOT = "no INT, key BIGINT, salts INT"


@dataclass(frozen=True)
class IndexInfo:
    """What a manifest says about an index."""

    folder: str
    distance: int
    agree: int
    buckets: int


def _name(folder: str) -> str:
    return f"kindred_keys_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"


def _keyed(hashes: DataFrame, scheme: KeyScheme) -> DataFrame:
    return with_keys(hashes.select("phash"), scheme).select(F.col("no1").alias("no"), F.col("key1").alias("key"), "phash")


class KeyIndex:
    """An index that has been built; ``info`` opens it again in another session."""

    def __init__(self, spark: SparkSession, info: IndexInfo):
        self.spark, self.info = spark, info
        self.scheme = KeyScheme(contiguous_blocks(info.distance + info.agree), info.agree)
        self._table = _name(info.folder)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._table} ({_COLUMNS}) USING parquet "
            f"CLUSTERED BY (no, key, salt) SORTED BY (no, key, salt) INTO {info.buckets} BUCKETS LOCATION '{info.folder}/keys'"
        )

    @classmethod
    def build(cls, hashes: DataFrame, distance: int, folder: str, bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS) -> KeyIndex:
        """Index of distinct ``phash`` (a stored table), written below ``folder``."""
        spark = hashes.sparkSession
        n = hashes.count()
        scheme = choose_scheme(distance, max(1, n // EXPECTED_SHARE), max(1, n))
        keyed = _keyed(hashes, scheme)
        counts = keyed.groupBy("no", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
        hot = counts.select("no", "key", F.ceil(F.col("n") / hot_rows).cast("int").alias("salts"))
        hot.write.parquet(f"{folder}/hot")
        n_keys = n * len(scheme.key_masks)
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-n_keys // bucket_rows)))
        index = cls(spark, IndexInfo(folder, distance, scheme.agree, buckets))
        index._write(keyed, "overwrite")
        return index

    def _hot(self) -> DataFrame:
        """Hot keys and their salts; a key row in ``HOT_ROWS`` at most."""
        return F.broadcast(self.spark.read.schema(_HOT).parquet(f"{self.info.folder}/hot"))

    def _write(self, keyed: DataFrame, mode: str) -> None:
        salt = F.coalesce(F.pmod(F.xxhash64("phash"), F.col("salts")), F.lit(0)).cast("int")
        rows = keyed.join(self._hot(), ["no", "key"], "left").select("no", "key", salt.alias("salt"), "phash")
        by = ("no", "key", "salt")
        (
            rows.repartition(self.info.buckets, *by)  # as the buckets do, so each is one file
            .write.format("parquet")
            .option("path", f"{self.info.folder}/keys")
            .bucketBy(self.info.buckets, *by)
            .sortBy(*by)
            .mode(mode)
            .saveAsTable(self._table)
        )

    def add(self, hashes: DataFrame) -> None:
        """Add the keys of distinct ``phash``."""
        self._write(_keyed(hashes, self.scheme), "append")

    def near(self, probes: DataFrame, distance: int) -> DataFrame:
        """Distinct ``phash, stored``: indexed fingerprints within ``distance`` of each probe.

        Only the keys of the probes are shuffled.
        """
        if distance > self.info.distance:
            raise ValueError(f"the index reaches {self.info.distance} bits, not {distance}")
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
        asked = (
            _keyed(probes, self.scheme)
            .join(self._hot(), ["no", "key"], "left")
            .select("no", "key", salts.alias("salt"), F.col("phash").alias("asked"))
            .repartition(self.info.buckets, "no", "key", "salt")
        )
        close = F.bit_count(F.col("asked").bitwiseXOR(F.col("phash"))) <= distance
        met = asked.hint("merge").join(self.spark.table(self._table), ["no", "key", "salt"]).where(close)
        return met.select(F.col("asked").alias("phash"), F.col("phash").alias("stored")).distinct()

    def to_json(self) -> str:
        return json.dumps(asdict(self.info))

    def forget(self) -> None:
        """Take the table out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table}")


def scratch_index(hashes: DataFrame, distance: int, scratch: Scratch, **options) -> KeyIndex:
    """An index that lives as long as the scratch folder."""
    return KeyIndex.build(hashes, distance, scratch.folder("index"), **options)
