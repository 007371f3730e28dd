"""Working tables of one job in the shared folder of the cluster.

Intermediate results that are used more than once, or that must not be
recomputed (iterations, decoded images), are written as Parquet and read
back.  That cuts lineage, survives lost executors and gives the optimizer
true sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session may go without: it gets a new temporary folder.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")


class Scratch:
    """A folder of Parquet tables that is removed when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/kindred-{uuid.uuid4().hex}"
        self._count = 0
        self._path(self.root).getFileSystem(self._conf()).deleteOnExit(self._path(self.root))

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def folder(self, name: str) -> str:
        """A new path below this scratch folder."""
        self._count += 1
        return f"{self.root}/{self._count:04d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it as a table read from storage."""
        path = self.folder(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._kindred_path = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Delete a table made by :meth:`keep` that no plan reads any more."""
        path = self._path(kept._kindred_path)
        path.getFileSystem(self._conf()).delete(path, True)

    def clear(self) -> None:
        """Delete the whole folder; no plan may read from it any more."""
        path = self._path(self.root)
        path.getFileSystem(self._conf()).delete(path, True)
