"""Joins and groups on made hashes: ``python bench_scale.py rows threshold [even|hot]``.

``even`` spreads the hashes; in ``hot`` one fingerprint has a third of all
images and another third shares 40 of its 64 bits.  A tenth has a near copy.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kindred.operators.clustering import cluster
from kindred.operators.similarity import distinct_hashes, similar_links
from kindred.plans.thresholds import max_distance
from kindred.sources.scratch import Scratch


def made_images(spark, rows: int, kind: str):
    value = F.xxhash64("id")
    if kind == "hot":
        third = F.col("id") % 3
        value = F.when(third == 0, F.lit(12345).cast("bigint")).when(
            third == 1, value.bitwiseAND(F.lit((1 << 24) - 1))
        ).otherwise(value)
    first = spark.range(0, rows, numPartitions=16).select(F.col("id").alias("image_id"), value.alias("phash"))
    flip = F.shiftleft(F.lit(1).cast("bigint"), 7).bitwiseXOR(F.shiftleft(F.lit(1).cast("bigint"), 30))
    copies = first.where("image_id % 10 = 7").select(
        (F.col("image_id") + rows).alias("image_id"), F.col("phash").bitwiseXOR(flip).alias("phash")
    )
    return first.unionByName(copies)


def main() -> None:
    rows, threshold = int(sys.argv[1]), int(sys.argv[2])
    kind = sys.argv[3] if len(sys.argv) > 3 else "even"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    scratch = Scratch(spark)
    images = scratch.keep(made_images(spark, rows, kind), "images")
    start = time.time()
    distinct = scratch.keep(distinct_hashes(images).select("id", "phash", F.lit(True).alias("fresh")), "distinct")
    print("distinct", distinct.count(), round(time.time() - start, 1), flush=True)
    start = time.time()
    links = similar_links(distinct, max_distance(threshold), scratch).count()
    print("links", links, round(time.time() - start, 1), flush=True)
    start = time.time()
    groups = cluster(images, threshold, scratch).groupBy("group_id").count().where("count > 1")
    print("groups", groups.count(), round(time.time() - start, 1), flush=True)


if __name__ == "__main__":
    main()
