"""A training corpus from ``documents``: filtered, deduplicated and packed.

Every stage is ``(name, function)``; the function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame, which is written as Parquet and read again
as the ``docs`` of the next one.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.exact_dedup import drop_exact_duplicates
from kindred.llm.packing import best_fit_packing
from kindred.llm.quality_rules import good_documents
from kindred.llm.queries import tokenizer_path
from kindred.llm.simhash_links import drop_near_duplicates
from kindred.llm.substring_dedup import drop_repeated_substrings
from kindred.sources.scratch import Scratch


_before: list[Scratch] = []


def _scratch(spark: SparkSession, first: bool = False) -> Scratch:
    """Working tables of one stage.

    Those of the stage before go: its result has been written when the next
    stage is called, so the disk holds the tables of one stage only.  The first
    stage deletes nothing, as the result of an earlier run may still be read.
    """
    while _before:
        old = _before.pop()
        if not first and old.spark.sparkContext is spark.sparkContext:
            old.clear()
    _before.append(Scratch(spark))
    return _before[-1]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules call good."""
    return good_documents(docs, _scratch(spark, first=True))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs, _scratch(spark))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs, _scratch(spark))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that repeat."""
    kept = drop_repeated_substrings(docs, _scratch(spark))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences."""
    return best_fit_packing(docs, _scratch(spark), tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

# Expectation maximisation, fingerprints and tokenizers are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
