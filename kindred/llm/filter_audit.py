"""How filters interact, in every order, by wide packed counters.

A document is reduced to the set (mask) of filters that it fails.  What happens
to it at each of the 600 steps (120 orders of five filters, five steps each)
depends on its mask alone, so every mask has an integer whose 600 fields say it
for all steps at once.  A part's outcome is the sum of the integers of its
documents, with one field per step; the sum is unpacked at the end.  Fields are
as wide as a count can be (``FIELD_BITS``), so none flows over into the next.

Documents are counted by part and mask before their integers are added: the
integer of a mask times its count is the sum over its documents.  A part has at
most 32 masks, so no part is a large group, however many documents it holds.

Filter E compares texts by SHA-256 and ids across the whole table.  The
smallest id of each text comes from a partial aggregate, and meets the documents
by text and id, not by text, so a text that a third of all documents share is
not one group.

Nulls: a null text is empty, a null source is the part ``""``, a null id counts
as the largest.  Rows of one id: no id is smaller than itself, so equal texts
under one id do not fail E.  Labels of one id are joined by "any": quality if a
row says 1, toxic if a row says 1; without a label both are no.  Labels without
id belong to nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import utf8
from kindred.operators.skew import join_unique
from kindred.sources.scratch import Scratch

FILTERS = "ABCDE"
# Limits of the filters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 50, 65, 5
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
CONTINUING = bytes(range(0x80, 0xC0))
# Counts are longs, so a field of 64 bits never carries.
FIELD_BITS = 64
# The largest id; a null one counts as this.
LAST_ID = (1 << 63) - 1

ORDERS = ["".join(x) for x in permutations(FILTERS)]


def failed_filters(text: bytes) -> int:
    """Mask of the filters A to D that a text fails; bit 0 is A."""
    words = text.split()
    n = len(words)
    return (
        (n < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * n) << 1
        | (100 * (len(text) - len(text.translate(None, CAPITALS)))
           > MAX_CAPITAL_PERCENT * len(text.translate(None, CONTINUING))) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def _flags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch["text"])
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], batch["part"], pa.array(map(failed_filters, texts), pa.int32()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            ],
            ["doc_id", "part", "mask", "digest"],
        )


# --- packed counters -----------------------------------------------------------


def field(order: int, step: int) -> int:
    """First bit of the field of a step (from 0) of an order."""
    return (order * len(FILTERS) + step) * FIELD_BITS


def packed_outcomes() -> dict[str, list[int]]:
    """By outcome, one integer per mask: which fields a document of the mask adds one to."""
    masks = range(1 << len(FILTERS))
    out = {name: [0] * len(masks) for name in ("kept", "removed", "redundant", "unique_fails")}
    for number, order in enumerate(ORDERS):
        for mask in masks:
            gone = False
            for step, letter in enumerate(order):
                one = 1 << field(number, step)
                own = 1 << FILTERS.index(letter)
                if mask & own:
                    out["redundant" if gone else "removed"][mask] += one
                    gone = True
                if not gone:
                    out["kept"][mask] += one
                if mask == own:
                    out["unique_fails"][mask] += one
    return out


def unpacked(total: int) -> list[int]:
    """The counts of all fields, steps of the first order first."""
    raw = total.to_bytes(len(ORDERS) * len(FILTERS) * FIELD_BITS // 8, "little")
    width = FIELD_BITS // 8
    return [int.from_bytes(raw[a : a + width], "little") for a in range(0, len(raw), width)]


_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
_RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*_COUNTS, "shapley"])


def _audit(packed: dict[str, list[int]]):
    """All steps of a part from its counts by mask."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sums = dict.fromkeys(_COUNTS, 0)
        for row in rows.itertuples(index=False):
            mask = int(row.mask)
            for name, integers in packed.items():
                sums[name] += int(row.n) * integers[mask]
            sums["good_lost"] += int(row.n_good) * packed["removed"][mask]
            sums["toxic_lost"] += int(row.n_toxic) * packed["removed"][mask]
        counts = {name: unpacked(total) for name, total in sums.items()}
        letters = [letter for order in ORDERS for letter in order]
        shapley = dict.fromkeys(FILTERS, 0)
        for letter, n in zip(letters, counts["removed"], strict=True):
            shapley[letter] += n
        return pd.DataFrame({
            "part": rows["part"].iloc[0],
            "filter_order": [order for order in ORDERS for _ in order],
            "step": [step for _ in ORDERS for step in range(1, len(FILTERS) + 1)],
            **counts,
            "shapley": [shapley[letter] for letter in letters],
        })

    return run


def failures(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by part, failed filters and labels."""
    given = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
    )
    # Texts are read once; what is shuffled is a few dozen bytes a document.
    flags = scratch.keep(given.mapInArrow(_flags, "doc_id long, part string, mask int, digest binary"), "flags")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    no = F.lit(False)
    counted = flags.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    labelled = join_unique(counted.where("doc_id is not null"), known, "doc_id", "left", scratch).select(
        *counted.columns, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )
    nameless = counted.where("doc_id is null").select(*counted.columns, no.alias("good"), no.alias("toxic"))
    rows = labelled.unionByName(nameless).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)))
    first = flags.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("doc_id"))
    judged = rows.join(first.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left")
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return judged.groupBy("part", F.col("mask").bitwiseOR(copy).alias("mask"), "good", "toxic").agg(F.sum("n").alias("n"))


def audit_filters(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of that step."""
    found = failures(docs, labels, scratch, doc_id, text, source)
    by_mask = found.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"),
    )
    return by_mask.groupBy("part").applyInPandas(_audit(packed_outcomes()), _RESULT)
