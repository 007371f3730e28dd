"""Quality classifier: histogram gradient-boosted trees over text statistics.

Statistics are taken over the whole text.  The trees are fitted on at most
about ``SAMPLE`` labelled documents, chosen by a hash of their id, and stored as
flat arrays (feature, split, value by heap position), so that scoring is a few
vectorised steps per tree level.

Nulls: a null text is empty and is scored like an empty one; a row without
label teaches nothing.  Without any labels every score is one half.  Repeated
rows get equal scores.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import crc_bucket, utf8

SAMPLE = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, L2, LEAST_LEAF = 60, 4, 32, 0.2, 1.0, 5.0

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256),
    "symbol": b"#*$%&|<>", "loud": b"!?", "stop": b".,;:", "bracket": b"()[]{}", "slash": b"/\\@_=+~^",
}
_MEMBER = np.stack([np.isin(np.arange(256), list(v)) for v in _CLASSES.values()], axis=1).astype(np.float64)
N_FEATURES = len(_CLASSES) + 11


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a text; ratios of an empty one are zero."""
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n_bytes = max(1, len(text))
    shares = (counts @ _MEMBER) / n_bytes
    black = max(1, n_bytes - int(counts[[9, 10, 11, 12, 13, 32]].sum()))
    often = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = counts[counts > 0] / n_bytes
    last = np.bincount([w[-1] for w in words], minlength=256) if n else np.zeros(256)
    top = often.most_common(1)[0][1] if n else 0
    d = max(1, n)
    return [
        *shares.tolist(), np.log1p(n), black / d, len(often) / d, top / d,
        float(last[list(b"!?#*$%&|<>")].sum()) / d, float(last[list(b".")].sum()) / d,
        1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), float(-(p * np.log(p)).sum()),
        sum(map(len, often)) / max(1, len(often)), float(last[[*range(65, 91)]].sum()) / d,
    ]


class Trees:
    """Boosted trees of one depth, as arrays by tree and heap position."""

    def __init__(self, features: np.ndarray, labels: np.ndarray):
        n, width = features.shape
        inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
        self.feature = np.zeros((TREES, inner), np.int32)
        self.split = np.full((TREES, inner), np.inf)
        self.value = np.zeros((TREES, leaves))
        good = (labels.sum() + 1) / (n + 2)
        self.base = float(np.log(good / (1 - good)))
        if not n or labels.min() == labels.max():
            return
        edges = [np.unique(np.quantile(features[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, features[:, f], "left") for f, e in enumerate(edges)], axis=1)
        score = np.full(n, self.base)
        for tree in range(TREES):
            p = 1 / (1 + np.exp(-score))
            gradient, hessian = p - labels, p * (1 - p)
            node = np.zeros(n, np.int64)  # number within its level
            for level in range(DEPTH):
                width_now = 1 << level
                gain, choice = np.full(width_now, 1e-9), np.full((width_now, 2), -1)
                for f in range(width):
                    cell = node * BINS + binned[:, f]
                    g = np.bincount(cell, gradient, width_now * BINS).reshape(width_now, BINS).cumsum(axis=1)
                    h = np.bincount(cell, hessian, width_now * BINS).reshape(width_now, BINS).cumsum(axis=1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    found = g**2 / (h + L2) + (total_g - g) ** 2 / (total_h - h + L2) - total_g**2 / (total_h + L2)
                    found[(h < 1e-3 * LEAST_LEAF) | (total_h - h < 1e-3 * LEAST_LEAF)] = 0
                    found = found[:, : len(edges[f])]
                    if not found.shape[1]:
                        continue
                    at = found.argmax(axis=1)
                    better = found[np.arange(width_now), at] > gain
                    gain[better] = found[np.arange(width_now), at][better]
                    choice[better] = np.stack((np.full(better.sum(), f), at[better]), axis=1)
                place = width_now - 1 + np.arange(width_now)
                for k in np.flatnonzero(choice[:, 0] >= 0):
                    self.feature[tree, place[k]] = choice[k, 0]
                    self.split[tree, place[k]] = edges[choice[k, 0]][choice[k, 1]]
                own = place[node]
                node = 2 * node + (features[np.arange(n), self.feature[tree, own]] > self.split[tree, own])
            g, h = np.bincount(node, gradient, leaves), np.bincount(node, hessian, leaves)
            self.value[tree] = -RATE * g / (h + L2)
            score += self.value[tree][node]

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        rows, total = np.arange(len(features)), np.full(len(features), self.base)
        for feature, split, value in zip(self.feature, self.split, self.value, strict=True):
            at = np.zeros(len(features), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (features[rows, feature[at]] > split[at])
            total += value[at - len(split)]
        return 1 / (1 + np.exp(-total))


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(x) for x in utf8(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["quality"], pa.array(found, pa.list_(pa.float64()))], ["quality", "found"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Trees:
    """Trees from labelled documents outside the held-out fold."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isNotNull() & F.col("_id").isNotNull() & (crc_bucket("_id", FOLDS) != HELD_OUT)
    )
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    held = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    # a sample of bounded size
    rows = held.join(F.broadcast(chosen), "_id").select("text", "quality")
    found = rows.mapInArrow(_measure, "quality int, found array<double>").collect()
    features = np.array([r["found"] for r in found]).reshape(-1, N_FEATURES)
    quality = np.array([r["quality"] for r in found], np.float64)
    order = np.lexsort((quality, *features.T))  # the same trees in whatever order rows came
    return Trees(features[order], quality[order])


def _score(model: Trees, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(x) for x in utf8(batch["text"])]).reshape(-1, N_FEATURES)
            score = model.scores(found)
            yield batch.drop_columns(["text"]).append_column("score", pa.array(score)).append_column(
                "predicted", pa.array((score >= threshold).astype(np.int32))
            )

    return run


def quality_scores(
    docs: DataFrame, model: Trees, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    given = docs.select(
        F.col(doc_id).alias("doc_id"), (crc_bucket(doc_id, FOLDS) == HELD_OUT).alias("held_out"), F.col(text).alias("text")
    )
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(_score(model, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")
