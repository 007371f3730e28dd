"""Centroid clustering of integer vectors, filtered by a PCA rotation.

Vectors are rotated to their principal axes.  Stored with each one are its
``LEADING`` first rotated coordinates and the norm of the rest (the residual).
For a vector x and a centroid c, the squared distance of the stored coordinates
plus the squared difference of the residual norms is never above their squared
distance, so it is a lower bound that costs ``LEADING + 1`` products in place of
64.  The centroid of the least bound is measured in integers; the others only
where their bound is not above that (with a margin for rounding).  So floating
point decides what is measured, never a result.

The rotation comes from the moments of all vectors, one aggregate of 64 x 64
sums.  A round is one pass over the stored table: every task assigns its rows
and returns one integer sum per centroid and component, which Spark adds up as
decimals.  The driver holds the centroids, ``k`` x 64 numbers.

Vectors that have not exactly 64 components, or hold a null, NaN or infinite
one, are left out.  A null id is an id that comes last (its row is never a first
centroid before one with an id); rows of one id are told apart by their
components, and equal ones start as equal centroids, of which the larger number
stays empty.  With fewer than ``k`` vectors there are so many centroids.
Components beyond +-2**27 (131,072 before scaling) stand as that bound, since
their squared distances would not fit a long.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.scratch import Scratch

DIMENSIONS = 64
SCALE = 1024
CLUSTERS, ROUNDS, SEED = 8, 10, 3
LEADING = 8
BOUND = 1 << 27
# Relative to the squared norms of vector and centroid; rounding errors are about 1e-13.
MARGIN = 1e-9
# Vectors compared at once.
ROWS_AT_ONCE = 16_384


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), kind))


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the usable vectors: 64 scaled and floored components."""
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["e"]
            fits = np.asarray(column.value_lengths().fill_null(-1)) == DIMENSIONS
            batch = batch.filter(pa.array(fits))
            e = _matrix(batch["e"], DIMENSIONS)  # nulls are NaN
            good = np.isfinite(e).all(axis=1)
            x = np.clip(np.floor(e[good] * SCALE), -BOUND, BOUND).astype(np.int32)
            ids = batch["vec_id"].filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, _lists(x, pa.int32())], ["vec_id", "x"])

    return given.mapInArrow(run, "vec_id long, x array<int>")


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose hashed id is smallest, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = kept.orderBy(F.col("vec_id").isNull(), key, "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in chosen], np.int64).reshape(-1, DIMENSIONS)


def principal_axes(kept: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation (axes as columns, largest variance first) of all vectors.

    Any rotation gives right results; this one makes the bounds tight.
    """
    i, j = np.triu_indices(DIMENSIONS)
    row, column = np.concatenate((np.full(DIMENSIONS + 1, -1), i)), np.concatenate((np.arange(DIMENSIONS + 1), j))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(DIMENSIONS), np.zeros((DIMENSIONS, DIMENSIONS))
        for batch in batches:
            x = _matrix(batch["x"], DIMENSIONS).astype(np.float64)
            n += len(x)
            total += x.sum(axis=0)
            products += x.T @ x
        if n:
            values = np.concatenate((total, [n], products[i, j]))
            yield pa.RecordBatch.from_pydict({"i": pa.array(row, pa.int32()), "j": pa.array(column, pa.int32()), "v": values})

    sums = kept.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = {(r["i"], r["j"]): r["v"] for r in sums.collect()}
    if not found:
        return np.zeros(DIMENSIONS), np.eye(DIMENSIONS)
    n = found[-1, DIMENSIONS]
    mean = np.array([found[-1, k] for k in range(DIMENSIONS)]) / n
    moments = np.zeros((DIMENSIONS, DIMENSIONS))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        moments[a, b] = moments[b, a] = found[a, b] / n
    _, axes = np.linalg.eigh(moments - np.outer(mean, mean))
    return mean, np.ascontiguousarray(axes[:, ::-1])


def rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> np.ndarray:
    """Leading rotated coordinates, residual norm, and squared norm."""
    y = (x - mean) @ axes
    rest = (y[:, leading:] ** 2).sum(axis=1)
    return np.column_stack((y[:, :leading], np.sqrt(rest), (y[:, :leading] ** 2).sum(axis=1) + rest))


def nearest(x: np.ndarray, sketch: np.ndarray, centroids: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number of ties), squared distance, and distances measured.

    ``sketch`` and ``centre`` are :func:`rotated` vectors and centroids.
    """
    a, b = sketch[:, :-1], centre[:, :-1]
    bound = np.empty((len(x), len(b)))
    for c in range(len(b)):
        bound[:, c] = ((a - b[c]) ** 2).sum(axis=1)
    margin = MARGIN * (sketch[:, -1][:, None] + centre[:, -1][None, :]) + 1e-6

    def measured(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        gap = x[rows].astype(np.int64) - centroids[c]
        return np.einsum("ij,ij->i", gap, gap)

    every = np.arange(len(x))
    guess = bound.argmin(axis=1)
    best, distance = guess.copy(), measured(every, guess)
    open_ = bound - margin <= distance[:, None]
    open_[every, guess] = False
    seen = len(x)
    for c in range(len(b)):
        rows = np.flatnonzero(open_[:, c])
        if len(rows):
            seen += len(rows)
            d = measured(rows, np.full(len(rows), c))
            wins = (d < distance[rows]) | (d == distance[rows]) & (c < best[rows])
            best[rows[wins]], distance[rows[wins]] = c, d[wins]
    return best, distance, seen


def _sketched(mean: np.ndarray, axes: np.ndarray, leading: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = rotated(_matrix(batch["x"], DIMENSIONS), mean, axes, leading)
            yield batch.append_column("sketch", _lists(sketch, pa.float64()))

    return run


def _each(batches: Iterable[pa.RecordBatch], centroids: np.ndarray, centre: np.ndarray):
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            x = _matrix(batch["x"], DIMENSIONS)
            best, distance, _ = nearest(x, _matrix(batch["sketch"], centre.shape[1]), centroids, centre)
            yield batch, x, best, distance


def _sums(centroids: np.ndarray, centre: np.ndarray):
    """Per task: ``cluster, component, total, n``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        total, n = np.zeros((k, DIMENSIONS), np.int64), np.zeros(k, np.int64)
        for _, x, best, _ in _each(batches, centroids, centre):
            for c in range(k):
                own = x[best == c]
                n[c] += len(own)
                total[c] += own.sum(axis=0, dtype=np.int64)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(np.repeat(used, DIMENSIONS), pa.int32()),
                "component": pa.array(np.tile(np.arange(DIMENSIONS), len(used)), pa.int32()),
                "total": pa.array(total[used].reshape(-1)), "n": pa.array(np.repeat(n[used], DIMENSIONS)),
            })

    return run


def _assigned(centroids: np.ndarray, centre: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, distance in _each(batches, centroids, centre):
            columns = [batch["vec_id"], pa.array(best, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return run


def centroid_clusters(
    vectors: DataFrame,
    scratch: Scratch,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    leading: int = LEADING,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every usable vector (a stored table), and the centroids."""
    kept = scratch.keep(integer_vectors(vectors, vec_id, embedding), "vectors")
    mean, axes = principal_axes(kept)
    centroids = first_centroids(kept, k, seed)
    stored = scratch.keep(
        kept.mapInArrow(_sketched(mean, axes, leading), "vec_id long, x array<int>, sketch array<double>"), "sketched"
    )
    scratch.drop(kept)
    for _ in range(rounds):
        centre = rotated(centroids, mean, axes, leading)
        sums = stored.select("x", "sketch").mapInArrow(
            _sums(centroids, centre), "cluster int, component int, total long, n long"
        )
        moved = centroids.copy()
        for r in sums.groupBy("cluster", "component").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n")
        ).collect():
            moved[r["cluster"], r["component"]] = int(r["total"]) // int(r["n"])
        if (moved == centroids).all():
            break  # every further round would repeat this one
        centroids = moved
    centre = rotated(centroids, mean, axes, leading)
    found = stored.mapInArrow(_assigned(centroids, centre), "vec_id long, cluster int, distance long")
    return scratch.keep(found, "clusters"), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with the inertia of each row's cluster and of all, and its centroid's digest.

    The sums are one row per cluster, so they come back by broadcast.
    """
    spark = found.sparkSession
    digests = spark.createDataFrame(
        [(c, centroid_digest(x)) for c, x in enumerate(centroids)], "cluster int, centroid_sha256 string"
    )
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    total = sum(int(r["own"]) for r in sums)
    inertia = spark.createDataFrame(
        [(r["cluster"], int(r["own"]), total) for r in sums], "cluster int, cluster_inertia long, inertia long"
    )
    return found.join(F.broadcast(inertia.join(digests, "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
