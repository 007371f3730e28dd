"""Near duplicates by SimHash over a byte-position inverted index.

A fingerprint of 64 bits has a bit set if more than half of the document's
shingle hashes have it.  Two fingerprints that differ in at most ``distance``
(4) bits agree in at least four of their eight bytes.  The index lists every
fingerprint under triples of its positional bytes, chosen (by Turan's
construction) so that any four of the eight positions contain one of them: 20
lists of 24 bits each.  A pair that meets in a list is tallied by the bytes it
shares, kept from four on, and verified by its differing bits.

Copies of a fingerprint are one entry.  Lists longer than ``list_limit`` are
dealt anew by one more byte (a pair sharing four bytes shares another one), and
if still too long by pairs of blocks, so no task holds more than two blocks of
a list.  A list that is compared at once yields a spanning forest of its links,
not all of them: components stay the same and a dense list costs no more rows
than it has members.

The nodes of the components are the fingerprints themselves, so rows without an
id link like any others; a component is named after its smallest known id.

Nulls: a null text has no words and fingerprint zero, which links like any
other.  A row with a null id gets the name of its component, null if no row of
it has an id.  Repeated rows fall together.  Where one row per component stays,
it is the one with the smallest id (null last), then fingerprint, then hash of
the text; of rows equal in all of these any one.  Other rows of the same id are
judged by themselves.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import utf8
from kindred.operators.components import connected_components
from kindred.operators.skew import HOT_ROWS, join_unique
from kindred.sources.scratch import Scratch

SHINGLE = 4
SEED = 42
DISTANCE = 4
LIST_LIMIT = 8192
# Shingle hashes whose bits are counted at once.
_BLOCK = 1 << 15

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes) -> int:
    """Unsigned SimHash of one text; ``SHINGLE`` words to a shingle, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-SHINGLE]))
        spans = zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the text, and ``fp``."""
    for batch in batches:
        found = np.array([fingerprint(x) for x in utf8(batch["text"])], np.uint64)
        yield batch.drop_columns(["text"]).append_column("fp", pa.array(found.view(np.int64)))


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of 0..7 of which any four positions contain one."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]

    def wanted(triple: tuple[int, ...]) -> bool:
        counts = [sum(part[x] == k for x in triple) for k in range(3)]
        return 3 in counts or any(counts[k] == 2 and counts[(k + 1) % 3] == 1 for k in range(3))

    return [x for x in combinations(range(8), 3) if wanted(x)]


def _byte(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _postings(prints: DataFrame) -> DataFrame:
    """``key, fp, node`` for each fingerprint and triple."""
    keys = []
    for number, (a, b, c) in enumerate(covering_triples()):
        key = F.lit(number << 24).cast("long")
        for place, position in enumerate((a, b, c)):
            key = key + F.shiftleft(_byte(position), 8 * place)
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp", "node")


def _dealt_anew(postings: DataFrame) -> DataFrame:
    """Long lists by triple and one more positional byte."""
    triples = F.array(*[F.array(*map(F.lit, [k for k in range(8) if k not in t])) for t in covering_triples()])
    rest = F.get(triples, F.shiftright("key", 24).cast("int"))
    byte = F.expr("shiftrightunsigned(fp, 8 * position) & 255")
    return postings.withColumn("position", F.explode(rest)).select(
        (F.col("key") * 2048 + F.col("position") * 256 + byte + F.lit(1 << 40)).alias("key"), "fp", "node"
    )


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _links_of_list(fps: np.ndarray, nodes: np.ndarray, side: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside one list.

    ``side`` is 0 for all members of a whole list; in a pair of two different
    blocks it tells them apart, and only links across are looked for.
    """
    n = len(fps)
    parent = np.arange(n)
    links = []
    cross = bool(side.any()) and not side.all()
    least = 8 - distance
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        if cross:
            others = others[side[i + 1 :] != side[i]]
        if not len(others):
            continue
        differ = fps[others] ^ fps[i]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = others[shared >= least]
        for j in near[np.bitwise_count(fps[near] ^ fps[i]) <= distance].tolist():
            a, b = _find(parent, i), _find(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def _links(distance: int):
    """Links of lists that arrive whole and sorted by their key columns."""

    def solve(key, fps, nodes, side) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(key)]))
        found = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a > 1:
                found += _links_of_list(fps[a:b], nodes[a:b], side[a:b], distance)
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [
                batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64),
                batch["node"].to_numpy(), batch["side"].to_numpy(),
            ]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now, strict=True)]
            last = np.searchsorted(now[0], now[0][-1])
            left = [x[last:] for x in now]
            yield from solve(*[x[:last] for x in now])
        if left is not None:
            yield from solve(*left)

    return run


def _search(postings: DataFrame, distance: int) -> DataFrame:
    """Links of ``key, fp, node, side``; each list goes to one task."""
    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(_links(distance), "a long, b long")


def similar_prints(
    prints: DataFrame, scratch: Scratch, distance: int = DISTANCE, list_limit: int = LIST_LIMIT
) -> DataFrame:
    """``a, b``: links that connect all of ``node, fp`` within ``distance``.

    ``fp`` is distinct.  Long lists are found by one count over the index.
    """
    whole = F.lit(0).cast("byte").alias("side")
    postings = _postings(prints)

    def long_lists(of: DataFrame) -> DataFrame:
        counts = of.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > list_limit)
        return scratch.keep(counts, "long-lists")

    long = long_lists(postings)
    if long.isEmpty():
        return _search(postings.select("key", "fp", "node", whole), distance)
    found = _search(postings.join(long, "key", "left_anti").select("key", "fp", "node", whole), distance)
    finer = scratch.keep(_dealt_anew(postings.join(long, "key", "left_semi").select("key", "fp", "node")), "finer")
    still = long_lists(finer)
    found = found.unionByName(
        _search(finer.join(still, "key", "left_anti").select("key", "fp", "node", whole), distance)
    )
    if still.isEmpty():
        return found
    blocks = (
        finer.join(still, "key")
        .withColumn("of", F.ceil(F.col("members") / list_limit).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("fp"), "of").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    tiles = blocks.select(
        F.xxhash64("key", "low", "high").alias("key"), "fp", "node",
        F.when(F.col("low") == F.col("high"), 0).when(F.col("block") == F.col("low"), 1).otherwise(0).cast("byte").alias("side"),
    )
    return found.unionByName(_search(tiles, distance))


def _components(hashed: DataFrame, scratch: Scratch, distance: int, list_limit: int) -> DataFrame:
    """``fp, root`` of all fingerprints; the root is one of the component's fingerprints."""
    prints = scratch.keep(hashed.select("fp", F.col("fp").alias("node")).distinct(), "prints")
    links = scratch.keep(similar_prints(prints, scratch, distance, list_limit), "links")
    roots = connected_components(links, scratch)
    found = prints.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    return scratch.keep(found, "components")


def near_duplicates(
    docs: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    distance: int = DISTANCE,
    list_limit: int = LIST_LIMIT,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``doc_id, fp`` (signed) and ``component_id``, one row per document."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = scratch.keep(given.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    components = _components(hashed, scratch, distance, list_limit)
    least = scratch.keep(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    names = least.join(components, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    labels = join_unique(components, scratch.keep(names, "names"), "root", "left", scratch, hot_rows)
    labels = scratch.keep(labels.select("fp", "component_id"), "labels")
    return join_unique(hashed, labels, "fp", "left", scratch, hot_rows).select("doc_id", "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    distance: int = DISTANCE,
    list_limit: int = LIST_LIMIT,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row of ``docs`` per component, with all its columns."""
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row_no"), F.struct("*").alias("row")), "rows")
    given = rows.select(
        "row_no", F.col(f"row.`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"row.`{text}`")).alias("th"),
        F.col(f"row.`{text}`").alias("text"),
    )
    hashed = scratch.keep(given.mapInArrow(_fingerprints, "row_no long, doc_id long, th long, fp long"), "fingerprints")
    components = _components(hashed, scratch, distance, list_limit)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "th", "row_no")
    # Least of each fingerprint first, so what meets the components is one row per fingerprint.
    least = hashed.groupBy("fp").agg(F.min(order).alias("least"))
    keepers = least.join(components, "fp").groupBy("root").agg(F.min("least").alias("least"))
    kept = keepers.select(F.col("least.row_no").alias("row_no"))
    return rows.join(kept, "row_no", "left_semi").select("row.*")
