"""Exact deduplication by Grace hashing.

Equal means: the same after every run of white space (space and U+0009 to
U+000D) has become one space.  Three steps:

1.  Every task puts a bounded chunk of its rows through an open-addressing
    table, so a group of copies leaves a task as one row per chunk, however
    large the group is.
2.  Spark deals these rows out by hash.  A task that gets more than
    ``memory`` bytes spills them to files by the next hash bits, again and
    again, until a bucket fits; the table compares complete contents, a hash
    never decides.
3.  The documents learn the outcome by the id of their chunk-local group.
    No such group is larger than a chunk, so no key of that join is hot.

Nulls: a null text is empty, and empty texts are copies of each other.  A null
id is larger than any other.  Of rows that are equal in text and id exactly
one is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import CHUNK_BYTES, chunks
from kindred.sources.scratch import Scratch

MEMORY_BYTES = 96 << 20
FANOUT_BITS = 4

_WHITE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalise(text: bytes | None) -> bytes:
    """UTF-8 text with every run of white space as one space."""
    text = (text or b"").translate(_WHITE)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class OpenTable:
    """Open addressing with linear probing; a hit needs equal contents."""

    def __init__(self, slots: int = 1024):
        self._slots = np.full(slots, -1, np.int64)
        self._hashes: list[int] = []
        self.contents: list[bytes] = []

    def find(self, content: bytes, hashed: int) -> int:
        """Number of ``content``, which is added if it is new."""
        mask = len(self._slots) - 1
        at = hashed & mask
        while (number := self._slots[at]) >= 0:
            if self._hashes[number] == hashed and self.contents[number] == content:
                return int(number)
            at = (at + 1) & mask
        number = self._slots[at] = len(self.contents)
        self._hashes.append(hashed)
        self.contents.append(content)
        if 2 * len(self.contents) > len(self._slots):
            self._grow()
        return int(number)

    def _grow(self) -> None:
        self._slots = np.full(4 * len(self._slots), -1, np.int64)
        mask = len(self._slots) - 1
        for number, hashed in enumerate(self._hashes):
            at = hashed & mask
            while self._slots[at] >= 0:
                at = (at + 1) & mask
            self._slots[at] = number


def _order(doc_id) -> tuple:
    return (doc_id is None, doc_id)


def _signed(hashed: int) -> int:
    return hashed - (1 << 64) if hashed >> 63 else hashed


def _local_groups(chunk_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base, made = ((context.partitionId() if context else 0) << 36), 0
        for held in chunks(batches, chunk_bytes):
            ids = held["id"].to_pylist()
            found = OpenTable()
            number, hashes = np.empty(len(ids), np.int64), []
            first: list[int] = []
            for i, text in enumerate(held["text"].cast(pa.binary()).to_pylist()):
                content = normalise(text)
                hashed = xxhash.xxh64_intdigest(content)
                k = number[i] = found.find(content, hashed)
                if k == len(first):
                    first.append(i)
                    hashes.append(_signed(hashed))
                elif _order(ids[i]) < _order(ids[first[k]]):
                    first[k] = i
            sizes = np.bincount(number, minlength=len(first)) if len(ids) else np.zeros(0, np.int64)
            is_first = np.zeros(len(ids), bool)
            is_first[first] = True
            own = np.array(hashes, np.int64)[number]
            rows = pa.array(np.where(is_first, np.arange(len(ids)), -1))
            rows = pc.if_else(pa.array(is_first), rows, pa.scalar(None, rows.type))
            out = pa.table({
                "gid": pa.array(base + made + number),
                "id": held["id"],
                "first": pa.array(is_first),
                "n": pa.array(sizes[number].astype(np.int64)),
                "h": pa.array(own),
                "row": held["row"].combine_chunks().take(rows),
            })
            made += len(first)
            yield from out.to_batches(max_chunksize=5000)

    return run


def _buckets(batches: Iterable[pa.RecordBatch], memory: int, level: int = 0) -> Iterator[Iterable[pa.RecordBatch]]:
    """Batches by bucket; buckets above ``memory`` are spilled by the next bits of ``h``.

    Once all bits are used up the rest differs in content only by collision
    or not at all, and passes as a stream.
    """
    if (level + 1) * FANOUT_BITS > 64:
        yield batches
        return
    held, size = [], 0
    source = iter(batches)
    for batch in source:
        held.append(batch)
        size += batch.nbytes
        if size > memory:
            break
    else:
        yield held
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files, writers = {}, {}
        try:
            for batch in (batch for part in (held, source) for batch in part):
                bits = (batch["h"].to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(FANOUT_BITS * level)) & np.uint64(
                    (1 << FANOUT_BITS) - 1
                )
                for b in np.unique(bits).tolist():
                    if b not in writers:
                        files[b] = f"{folder}/{b}"
                        writers[b] = pa.ipc.new_stream(files[b], batch.schema)
                    writers[b].write_batch(batch.filter(pa.array(bits == b)))
            held = []
        finally:
            for writer in writers.values():
                writer.close()
        for name in files.values():
            with pa.OSFile(name) as file:
                yield from _buckets(pa.ipc.open_stream(file), memory, level + 1)


_OUTCOME = T.StructType([
    T.StructField("gid", T.LongType()),
    T.StructField("keep_gid", T.LongType()),
    T.StructField("group_size", T.LongType()),
    T.StructField("text_sha256", T.StringType()),
])


def _resolve(memory: int, text: str, with_rows: bool):
    """Outcome of every chunk-local group, or the row of every group that stays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches, memory):
            found = OpenTable()
            gids, numbers, sizes, best = [], [], [], []
            for batch in bucket:
                ids, own = batch["id"].to_pylist(), batch["gid"].to_pylist()
                texts = batch["row"].field(text).cast(pa.binary()).to_pylist()
                for i, (hashed, n) in enumerate(zip(batch["h"].to_pylist(), batch["n"].to_pylist(), strict=True)):
                    k = found.find(normalise(texts[i]), hashed & ((1 << 64) - 1))
                    this = (_order(ids[i]), own[i], batch.slice(i, 1)["row"] if with_rows else None)
                    if k == len(sizes):
                        sizes.append(n)
                        best.append(this)
                    else:
                        sizes[k] += n
                        best[k] = min(best[k], this, key=lambda x: x[:2])
                    gids.append(own[i])
                    numbers.append(k)
            if with_rows and best:
                rows = pa.chunked_array([x[2] for x in best]).combine_chunks()
                yield from pa.Table.from_batches([pa.RecordBatch.from_arrays([rows], ["row"])]).to_batches(1000)
            elif gids:
                digests = [hashlib.sha256(x).hexdigest() for x in found.contents]
                yield pa.RecordBatch.from_pydict({
                    "gid": pa.array(gids, pa.int64()),
                    "keep_gid": pa.array([best[k][1] for k in numbers], pa.int64()),
                    "group_size": pa.array([sizes[k] for k in numbers], pa.int64()),
                    "text_sha256": pa.array([digests[k] for k in numbers], pa.string()),
                })

    return run


def _by_hash(docs: DataFrame, scratch: Scratch, doc_id: str, text: str, chunk_bytes: int) -> DataFrame:
    """``gid, id, first, n, h, row`` per document; ``row`` for the first of each chunk-local group."""
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.struct("*").alias("row"))
    schema = T.StructType([
        T.StructField("gid", T.LongType()),
        T.StructField("id", given.schema["id"].dataType),
        T.StructField("first", T.BooleanType()),
        T.StructField("n", T.LongType()),
        T.StructField("h", T.LongType()),
        T.StructField("row", given.schema["row"].dataType),
    ])
    return scratch.keep(given.mapInArrow(_local_groups(chunk_bytes), schema), "local-groups")


def exact_duplicates(
    docs: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    memory: int = MEMORY_BYTES,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per document."""
    local = _by_hash(docs.select(doc_id, text), scratch, doc_id, text, chunk_bytes)
    firsts = local.where("first").select("gid", "id", "n", "h", F.struct(F.col("row").getField(text).alias(text)).alias("row"))
    outcome = scratch.keep(firsts.repartition("h").mapInArrow(_resolve(memory, text, False), _OUTCOME), "outcome")
    keepers = local.where("first").select(F.col("gid").alias("keep_gid"), F.col("id").alias("keep_id"))
    known = outcome.join(keepers, "keep_gid")
    return local.select("gid", F.col("id").alias("doc_id"), "first").join(known, "gid").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("first") & (F.col("gid") == F.col("keep_gid"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(
    docs: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    memory: int = MEMORY_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    local = _by_hash(docs, scratch, doc_id, text, chunk_bytes)
    firsts = local.where("first").select("gid", "id", "n", "h", "row")
    schema = T.StructType([T.StructField("row", local.schema["row"].dataType)])
    return firsts.repartition("h").mapInArrow(_resolve(memory, text, True), schema).select("row.*")
