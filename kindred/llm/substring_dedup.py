"""Substring dedup: compressed FM-indexes over shards of candidate passages.

A window is ``window`` (35) consecutive words of one document; every word
inside a window that starts anywhere else too is removed.

0.  Every row gets a number in a written table; spans find their row by it.
1.  Anchors.  Each window is filed under the smallest hash of its 8-word
    shingles, so equal windows are filed under equal anchors.  An anchor with
    the words of all windows filed under it is a region.  About one word in
    fourteen is an anchor; only its hashes travel.  Equal regions of one chunk
    of a task leave it as one row.
2.  Sorted by anchor, neighbours show which regions occur twice (all of it
    goes), share their anchor with a different region (candidates), or stand
    alone.  The sort is by range of anchor and region, so a hot anchor is split;
    what touches the edge of a partition is taken as a candidate.  The row number
    is the last sort key, so a region that very many documents share is split too.
3.  Documents meet their regions.  Those without candidates are finished.
4.  Candidate regions are sharded by anchor.  A shard of bounded size becomes
    an FM-index; its passages are streamed through it by backward search, and
    windows with two or more occurrences are reported.  Regions of an anchor
    with very many different regions (hot) are cut first.  Sorted by the words
    after the anchor, and by those before it, neighbours show how many of them a
    region shares with any other; windows that reach further occur once.  Of
    what is left, equal parts occur twice as a whole; different ones are taken
    apart into single windows, which are counted by their words (partial counts
    first).  What occurs twice or more meets its rows by a join that keeps hot
    parts and windows where they are.
5.  Unfinished documents meet the reported windows.

Hashes only choose what is compared together; step 2 takes regions as equal by
two 64-bit hashes and their length.

Nulls: a null text has no words.  Rows are told apart by their number, not by
id, so null and repeated ids mean nothing here, and rows equal in id and text
repeat each other like any other two.  Texts shorter than a window never change.
An empty table gives an empty result.

Memory: a task holds the hashes of ``CHUNK_BYTES`` of text at once, and of a
longer text ``STRETCH_WORDS`` words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.common import utf8
from kindred.llm.fm_index import FMIndex, repeated_windows
from kindred.operators.skew import HOT_ROWS, join_unique
from kindred.sources.scratch import Scratch

WINDOW = 35
ANCHOR = 8
CHUNK_BYTES = 3 << 20
STRETCH_WORDS = 400_000
SHARD_TOKENS = 400_000
HOT_REGIONS = 1000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_LAST = np.uint64((1 << 64) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _running(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` consecutive values."""
    done = 1
    while 2 * done <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n + 1, _BASE), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _content(hashes: np.ndarray):
    """Function that gives the hashes of the parts ``a`` to ``b`` of a run of word hashes."""
    up, down = _powers(len(hashes))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])))
    return lambda a, b: (prefix[b] - prefix[a]) * down[a]


def _shingles(content, n: int) -> np.ndarray:
    """Hashes of all shingles of a run of ``n`` words."""
    return _mixed(content(np.arange(n - ANCHOR + 1), np.arange(ANCHOR, n + 1)))


def regions_of(sizes: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Regions of documents given as one run of word hashes.

    Returns anchor hash, region hash, first window start (in the run) and the
    number of windows, for each region.
    """
    n, starts_per_window = len(hashes), window - ANCHOR + 1
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < window:
        return nothing
    content = _content(hashes)
    grams = _shingles(content, n)
    least = _running(grams, starts_per_window, np.minimum)  # per window start
    ends = np.cumsum(sizes)
    left_in_doc = np.repeat(ends, sizes) - np.arange(n)
    inside = left_in_doc[: n - window + 1] >= window
    # A window is filed under the leftmost of its smallest shingles, and once
    # only.  The windows filed under one shingle are a run of starts.
    s = np.flatnonzero(inside)
    if not len(s):
        return nothing
    p, open_ = np.empty(len(s), np.int64), np.arange(len(s))
    for shift in range(starts_per_window):
        own = grams[s[open_] + shift] == least[s[open_]]
        p[open_[own]] = s[open_[own]] + shift
        open_ = open_[~own]
    head = np.concatenate(([True], p[1:] != p[:-1]))
    at = np.flatnonzero(head)
    last = np.concatenate((at[1:], [len(p)])) - 1
    a, m = s[at], s[last] - s[at] + 1
    region = _mixed(content(a, a + m + window - 1) + (m + (p[at] - a) * 64).astype(np.uint64))
    return grams[p[at]], region, a, m


_REGIONS = "anchor long, region long, row_no long, a int, m short, n int"


def _bounded(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Row numbers and texts, about ``most`` bytes at once; a longer text alone."""
    numbers, texts, size = [], [], 0
    for batch in batches:
        for number, text in zip(batch["row_no"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
            body = text.as_py() or b""
            if texts and size + len(body) > most:
                yield numbers, texts
                numbers, texts, size = [], [], 0
            numbers.append(number)
            texts.append(body)
            size += len(body)
    if texts:
        yield numbers, texts


def _stretches(words: list[bytes], window: int) -> Iterator[tuple[int, list[bytes]]]:
    """Parts of a text with their first word; every window lies in exactly one part."""
    step = max(STRETCH_WORDS, window)
    for at in range(0, len(words) - window + 1, step):
        yield at, words[at : at + step + window - 1]


def _find_regions(window: int):
    """Region rows; of equal regions in one chunk only one has ``n`` > 0, the number of them."""

    def found(numbers: list[int], firsts: list[int], sizes: list[int], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchor, region, a, m = regions_of(np.array(sizes), np.concatenate(hashes), window)
        ends = np.cumsum(sizes)
        part = np.searchsorted(ends, a, "right")
        order = np.lexsort((region, anchor))
        same = (anchor[order][1:] == anchor[order][:-1]) & (region[order][1:] == region[order][:-1])
        heads = np.flatnonzero(np.concatenate(([True], ~same)))
        count = np.zeros(len(anchor), np.int32)
        count[order[heads]] = np.diff(np.concatenate((heads, [len(anchor)])))
        at = a - (ends - sizes)[part] + np.array(firsts)[part]
        yield from pa.table({
            "anchor": anchor.view(np.int64), "region": region.view(np.int64), "row_no": np.array(numbers, np.int64)[part],
            "a": at.astype(np.int32), "m": m.astype(np.int16), "n": count,
        }).to_batches(max_chunksize=100_000)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for rows, texts in _bounded(batches, CHUNK_BYTES):
            numbers, firsts, sizes, hashes, held = [], [], [], [], 0
            for number, text in zip(rows, texts, strict=True):
                for first, words in _stretches(text.split(), window):
                    numbers.append(number)
                    firsts.append(first)
                    sizes.append(len(words))
                    hashes.append(np.fromiter(map(digest, words), np.uint64, len(words)))
                    held += len(words)
                    if held > STRETCH_WORDS:
                        yield from found(numbers, firsts, sizes, hashes)
                        numbers, firsts, sizes, hashes, held = [], [], [], [], 0
            if sizes:
                yield from found(numbers, firsts, sizes, hashes)

    return run


def _beside_neighbours(batches: Iterable[pa.RecordBatch], names: list[str], judged) -> Iterator[pa.RecordBatch]:
    """``judged`` of consecutive rows, with a row of context at each end that has one."""
    held, before = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch]).select(names)
        if held is not None:
            now = pa.concat_tables([held, now])
        if now.num_rows < 3:
            held = now
            continue
        yield from judged(now, before, True)
        held, before = now.slice(now.num_rows - 2), True
    if held is not None:
        yield from judged(held, before, False)


_STATUS = "anchor long, row_no long, a int, m short, whole boolean"


def _compare_neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and region: repeats (``whole``) and candidates.

    A repeated region next to a different one of its anchor is a candidate too,
    once or twice, so that the others can be found in it.
    """
    def judged(held: pa.Table, has_before: bool, has_after: bool) -> Iterator[pa.RecordBatch]:
        """All rows but the context row at either end."""
        anchor, region = held["anchor"].to_numpy(), held["region"].to_numpy()
        same_anchor = anchor[1:] == anchor[:-1]
        same_region = same_anchor & (region[1:] == region[:-1])
        no = np.zeros(1, bool)
        whole = np.concatenate((no, same_region)) | np.concatenate((same_region, no)) | (held["n"].to_numpy() > 1)
        # a different region of the same anchor is next to it, or may be in the next partition
        other = same_anchor & ~same_region
        met = np.concatenate((no, other)) | np.concatenate((other, no))
        met[0] |= not has_before
        met[-1] |= not has_after
        a, b = int(has_before), len(anchor) - int(has_after)
        out = held.select(["anchor", "row_no", "a", "m"]).slice(a, b - a)
        for rows, flag in ((whole[a:b], True), (met[a:b], False)):
            part = out.filter(pa.array(rows)).combine_chunks()
            yield from part.append_column("whole", pa.array(np.full(part.num_rows, flag))).to_batches()

    return _beside_neighbours(batches, ["anchor", "region", "n", "row_no", "a", "m"], judged)


def _covered(n: int, spans: Iterable[tuple[int, int]]) -> np.ndarray:
    """Flags of words inside any ``(first word, number of words)``."""
    change = np.zeros(n + 1, np.int32)
    for a, size in spans:
        change[a] += 1
        change[min(n, a + size)] -= 1
    return np.cumsum(change[:-1]) > 0


def _finish(words: list[bytes], gone: np.ndarray | None) -> tuple[int, int, bytes]:
    kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), len(words) - len(kept), b" ".join(kept)


def _with_text(row: pa.StructArray, text: str, values: list) -> pa.StructArray:
    """``row`` with another text column, which may hold nulls."""
    kinds = [f.with_nullable(True) if f.name == text else f for f in row.type]
    columns = [pa.array(values, f.type) if f.name == text else row.field(k) for k, f in enumerate(kinds)]
    return pa.StructArray.from_arrays(columns, fields=kinds)


def _meet_regions(window: int, text: str, with_text: bool):
    """Finished documents, or pending ones with the words of their candidate regions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: dict[str, list] = {k: [] for k in ("pending", "n_words", "n_removed", "digest", "whole", "regions")}
            texts: list = []
            for body, spans in zip(utf8(batch["row"].field(text)), batch["spans"].to_pylist(), strict=True):
                words = body.split()
                whole = [(s["a"], s["m"] + window - 1) for s in spans or () if s["whole"]]
                open_ = [s for s in spans or () if not s["whole"]]
                n, removed, kept = 0, 0, b""
                regions = None
                if open_:
                    regions = [
                        {"anchor": s["anchor"], "a": s["a"], "words": b" ".join(words[s["a"] : s["a"] + s["m"] + window - 1]).decode()}
                        for s in open_
                    ]
                    texts.append(body.decode())
                else:
                    n, removed, kept = _finish(words, _covered(len(words), whole) if whole else None)
                    texts.append((kept if removed else body).decode() if with_text else None)
                values = (bool(open_), n, removed, hashlib.sha256(kept).hexdigest(), whole if open_ else None, regions)
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            span = pa.struct([("a", pa.int32()), ("size", pa.int32())])
            region = pa.struct([("anchor", pa.int64()), ("a", pa.int32()), ("words", pa.string())])
            whole = [None if x is None else [{"a": a, "size": size} for a, size in x] for x in out["whole"]]
            yield pa.RecordBatch.from_pydict({
                "row_no": batch["row_no"], "row": _with_text(batch["row"], text, texts),
                "pending": pa.array(out["pending"], pa.bool_()), "n_words": pa.array(out["n_words"], pa.int64()),
                "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["digest"], pa.string()),
                "whole": pa.array(whole, pa.list_(span)), "regions": pa.array(out["regions"], pa.list_(region)),
            })

    return run


_SPANS = "row_no long, a int, size int"


def _search_shards(window: int, shard_tokens: int):
    """Spans of repeated windows in rows ``key, row_no, a, words`` sorted by key.

    Equal passages of a shard are indexed twice at most; that is enough to tell
    whether a window occurs again.
    """

    def solve(passages: dict[bytes, list[tuple]]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        spans: list[tuple] = []
        tokens: list[int] = []
        starts, ends, owners = [], [], []
        for words, where in passages.items():
            own = words.split(b" ")
            if len(where) > 1:
                spans += [(row_no, a, len(own)) for row_no, a in where]
            starts.append(len(tokens))
            tokens += [numbers.setdefault(w, len(numbers) + 1) for w in own]
            ends.append(len(tokens))
            tokens.append(0)
            owners.append(where[0] if len(where) == 1 else None)
        single = np.array([k for k, o in enumerate(owners) if o is not None], np.int64)
        if len(single):
            run = np.array(tokens, np.int64)
            index = FMIndex(run)
            first, last = np.array(starts)[single], np.array(ends)[single] - window
            hit = repeated_windows(index, run, first, last, window)
            for k, a, b in zip(single.tolist(), first.tolist(), last.tolist(), strict=True):
                own = np.flatnonzero(hit[a : b + 1])
                if len(own):
                    breaks = np.flatnonzero(np.diff(own) > 1) + 1
                    row_no, at = owners[k]
                    for part in np.split(own, breaks):
                        spans.append((row_no, at + int(part[0]), int(part[-1] - part[0]) + window))
        if spans:
            kinds = (pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array(x, k) for x, k in zip(zip(*spans, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["row_no", "a", "size"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages: dict[bytes, list[tuple]] = {}
        held, last = 0, None
        for batch in batches:
            rows = zip(*[batch[c].to_pylist() for c in ("key", "row_no", "a")], utf8(batch["words"]), strict=True)
            for key, row_no, a, words in rows:
                if key != last and held > shard_tokens:
                    yield from solve(passages)
                    passages, held = {}, 0
                last = key
                where = passages.setdefault(words, [])
                if not where:
                    held += words.count(b" ") + 2
                where.append((row_no, a))
        yield from solve(passages)

    return run


_SIDES = "key long, row_no long, a int, before string, anchor string, after string"


def _cut_at_anchor(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a region before its anchor, nearest first, the anchor, and the words after it; each ends in a space.

    The anchor is the leftmost shingle of its hash, as in :func:`regions_of`.
    """
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [x.split(b" ") for x in utf8(batch["words"])]
        sizes = np.array([len(words) for words in own])
        starts = np.cumsum(sizes) - sizes
        hashes = np.fromiter((digest(w) for words in own for w in words), np.uint64, sizes.sum())
        grams = _shingles(_content(hashes), len(hashes))
        keys = batch["key"].to_numpy().view(np.uint64)
        at = np.flatnonzero(grams == np.repeat(keys, sizes)[: len(grams)])
        cuts = (at[np.searchsorted(at, starts)] - starts).tolist()
        sides = [
            (words[:k][::-1], words[k : k + ANCHOR], words[k + ANCHOR :]) for words, k in zip(own, cuts, strict=True)
        ]
        out = [[b"".join(w + b" " for w in part) for part in column] for column in zip(*sides, strict=True)]
        columns = [batch[c] for c in ("key", "row_no", "a")] + [pa.array(x, pa.binary()).cast(pa.string()) for x in out]
        yield pa.RecordBatch.from_arrays(columns, ["key", "row_no", "a", "before", "anchor", "after"])


def _shared_with_neighbours(side: str):
    """Adds ``n_<side>``: how many words of that side a region shares with another of its key, from the anchor on.

    The rows are sorted by key and side, so no other region shares more than
    one of the two neighbours.  At the edge of a partition all words count as shared.
    """

    def judged(held: pa.Table, has_before: bool, has_after: bool) -> Iterator[pa.RecordBatch]:
        keys, words = held["key"].to_numpy(), [x.split() for x in utf8(held[side])]
        shared = np.zeros(len(words) + 1, np.int32)
        for k in np.flatnonzero(keys[1:] == keys[:-1]).tolist():
            shared[k + 1] = next((n for n, (x, y) in enumerate(zip(words[k], words[k + 1])) if x != y), min(len(words[k]), len(words[k + 1])))
        if not has_before:
            shared[0] = len(words[0])
        if not has_after:
            shared[-1] = len(words[-1])
        out = held.append_column(f"n_{side}", pa.array(np.maximum(shared[:-1], shared[1:])))
        a, b = int(has_before), len(words) - int(has_after)
        yield from out.slice(a, b - a).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "row_no", "a", "before", "anchor", "after"] + ["n_after"] * (side == "before")
        return _beside_neighbours(batches, names, judged)

    return run


_PARTS = "row_no long, a int, words string"


def _cut_to_shared(window: int):
    """The run of windows of a region whose words on both sides of the anchor are shared; nothing where there is none."""
    reach = window - ANCHOR

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            sides = zip(*[utf8(batch[c]) for c in ("before", "anchor", "after")], strict=True)
            shared = zip(batch["n_before"].to_pylist(), batch["n_after"].to_pylist(), strict=True)
            where = zip(batch["row_no"].to_pylist(), batch["a"].to_pylist(), strict=True)
            for (before, anchor, after), (n_before, n_after), (row_no, a) in zip(sides, shared, where, strict=True):
                before, after = before.split(), after.split()
                # words before the anchor in the first and in the last window
                most, least = n_before, reach - n_after
                if least <= most:
                    words = before[:most][::-1] + anchor.split() + after[: reach - least]
                    out.append((row_no, a + len(before) - most, b" ".join(words).decode()))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.string())
                columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["row_no", "a", "words"])

    return run


def _meet_spans(text: str, with_text: bool):
    """The last of the pending documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            texts: list = []
            columns = (batch["whole"].to_pylist(), batch["spans"].to_pylist())
            for body, whole, spans in zip(utf8(batch["row"].field(text)), *columns, strict=True):
                words = body.split()
                gone = _covered(len(words), [(s["a"], s["size"]) for s in (whole or []) + (spans or [])])
                n, removed, kept = _finish(words, gone)
                out.append((n, removed, hashlib.sha256(kept).hexdigest()))
                texts.append((kept if out[-1][1] else body).decode() if with_text else None)
            n, removed, digest = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({
                "row": _with_text(batch["row"], text, texts), "n_words": pa.array(n, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()),
            })

    return run


def _nullable(row: T.StructType, text: str) -> T.StructType:
    """``row`` whose text may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable or f.name == text, f.metadata) for f in row])


def _parts_of_hot_anchors(candidates: DataFrame, hot: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """``row_no, a, words``: what regions of hot anchors share with others on either side of the anchor."""
    sides = candidates.join(hot, "key", "left_semi").mapInArrow(_cut_at_anchor, _SIDES)
    sides, schema = scratch.keep(sides, "sides"), _SIDES
    for side in ("after", "before"):
        by, schema = ("key", side, "row_no", "a"), f"{schema}, n_{side} int"
        ordered = sides.repartitionByRange(*by).sortWithinPartitions(*by)
        sides = scratch.keep(ordered.mapInArrow(_shared_with_neighbours(side), schema), side)
    return scratch.keep(sides.mapInArrow(_cut_to_shared(window), _PARTS), "parts")


def _repeats_of_hot_anchors(candidates: DataFrame, hot: DataFrame, window: int, scratch: Scratch, hot_rows: int) -> DataFrame:
    """Spans of the windows of hot anchors that occur twice or more, found by their words.

    Equal parts are taken apart once, so windows grow with the different parts only.
    """
    parts = _parts_of_hot_anchors(candidates, hot, window, scratch)
    counted = parts.groupBy("words").agg(F.count("*").alias("n"), F.min("row_no").alias("row_no"), F.min("a").alias("a"))
    counted = scratch.keep(counted, "counted")
    equal = join_unique(parts, counted.where("n > 1").select("words"), "words", "inner", scratch, hot_rows)
    own = F.split("words", " ")
    single = F.transform(
        F.sequence(F.lit(1), F.size(own) - window + 1), lambda i: F.array_join(F.slice(own, i, F.lit(window)), " ")
    )
    windows = counted.select("n", "row_no", "a", F.posexplode(single).alias("k", "words"))
    windows = scratch.keep(windows.select("n", "row_no", (F.col("a") + F.col("k")).alias("a"), "words"), "windows")
    twice = windows.groupBy("words").agg(F.sum("n").alias("n")).where("n > 1").select("words")
    met = join_unique(windows.where("n = 1"), scratch.keep(twice, "twice"), "words", "inner", scratch, hot_rows)
    return equal.select("row_no", "a", F.size(own).alias("size")).unionByName(
        met.select("row_no", "a", F.lit(window).alias("size"))
    )


def _without_repeats(
    docs: DataFrame, scratch: Scratch, text: str, window: int, shard_tokens: int, hot_regions: int, hot_rows: int, with_text: bool
) -> DataFrame:
    """``row, n_words, n_removed, kept_sha256`` per document; ``row.text`` is what was kept."""
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row_no"), F.struct("*").alias("row")), "rows")
    given = rows.select("row_no", F.col(f"row.`{text}`").alias("text"))
    regions = scratch.keep(given.mapInArrow(_find_regions(window), _REGIONS), "regions")
    by = ("anchor", "region", "row_no")
    ordered = regions.where("n > 0").repartitionByRange(*by).sortWithinPartitions(*by)
    status = scratch.keep(ordered.mapInArrow(_compare_neighbours, _STATUS), "status")
    known = regions.where("n = 0").select("anchor", "row_no", "a", "m", F.lit(True).alias("whole"))
    spans = (
        status.unionByName(known)
        .groupBy("row_no")
        .agg(F.collect_list(F.struct("a", "m", "whole", F.when(~F.col("whole"), F.col("anchor")).alias("anchor"))).alias("spans"))
    )
    row = _nullable(rows.schema["row"].dataType, text)
    met_schema = T.StructType([
        T.StructField("row_no", T.LongType()),
        T.StructField("row", row),
        T.StructField("pending", T.BooleanType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        *T._parse_datatype_string(
            "whole array<struct<a: int, size: int>>, regions array<struct<anchor: bigint, a: int, words: string>>"
        ).fields,
    ])
    met = rows.join(spans, "row_no", "left").mapInArrow(_meet_regions(window, text, with_text), met_schema)
    met = scratch.keep(met, "met")
    candidates = met.where("pending").select("row_no", F.explode("regions").alias("r"))
    candidates = candidates.select(F.col("r.anchor").alias("key"), "row_no", F.col("r.a").alias("a"), "r.words")
    hot = status.where("not whole").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot_regions)
    hot = scratch.keep(hot.select(F.col("anchor").alias("key")), "hot")
    some_hot = not hot.isEmpty()
    cold = candidates.join(hot, "key", "left_anti") if some_hot else candidates
    found = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_search_shards(window, shard_tokens), _SPANS)
    if some_hot:
        found = found.unionByName(_repeats_of_hot_anchors(candidates, hot, window, scratch, hot_rows))
    found = found.groupBy("row_no").agg(F.collect_list(F.struct("a", "size")).alias("spans"))
    result = ["row", "n_words", "n_removed", "kept_sha256"]
    last = T.StructType([met_schema[c] for c in result])
    pending = met.where("pending").select("row_no", "row", "whole").join(found, "row_no", "left")
    return met.where("not pending").select(*result).unionByName(
        pending.select("row", "whole", "spans").mapInArrow(_meet_spans(text, with_text), last)
    )


def repeated_substrings(
    docs: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
    hot_regions: int = HOT_REGIONS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, one row per document."""
    given = docs.select(doc_id, text)
    found = _without_repeats(given, scratch, text, window, shard_tokens, hot_regions, hot_rows, False)
    return found.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def drop_repeated_substrings(
    docs: DataFrame,
    scratch: Scratch,
    text: str = "text",
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
    hot_regions: int = HOT_REGIONS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All rows and columns of ``docs``; the text is the kept words joined by one space.

    A text that loses nothing is returned as it was.
    """
    found = _without_repeats(docs, scratch, text, window, shard_tokens, hot_regions, hot_rows, True)
    return found.select("row.*")
