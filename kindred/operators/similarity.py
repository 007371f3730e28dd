"""Exact Hamming-distance joins over distinct fingerprints.

The rows are ``id, phash, fresh`` with distinct ``phash``; rows of one old
group may share an ``id``.  A pair is looked for when at least one side is
fresh: all rows are fresh in a full build, only the pending ones in an
incremental run.  Pairs meet by equi-join on block keys
(``plans.key_schemes``).  Small buckets are joined row by row.  Larger ones
are compared as arrays, in tiles of bounded size that are spread over the
cluster, which is many times faster per comparison.  Very large ones are first
keyed a second time with other blocks.  At large distances blocks may differ
by radii chosen from their counted values: probes then have a key for every
value within the radius, or for every region of values that reaches into it.
Where all rows are fresh, a pair is looked for from
one side only: the row with the smaller fingerprint or, where the block of the
key differs, with the smaller value of the block.  Every way is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.bits import block_values
from kindred.operators.skew import join_unique
from kindred.plans.key_schemes import (
    TILE_FROM,
    KeyScheme,
    RadiusScheme,
    allot_radii,
    block_count,
    choose_scheme,
    contiguous_blocks,
    long_array,
    region_bits,
    signed,
)
from kindred.sources.scratch import Scratch


@dataclass(frozen=True)
class JoinLimits:
    """Sizes at which the join changes its physical form."""

    # Key rows of the fresh side that may be broadcast (about 40 bytes each),
    # and rows of it that one key may meet.
    broadcast_keys: int = 500_000
    broadcast_bucket: int = 1000
    # Rows of one bucket that are joined row by row, and in tiles.
    bucket_rows: int = TILE_FROM
    rekey_rows: int = 200_000
    # Length of the list of larger buckets that may be broadcast.
    large_buckets: int = 1_000_000
    # Rows on each side of one tile; more where a bucket is cut into GRID already.
    tile_rows: int = 8192
    # Comparisons (row by row, in tiles) and key rows that one task should get.
    task_comparisons: int = 5_000_000
    task_tile_comparisons: int = 5_000_000_000
    task_keys: int = 2_000_000
    # Tables up to this size are spread anew when they sit in few partitions.
    respread_rows: int = 5_000_000
    # Distance from which blocks with radii are weighed against equal blocks,
    # and their number where it is not to be chosen by cost.
    radii_from: int = 8
    radii_blocks: int = 0
    # Rows of one region of block values at most (regions are weighed from as many
    # rows on), and the number of blocks with regions where it is not to be chosen by cost.
    region_rows: int = 262_144
    region_blocks: int = 0


DEFAULT_LIMITS = JoinLimits()


# What a row does in a tile; flipped probes are there for another value of their block.
BOTH, PROBE, OTHER, FLIPPED = 0, 1, 2, 3
# Columns of a row in a tile; the others are its place.
ROW_COLUMNS = ("id", "phash", "fresh", "role")
# Comparisons done by one NumPy call; small enough for the caches.
BLOCK_COMPARISONS = 131_072
# Comparisons of a tile up to which many tiles share one NumPy call.
SMALL_TILE = 4096
# Lines and columns a bucket is cut into before its tiles grow, and their largest side:
# cut finer, rows would be sent in proportion to the square of the bucket.
GRID = 4
LARGEST_TILE = 8192
# Rows and comparisons that are handed to Python at a time, in whole tiles.
BUNDLE_ROWS = 2 * LARGEST_TILE
BUNDLE_COMPARISONS = LARGEST_TILE * LARGEST_TILE
# Rows per value that a region is divided down to, and close pairs handed on at a time.
VALUE_ROWS = 32
FOUND_PAIRS = 65_536


def distinct_hashes(images: DataFrame) -> DataFrame:
    """One row per fingerprint: ``phash``, smallest ``id``, copies ``n``."""
    return images.groupBy("phash").agg(F.min("image_id").alias("id"), F.count("*").alias("n"))


def with_keys(rows: DataFrame, scheme: KeyScheme, level: int = 1) -> DataFrame:
    """One row per key: adds ``no<level>`` (which key) and ``key<level>``."""
    masks = F.posexplode(F.expr(long_array(scheme.key_masks))).alias(f"no{level}", "_mask")
    return rows.select("*", masks).withColumn(
        f"key{level}", F.col("phash").bitwiseAND(F.col("_mask"))
    ).drop("_mask")


def with_probe_keys(rows: DataFrame, scheme: KeyScheme | RadiusScheme) -> DataFrame:
    """Like :func:`with_keys`, with the keys that only a fresh row has as a probe.

    ``other`` marks the keys under which a row is found.  One way, a row probes
    the larger values only: of two values the one without the highest differing bit is smaller.
    """
    if isinstance(scheme, KeyScheme):
        return with_keys(rows, scheme).withColumn("other", F.lit(True))
    top = [1 << flip.bit_length() - 1 if flip and scheme.one_way else 0 for _, _, flip in scheme.entries]
    keys = ", ".join(f"struct({no} as no, {signed(mask)}L as mask, {signed(flip)}L as flip, {signed(high)}L as top)"
                     for (no, mask, flip), high in zip(scheme.entries, top))
    return (
        rows.withColumn("_k", F.explode(F.expr(f"array({keys})")))
        .where("(fresh or _k.flip = 0L) and (phash & _k.top) = 0L")
        .withColumns({
            "no1": F.col("_k.no"),
            "key1": F.col("phash").bitwiseAND(F.col("_k.mask")).bitwiseXOR(F.col("_k.flip")),
            "other": F.col("_k.flip") == 0,
        })
        .drop("_k")
    )


def _join_keyed(left: DataFrame, right: DataFrame, schemes: list[KeyScheme | RadiusScheme], distance: int) -> DataFrame:
    """Verified pairs of two keyed tables, each reported by one key."""
    difference = "(x.phash ^ y.phash)"
    tests = []
    for level in range(1, len(schemes) + 1):
        tests += [f"x.no{level} = y.no{level}", f"x.key{level} = y.key{level}"]
    flipped = " or not x.other" if schemes[0].one_way else ""
    tests += [f"(x.phash < y.phash or not y.fresh{flipped})", f"bit_count({difference}) <= {distance}"]
    for level, scheme in enumerate(schemes, start=1):
        if len(scheme.blocks) > 1:
            tests.append(scheme.owned_sql(difference, f"x.no{level}"))
    x, y = left.alias("x"), right.alias("y")
    return x.join(y, F.expr(" and ".join(tests))).selectExpr(
        "least(x.id, y.id) as a",
        "greatest(x.id, y.id) as b",
        f"cast(bit_count({difference}) as bigint) as distance",
    )


def _close(left: np.ndarray, right: np.ndarray, distance: int, larger: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """Places in ``left`` and ``right``, and distances, of the close pairs, by blocks.

    With ``larger`` both are sorted as signed numbers, and only pairs whose right
    one is larger are needed (others may come with them).
    """
    if not len(left) or not len(right):
        return
    # Tests are read eight at a time, since almost all of them fail.
    width = -(-len(right) // 8) * 8
    padded = np.resize(right, width)
    skipped = np.zeros(len(left), dtype=np.int64)
    if larger:
        skipped = np.searchsorted(right.view(np.int64), left.view(np.int64), side="right") // 8 * 8
    size = max(BLOCK_COMPARISONS, width)
    differences = np.empty(size, dtype=np.uint64)
    counts, tests = np.empty(size, dtype=np.uint8), np.empty(size, dtype=bool)
    start = 0
    while start < len(left) and skipped[start] < width:
        skip = int(skipped[start])
        wide = width - skip
        rows = min(max(1, BLOCK_COMPARISONS // wide), len(left) - start)
        difference, apart, near = (x[: rows * wide].reshape(rows, wide) for x in (differences, counts, tests))
        np.bitwise_xor(left[start : start + rows, None], padded[None, skip:], out=difference)
        np.bitwise_count(difference, out=apart)
        np.less_equal(apart, distance, out=near)
        eights = np.flatnonzero(near.reshape(-1).view(np.uint64))
        at = (eights[:, None] * 8 + np.arange(8)).reshape(-1)
        at = at[near.reshape(-1)[at] & (skip + at % wide < len(right))]
        if len(at):
            yield start + at // wide, skip + at % wide, apart.reshape(-1)[at]
        start += rows


def _close_in_tiles(bits: np.ndarray, left: np.ndarray, right: np.ndarray, tile: np.ndarray,
                    distance: int, larger: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows, and distances, of the close pairs of each tile.

    ``left`` and ``right`` are rows in the order of their ``tile``.  Small tiles
    are compared many at a time, each larger one by itself (see :func:`_close` for ``larger``).
    """
    n_tiles = int(tile[-1]) + 1
    n_left, n_right = (np.bincount(tile[side], minlength=n_tiles) for side in (left, right))
    left_end, right_end = np.cumsum(n_left), np.cumsum(n_right)
    large = n_left * n_right > SMALL_TILE
    for t in np.flatnonzero(large):
        rows, others = left[left_end[t] - n_left[t] : left_end[t]], right[right_end[t] - n_right[t] : right_end[t]]
        for i, j, apart in _close(bits[rows], bits[others], distance, larger):
            yield rows[i], others[j], apart
    rows = left[~large[tile[left]]]
    width, first = n_right[tile[rows]], (right_end - n_right)[tile[rows]]
    done = np.concatenate([[0], np.cumsum(width)])
    start = 0
    while start < len(rows):
        # One row has SMALL_TILE others at most, so there is always progress.
        end = int(np.searchsorted(done, done[start] + SMALL_TILE * 64, side="right")) - 1
        wide = width[start:end]
        at = np.arange(done[end] - done[start]) - np.repeat(done[start:end] - done[start], wide)
        i, j = np.repeat(rows[start:end], wide), right[np.repeat(first[start:end], wide) + at]
        apart = np.bitwise_count(bits[i] ^ bits[j])
        near = np.flatnonzero(apart <= distance)
        yield i[near], j[near], apart[near]
        start = end


def _close_in_regions(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, tile: np.ndarray,
                      scheme: RadiusScheme, distance: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Like :func:`_close_in_tiles`; only values within the radius of the block are compared.

    What the regions of the two sides differ by is taken off the radius; the
    rest of it bounds how far the values inside the regions may be apart.
    """
    bits = rows["phash"].view(np.uint64)
    n_tiles = int(tile[-1]) + 1
    n_left, n_right = (np.bincount(tile[side], minlength=n_tiles) for side in (left, right))
    left_end, right_end = np.cumsum(n_left), np.cumsum(n_right)
    found, n_found = [], 0
    for t in np.flatnonzero((n_left > 0) & (n_right > 0)):
        mine, others = left[left_end[t] - n_left[t] : left_end[t]], right[right_end[t] - n_right[t] : right_end[t]]
        no = int(rows["no1"][others[0]])
        block, mask, radius = scheme.blocks[no], scheme.masks[no], scheme.radii[no]
        inside = block & ~mask
        width = min(inside.bit_count(), max(0, (len(others) // VALUE_ROWS).bit_length() - 1))
        low, values = inside.bit_length() - width, np.uint64((1 << width) - 1)
        apart_outside = np.bitwise_count((bits[mine] ^ bits[others[0]]) & np.uint64(mask)).astype(np.int64)
        value = (bits[others] >> np.uint64(low) & values).astype(np.int64)
        others = others[np.argsort(value, kind="stable")]
        other_bits = bits[others]
        ends = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << width))])
        place = apart_outside << width | (bits[mine] >> np.uint64(low) & values).astype(np.int64)
        order = np.argsort(place, kind="stable")
        mine, place = mine[order], place[order]
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
        wrong = np.bitwise_count(np.arange(1 << width))
        flips = [np.flatnonzero(wrong <= radius - outside) for outside in range(radius + 1)]
        for start, end in zip(cuts, cuts[1:]):
            outside, own = divmod(int(place[start]), 1 << width)
            near = flips[outside] ^ own
            sizes = ends[near + 1] - ends[near]
            done = np.cumsum(sizes)
            if not done[-1]:
                continue
            which = np.repeat(ends[near] - (done - sizes), sizes) + np.arange(done[-1])
            for i, j, apart in _close(bits[mine[start:end]], other_bits[which], distance):
                found.append((mine[start + i], others[which[j]], apart))
                n_found += len(i)
            if n_found >= FOUND_PAIRS:
                yield tuple(np.concatenate(column) for column in zip(*found))
                found, n_found = [], 0
    if found:
        yield tuple(np.concatenate(column) for column in zip(*found))


def _by_regions(schemes: list[KeyScheme | RadiusScheme]) -> bool:
    return len(schemes) == 1 and isinstance(schemes[0], RadiusScheme) and bool(schemes[0].regions)


def _tile_function(schemes: list[KeyScheme], distance: int, forest: bool) -> Callable:
    """Function that compares the two sides of every tile it is given.

    With ``forest`` it returns links that connect the same images as all
    similar pairs of these tiles, at most one per row; otherwise the pairs that
    the keys of their tiles own.
    """
    levels = range(1, len(schemes) + 1)
    one_way = schemes[0].one_way

    def pairs(rows: dict[str, np.ndarray], close: Iterator) -> pd.DataFrame:
        bits, ids, hashes, fresh = rows["phash"].view(np.uint64), rows["id"], rows["phash"], rows["fresh"]
        found = [np.empty((0, 3), dtype=np.int64)]
        for i, j, apart in close:
            mine = np.flatnonzero((hashes[i] < hashes[j]) | ~fresh[j] | (one_way & (rows["role"][i] == FLIPPED)))
            if len(mine):
                i, j, apart = i[mine], j[mine], apart[mine]
                keep = np.ones(len(i), dtype=bool)
                for level, scheme in zip(levels, schemes):
                    keep &= scheme.owned(rows[f"no{level}"][i], bits[i] ^ bits[j])
                x, y = ids[i[keep]], ids[j[keep]]
                found.append(np.column_stack([np.minimum(x, y), np.maximum(x, y), apart[keep].astype(np.int64)]))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b", "distance"])

    def links(rows: dict[str, np.ndarray], close: Iterator) -> pd.DataFrame:
        hashes, first, node = np.unique(rows["phash"], return_index=True, return_inverse=True)
        order = np.lexsort((hashes, rows["id"][first]))
        ids, at = rows["id"][first][order], np.argsort(order)[node]
        label = np.arange(len(ids))
        for i, j, _ in close:
            ends = np.column_stack([label[at[i]], label[at[j]]])
            ends = ends[ends[:, 0] != ends[:, 1]]
            if not len(ends):
                continue
            for x, y in np.unique(np.sort(ends, axis=1), axis=0).tolist():
                while label[x] != x:
                    x = label[x]
                while label[y] != y:
                    y = label[y]
                label[max(x, y)] = min(x, y)
            while (label[label] != label).any():
                label = label[label]
        moved = np.flatnonzero(ids[label] != ids)
        return pd.DataFrame({"a": ids[label[moved]], "b": ids[moved], "distance": np.int64(0)})

    def compare(given: pd.DataFrame) -> pd.DataFrame:
        place = [given[c].to_numpy() for c in given.columns if c not in ROW_COLUMNS]
        order = np.lexsort([given["phash"].to_numpy(), *place])
        new = np.zeros(len(given), dtype=bool)
        for column in place:
            new[1:] |= np.diff(column[order]) != 0
        rows = {c: given[c].to_numpy()[order] for c in given.columns}
        rows["fresh"] = rows["fresh"].astype(bool)
        bits, tile, role = rows["phash"].view(np.uint64), np.cumsum(new), rows["role"]
        left = rows["fresh"] & (role != OTHER)
        right = (role == BOTH) | (role == OTHER)
        if _by_regions(schemes):
            found = _close_in_regions(rows, np.flatnonzero(left), np.flatnonzero(right), tile, schemes[0], distance)
            return (links if forest else pairs)(rows, found)
        # In a pair of fresh rows that are there for their own value, the smaller one looks for the larger.
        # With flips that go both ways, of two values either may find the other.
        larger = bool(rows["fresh"].all()) and (one_way or isinstance(schemes[0], KeyScheme))
        close = [
            _close_in_tiles(bits, np.flatnonzero(left & own), np.flatnonzero(right), tile, distance, larger and sorted_)
            for own, sorted_ in ((role != FLIPPED, True), (role == FLIPPED, False))
        ]
        return (links if forest else pairs)(rows, chain.from_iterable(close))

    return compare


def _key_columns(level: int) -> list[str]:
    return [c for at in range(1, level + 1) for c in (f"no{at}", f"key{at}")]


def _tiles(rows: DataFrame, large: DataFrame, schemes: list[KeyScheme], distance: int,
           forest: bool, limits: JoinLimits) -> DataFrame:
    """Pairs of larger buckets, compared in a grid of bounded tiles.

    A bucket that fits one tile is sent once.  In a larger one every probe
    meets every column of the grid, and every row to be found every line.
    Python gets whole tiles in bundles, since most of them are small.
    """
    keys = _key_columns(len(schemes))
    largest = max(limits.tile_rows, LARGEST_TILE)
    side = f"least({largest}, greatest({limits.tile_rows}, ceil({{0}} / {GRID})))"
    across, down = side.format("n_fresh"), side.format("n_rows")
    regions = _by_regions(schemes)
    if regions:
        across, down = 2 * limits.region_rows, limits.region_rows
    grid = large.select(
        *keys, "n_rows", "n_fresh", "n_keys",
        F.expr(f"ceil(n_fresh / {across})").alias("_across"),
        F.expr(f"ceil(n_rows / {down})").alias("_down"),
    )
    sent, comparisons, tiles = grid.agg(
        F.sum(F.expr("if(_down = 1 and _across = 1, n_keys, n_rows * _across + n_fresh * _down)")),
        F.sum(F.expr("n_rows * n_fresh")),
        F.sum(F.expr("_across * _down")),
    ).first()
    tasks = max(sent // limits.task_keys, comparisons // limits.task_tile_comparisons)
    cells = F.expr(f"""
        if(_down = 1 and _across = 1,
          array(struct(if(other, {BOTH}, {FLIPPED}) as role, 0L as _i, 0L as _j)), concat(
          if(fresh, transform(sequence(0L, _down - 1),
                              j -> struct(if(other, {PROBE}, {FLIPPED}) as role, pmod(xxhash64(phash), _across) as _i, j as _j)), array()),
          if(other, transform(sequence(0L, _across - 1),
                              i -> struct({OTHER} as role, i as _i, pmod(xxhash64(phash), _down) as _j)), array())))""")
    placed = (
        _meet(rows, grid, keys, "inner", limits)
        .select(*keys, "id", "phash", "fresh", F.explode(cells).alias("c"))
        .select(*keys, "id", "phash", "fresh", "c.role", "c._i", "c._j")
    )
    place = [*keys, "_i", "_j"]
    bundles = int(max(tasks, sent // BUNDLE_ROWS, comparisons // BUNDLE_COMPARISONS)) + 1
    if regions:  # a tile is large enough to be a task
        tasks, bundles = tiles, 4 * tiles
    placed = placed.withColumn("_bundle", F.expr(f"pmod(xxhash64({', '.join(place)}), {bundles})"))
    dealt = placed.repartition(int(tasks), "_bundle") if regions else _spread(placed, ["_bundle"], tasks)
    return (
        dealt.groupBy("_bundle")
        .applyInPandas(_tile_function(schemes, distance, forest), "a bigint, b bigint, distance bigint")
    )


def _meet(rows: DataFrame, buckets: DataFrame, keys: list[str], how: str, limits: JoinLimits) -> DataFrame:
    """Keyed rows joined with a written list of buckets and their ``n_keys``.

    A list of a counted, short length is broadcast.  Of a longer one only the
    very large buckets are, one for at least ``rekey_rows`` key rows; the rest
    meet by a shuffle, in which no key is hot.
    """
    if buckets.count() <= limits.large_buckets:
        return rows.join(F.broadcast(buckets), keys, how)
    hot = F.broadcast(buckets.where(F.col("n_keys") > limits.rekey_rows))
    rest = buckets.where(F.col("n_keys") <= limits.rekey_rows).hint("merge")
    if how == "left_anti":
        return rows.join(hot, keys, how).join(rest, keys, how)
    return rows.join(hot, keys, how).unionByName(rows.join(rest, keys, how))


def _spread(keyed: DataFrame, keys: list[str], tasks: float) -> DataFrame:
    """Partition by key where the session's number of partitions is too small."""
    if tasks <= int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return keyed
    return keyed.repartition(int(tasks), *keys)


def _fullest_key(rows: DataFrame, scheme: KeyScheme) -> int:
    """Fresh rows under one key at most: what a stored row may meet in a broadcast.

    Counted, not estimated, as fingerprints of dark or flat pictures crowd.
    """
    counts = with_keys(rows.where("fresh").select("phash"), scheme).groupBy("no1", "key1").count()
    return counts.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def _search(rows: DataFrame, distance: int, scratch: Scratch, forest: bool, limits: JoinLimits) -> DataFrame:
    spark = rows.sparkSession
    n_rows, n_fresh = rows.agg(F.count("*"), F.count_if(F.col("fresh"))).first()
    if distance == 0 or n_fresh == 0 or n_rows < 2:
        return spark.createDataFrame([], "a bigint, b bigint, distance bigint")
    scheme = choose_scheme(distance, n_fresh, n_rows)
    n_masks = len(scheme.key_masks)
    if n_fresh * n_masks <= limits.broadcast_keys and _fullest_key(rows, scheme) <= limits.broadcast_bucket:
        # The fresh keys are counted, so this broadcast has a known bound; the
        # other side streams past it without a shuffle.
        work = n_fresh * n_rows * scheme.hit_rate() / limits.task_comparisons
        tasks = int(max(n_rows * n_masks / limits.task_keys, work))
        side = rows.repartition(tasks, "phash") if 1 < tasks and n_rows <= limits.respread_rows else rows
        probes = F.broadcast(with_keys(rows.where("fresh"), scheme))
        return _join_keyed(probes, with_keys(side, scheme), [scheme], distance)
    if distance >= limits.radii_from:
        by_regions = limits.region_blocks or (n_rows >= limits.region_rows and not limits.radii_blocks)
        region_rows = limits.region_rows if by_regions else 0
        wanted = limits.region_blocks or limits.radii_blocks
        count, cost = block_count(distance, n_fresh, n_rows, region_rows)
        # One block more than wrong bits gives the equal blocks above.
        if wanted or (count <= distance and cost < scheme.cost(n_fresh, n_rows)):
            scheme = choose_radii(rows, distance, wanted or count, n_fresh == n_rows, region_rows)
    n_keys = n_rows * n_masks
    if isinstance(scheme, RadiusScheme):
        n_keys = n_fresh * len(scheme.entries) // (1 + scheme.one_way) + n_rows * len(scheme.blocks)
    return _search_keyed(with_probe_keys(rows, scheme), [scheme], n_rows, n_keys, n_fresh == n_rows,
                         distance, scratch, forest, limits)


def choose_radii(rows: DataFrame, distance: int, count: int, one_way: bool = False,
                 region_rows: int = 0) -> RadiusScheme:
    """Radii for ``count`` blocks, and regions of ``region_rows`` rows at most, by the counted values of every block.

    The counts are bounded by the number of values: 2 ** 13 for each of five blocks.
    """
    blocks = contiguous_blocks(count)
    counts = [[np.zeros(1 << block.bit_count()) for block in blocks] for _ in range(2)]
    values = F.posexplode(F.array(*block_values(F.col("phash"), count))).alias("no", "value")
    counted = rows.select("fresh", values).groupBy("no", "value").agg(F.count("*"), F.count_if("fresh"))
    for no, value, n_rows, n_fresh in counted.collect():
        counts[0][no][value], counts[1][no][value] = n_rows, n_fresh
    regions = tuple(region_bits(all_rows, region_rows) for all_rows in counts[0]) if region_rows else ()
    return RadiusScheme(blocks, allot_radii(distance, *counts, region_rows)[0], one_way, regions)


def _search_keyed(keyed: DataFrame, schemes: list[KeyScheme], most: int, n_keys: int, all_fresh: bool,
                  distance: int, scratch: Scratch, forest: bool, limits: JoinLimits) -> DataFrame:
    """Pairs of keyed rows; no bucket has more than ``most`` of the ``n_keys`` rows."""
    keys = _key_columns(len(schemes))
    small, found = keyed, []
    if most > limits.bucket_rows:
        large = scratch.keep(
            keyed.groupBy(*keys)
            .agg(F.count_if("other").alias("n_rows"), F.count_if("fresh").alias("n_fresh"), F.count("*").alias("n_keys"))
            .where((F.col("n_keys") > limits.bucket_rows) & (F.col("n_rows") > 0) & (F.col("n_fresh") > 0)),
            "large",
        )
        last = len(schemes) == 2
        # Regions are made for tiles: only a single value can have more rows than these hold.
        size, most_rows = ("n_rows", limits.region_rows) if _by_regions(schemes) else ("n_keys", limits.rekey_rows)
        tiled = large if last else large.where(F.col(size) <= most_rows)
        if not tiled.isEmpty():
            found.append(_tiles(keyed, tiled, schemes, distance, forest, limits))
        huge = large.where(F.col(size) > most_rows)
        size = None if last else huge.agg(F.max("n_rows"), F.max("n_fresh"), F.sum("n_keys")).first()
        if size and size[0] is not None:
            crowded = _meet(keyed, huge, keys, "left_semi", limits)
            finer = choose_scheme(distance, size[1], size[0], strided=True)
            n_finer = size[2] * len(finer.key_masks)
            found.append(_search_keyed(
                with_keys(scratch.keep(crowded, "crowded"), finer, level=2), [*schemes, finer], size[0], n_finer,
                all_fresh, distance, scratch, forest, limits,
            ))
        small = _meet(keyed, large, keys, "left_anti", limits)
    small = _spread(small, keys, n_keys // limits.task_keys).hint("merge")
    left = small if all_fresh else small.where("fresh")
    return reduce(DataFrame.unionByName, found, _join_keyed(left, small.where("other"), schemes, distance))


def similar_pairs(rows: DataFrame, distance: int, scratch: Scratch,
                  limits: JoinLimits = DEFAULT_LIMITS) -> DataFrame:
    """All pairs within ``distance``: ``a < b, distance``, each once."""
    return _search(rows, distance, scratch, False, limits)


def similar_links(rows: DataFrame, distance: int, scratch: Scratch,
                  limits: JoinLimits = DEFAULT_LIMITS) -> DataFrame:
    """Links ``a, b`` with the same connected components as all similar pairs.

    Oversized buckets give a spanning forest per tile instead of all pairs.
    """
    return _search(rows, distance, scratch, True, limits).select("a", "b")


def similar_images(images: DataFrame, distance: int, scratch: Scratch,
                   limits: JoinLimits = DEFAULT_LIMITS) -> DataFrame:
    """Similar pairs ``a, b, distance`` of images ``image_id, phash``.

    Copies of one fingerprint are represented by the smallest id; every other
    copy is paired with it at distance 0.
    """
    kept = scratch.keep(distinct_hashes(images), "distinct")
    rows = kept.select("id", "phash", F.lit(True).alias("fresh"))
    copied = kept.where("n > 1").select("phash", "id")
    copies = (
        join_unique(images.select("image_id", "phash"), copied, "phash", "inner", scratch)
        .where("image_id <> id")
        .select(F.col("id").alias("a"), F.col("image_id").alias("b"), F.lit(0).cast("bigint").alias("distance"))
    )
    return copies.unionByName(similar_pairs(rows, distance, scratch, limits))


# Enough for the pairs of 10**18 images in a sum.
_PAIRS = "decimal(38,0)"


def _pairs_of(count: str) -> Column:
    """Exact number of pairs of ``count`` rows; the even factor is halved first."""
    big = "decimal(19,0)"
    return F.expr(
        f"if({count} % 2 = 0, cast({count} div 2 as {big}) * cast({count} - 1 as {big}), "
        f"cast({count} as {big}) * cast(({count} - 1) div 2 as {big}))"
    ).cast(_PAIRS)


def candidate_counts(images: DataFrame, parts: list[Column], distance: int, scratch: Scratch) -> DataFrame:
    """One row: image pairs that share a part, and those within ``distance``.

    Pairs sharing at least one part are counted from bucket sizes alone by
    inclusion and exclusion over the sets of parts, so no pair is formed.
    Pairs within the distance are counted from pairs of distinct fingerprints
    weighted by their copies.
    """
    kept = scratch.keep(distinct_hashes(images), "distinct")
    named = kept.select("phash", "n", F.array(*parts).alias("parts"))
    chosen = F.posexplode(F.array(*[
        F.array(*[F.lit(None).cast("bigint") if not (s >> i) & 1 else F.col("parts")[i] for i in range(len(parts))])
        for s in range(1, 1 << len(parts))
    ]))
    pairs = _pairs_of("m")
    added = F.bit_count(F.col("s") + 1) % 2 == 1
    none = F.lit(0).cast(_PAIRS)
    candidates = (
        named.select("n", chosen.alias("s", "value"))
        .groupBy("s", "value")
        .agg(F.sum("n").alias("m"))
        .select(F.when(added, pairs).otherwise(-pairs).alias("n_candidates"), none.alias("n_verified"))
    )
    rows = kept.select("id", "phash", F.lit(True).alias("fresh"))
    size = kept.select("id", "n")
    apart = (
        similar_pairs(rows, distance, scratch)
        .join(size.withColumnsRenamed({"id": "a", "n": "n_a"}), "a")
        .join(size.withColumnsRenamed({"id": "b", "n": "n_b"}), "b")
        .select((F.col("n_a").cast("decimal(19,0)") * F.col("n_b").cast("decimal(19,0)")).cast(_PAIRS).alias("m"))
    )
    equal = kept.select(_pairs_of("n").alias("m"))
    verified = apart.unionByName(equal).select(none.alias("n_candidates"), F.col("m").alias("n_verified"))
    return candidates.unionByName(verified).agg(
        F.coalesce(F.sum("n_candidates"), none).alias("n_candidates"),
        F.coalesce(F.sum("n_verified"), none).alias("n_verified"),
    )
