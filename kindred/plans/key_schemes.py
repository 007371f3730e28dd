"""Exact key schemes for the Hamming join.

Cut the 64 bits into ``k + c`` blocks.  ``k`` wrong bits spoil at most ``k``
blocks, so at least ``c`` blocks of a similar pair agree.  One key per choice
of ``c`` blocks therefore turns "distance <= k" into equi-joins that miss
nothing (Manku, Jain, Das Sarma, WWW 2007).  More agreeing blocks mean longer,
more selective keys but more key rows; ``choose_scheme`` weighs the two with
the row counts of the join at hand.

At large distances such keys are short or very many.  There a block may differ
by a radius of its own (general pigeonhole principle, Qin et al., ICDE 2018):
where the radii plus one sum to ``k + 1``, some block of a similar pair lies
within its radius.  ``allot_radii`` chooses them from counted block values, so
that crowded blocks get small radii or none.  A key for every value within a
radius is many keys; with regions a key is only the leading bits of a block,
as few as leave regions of bounded size, and the values within the radius are
found inside the tiles.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np

from kindred.plans.thresholds import HASH_BITS

# Costs in units of one comparison of two joined rows, as measured: moving one
# key row through explode, shuffle and sort; handing it to a tile; one
# comparison in a tile; and one tile.
KEY_ROW_COST = 200
TILE_ROW_COST = 600
TILE_COMPARISON_COST = 0.1
TILE_COST = 40_000
# Bucket size from which a tile is cheaper than joined rows.
TILE_FROM = 1500
# Longest list of masks put in one plan.
MAX_KEYS = 5000
# Blocks with radii: fewest blocks (13 bits, so that all values can be counted
# in a table of bounded size) and largest radius.
LEAST_BLOCKS = 5
MAX_RADIUS = 3


def signed(value: int) -> int:
    """The two's-complement 64-bit integer with the same bits."""
    return value - (1 << 64) if value >= 1 << 63 else value


def any_bit(terms: list[str]) -> str:
    """SQL text for the bitwise or of the terms, as a balanced tree."""
    while len(terms) > 1:
        terms = [f"({' | '.join(terms[i : i + 2])})" for i in range(0, len(terms), 2)]
    return terms[0]


def long_array(values: tuple[int, ...]) -> str:
    """SQL text for an array literal of 64-bit masks."""
    return "array(" + ", ".join(f"{signed(v)}L" for v in values) + ")"


@dataclass(frozen=True)
class KeyScheme:
    """Blocks (bit masks) and the number of them that must agree."""

    blocks: tuple[int, ...]
    agree: int
    # Rows only meet under values of their own; see RadiusScheme.
    one_way = False

    @property
    def key_masks(self) -> tuple[int, ...]:
        """One mask for every choice of ``agree`` blocks."""
        return tuple(sum(chosen) for chosen in combinations(self.blocks, self.agree))

    @property
    def reach_masks(self) -> tuple[int, ...]:
        """For every key, all blocks up to the last one it uses.

        A pair agreeing on more than ``agree`` blocks meets under several
        keys.  It belongs to the key made of its first agreeing blocks, that
        is where its agreeing blocks within the reach are the key itself.
        """
        reaches = []
        for chosen in combinations(range(len(self.blocks)), self.agree):
            reaches.append(sum(self.blocks[: chosen[-1] + 1]))
        return tuple(reaches)

    def owned_sql(self, difference: str, no: str) -> str:
        """SQL text: whether key ``no`` is the one that reports the pair."""
        agreeing = any_bit([f"if(({difference} & {signed(b)}L) = 0L, {signed(b)}L, 0L)" for b in self.blocks])
        reach, mask = long_array(self.reach_masks), long_array(self.key_masks)
        return f"({agreeing} & {reach}[{no}]) = {mask}[{no}]"

    def owned(self, no: int | np.ndarray, difference: np.ndarray) -> np.ndarray:
        """Whether key ``no`` (of all pairs, or one each) reports pairs with these differing bits."""
        reach, mask = (np.array(masks, dtype=np.uint64)[no] for masks in (self.reach_masks, self.key_masks))
        block = np.array(self.blocks, dtype=np.uint64)
        equal = np.where(difference[:, None] & block[None, :], np.uint64(0), block[None, :])
        agreeing = np.bitwise_or.reduce(equal, axis=1)
        return (agreeing & reach) == mask

    def hit_rate(self) -> float:
        """Expected key matches of one pair of uniform hashes."""
        return sum(2.0 ** -mask.bit_count() for mask in self.key_masks)

    def cost(self, probes: int, rows: int) -> float:
        """Estimated cost to compare ``probes`` with ``rows`` uniform hashes."""
        n_keys = len(self.key_masks)
        key_rows, comparisons = (probes + rows) * n_keys, probes * rows * self.hit_rate()
        if rows * self.hit_rate() / n_keys <= TILE_FROM:
            return key_rows * KEY_ROW_COST + comparisons
        tiles = sum(2.0 ** mask.bit_count() for mask in self.key_masks)
        return (
            key_rows * (KEY_ROW_COST + TILE_ROW_COST) + comparisons * TILE_COMPARISON_COST + tiles * TILE_COST
        )


def contiguous_blocks(count: int) -> tuple[int, ...]:
    """``count`` runs of neighbouring bits, most significant first."""
    edges = [HASH_BITS * i // count for i in range(count + 1)]
    return tuple(((1 << (b - a)) - 1) << (HASH_BITS - b) for a, b in zip(edges, edges[1:]))


def strided_blocks(count: int) -> tuple[int, ...]:
    """``count`` blocks where block ``i`` holds every ``count``-th bit."""
    return tuple(sum(1 << bit for bit in range(i, HASH_BITS, count)) for i in range(count))


def choose_scheme(distance: int, probes: int, rows: int, strided: bool = False) -> KeyScheme:
    """Cheapest exact scheme to compare ``probes`` hashes with ``rows`` hashes."""
    layout = strided_blocks if strided else contiguous_blocks
    if distance == 0:
        return KeyScheme(layout(1), 1)
    best, best_cost = None, float("inf")
    for agree in range(1, HASH_BITS - distance):
        n_keys = comb(distance + agree, agree)
        if n_keys > MAX_KEYS:
            break
        scheme = KeyScheme(layout(distance + agree), agree)
        cost = scheme.cost(probes, rows)
        if cost < best_cost:
            best, best_cost = scheme, cost
    return best


@dataclass(frozen=True)
class RadiusScheme:
    """Blocks (bit masks) and the wrong bits allowed in each; -1 leaves a block out.

    A probe has a key for every value within the radius, a stored row only its
    own value.  A pair is reported by its first block within the radius.  One way
    (all rows probe), a row only probes the values larger than its own.  With
    ``regions`` the values are those of so many leading bits of each block.
    """

    blocks: tuple[int, ...]
    radii: tuple[int, ...]
    one_way: bool = False
    regions: tuple[int, ...] = ()

    @property
    def masks(self) -> tuple[int, ...]:
        """The bits of each block that are its key."""
        if not self.regions:
            return self.blocks
        leading = []
        for block, bits in zip(self.blocks, self.regions):
            low = (block & -block).bit_length() - 1 + block.bit_count() - bits
            leading.append(block >> low << low)
        return tuple(leading)

    @property
    def entries(self) -> tuple[tuple[int, int, int], ...]:
        """Number of the block, the mask of its key and flipped bits, for every key of a probe."""
        return tuple(
            (no, mask, sum(flipped))
            for no, (mask, radius) in enumerate(zip(self.masks, self.radii))
            for count in range(radius + 1)
            for flipped in combinations([1 << b for b in range(HASH_BITS) if mask >> b & 1], count)
        )

    def owned_sql(self, difference: str, no: str) -> str:
        """SQL text: whether block ``no`` is the one that reports the pair."""
        first = " ".join(
            f"when bit_count({difference} & {signed(b)}L) <= {r} then {i}"
            for i, (b, r) in enumerate(zip(self.blocks, self.radii))
            if r >= 0
        )
        return f"{no} = (case {first} end)"

    def owned(self, no: int | np.ndarray, difference: np.ndarray) -> np.ndarray:
        """Whether block ``no`` (of all pairs, or one each) reports pairs with these differing bits."""
        keep = np.ones(len(difference), dtype=bool)
        for at, (block, radius) in enumerate(zip(self.blocks, self.radii)):
            if radius >= 0:
                far = np.bitwise_count(difference & np.uint64(block)) > radius
                keep &= np.where(at == np.asarray(no), ~far, far | (at > np.asarray(no)))
        return keep


def ball(width: int, radius: int) -> int:
    """Number of values within ``radius`` bits of one value."""
    return sum(comb(width, wrong) for wrong in range(radius + 1))


def comparisons_by_radius(rows: np.ndarray, fresh: np.ndarray) -> list[float]:
    """Pairs of a fresh row and any row whose block values lie within 0, 1, ... bits.

    ``rows`` and ``fresh`` count the rows by block value.  Going through the
    bits one by one, each value gathers the fresh rows at every distance.
    """
    values = np.arange(len(rows))
    apart = [fresh.astype(float)] + [np.zeros(len(rows)) for _ in range(MAX_RADIUS)]
    bit = 1
    while bit < len(rows):
        turned = [counts[values ^ bit] for counts in apart[:-1]]
        for wrong in range(MAX_RADIUS):
            apart[wrong + 1] = apart[wrong + 1] + turned[wrong]
        bit *= 2
    return np.cumsum([float(rows @ counts) for counts in apart]).tolist()


def region_bits(rows: np.ndarray, most: int) -> int:
    """Fewest leading bits whose values have at most ``most`` rows each; all bits for ``most`` 0."""
    width = (len(rows) - 1).bit_length()
    return next((bits for bits in range(width) if rows.reshape(1 << bits, -1).sum(axis=1).max() <= most), width)


def allot_radii(distance: int, rows: list[np.ndarray], fresh: list[np.ndarray],
                region_rows: int = 0) -> tuple[tuple[int, ...], float]:
    """Radii of the least estimated cost, and that cost, from the counts per block value."""
    best = {0: (0.0, ())}
    for all_rows, probes in zip(rows, fresh):
        width = region_bits(all_rows, region_rows)
        n_rows, n_probes = float(all_rows.sum()), float(probes.sum())
        costs = {-1: 0.0}
        for radius, compared in enumerate(comparisons_by_radius(all_rows, probes)):
            keys = n_rows - n_probes + n_probes * ball(width, radius)
            if max(n_rows, n_probes * ball(width, radius)) > TILE_FROM << width:
                cost = keys * (KEY_ROW_COST + TILE_ROW_COST) + compared * TILE_COMPARISON_COST + len(all_rows) * TILE_COST
            else:
                cost = keys * KEY_ROW_COST + compared
            costs[radius] = cost
        reached = {}
        for done, (spent, radii) in best.items():
            for radius, cost in costs.items():
                # More than the distance asks for is never needed.
                total = done + radius + 1
                if total <= distance + 1 and (total not in reached or spent + cost < reached[total][0]):
                    reached[total] = spent + cost, (*radii, radius)
        best = reached
    cost, radii = best.get(distance + 1, (float("inf"), ()))
    return radii, cost


def block_count(distance: int, probes: int, rows: int, region_rows: int = 0) -> tuple[int, float]:
    """Number of blocks with radii that is cheapest on uniform hashes, and its cost."""
    found = []
    for count in range(min(LEAST_BLOCKS, distance + 1), distance + 2):
        sizes = [1 << block.bit_count() for block in contiguous_blocks(count)]
        if max(sizes) > 1 << -(-HASH_BITS // LEAST_BLOCKS):
            continue
        spread = [[np.full(size, n / size) for size in sizes] for n in (rows, probes)]
        found.append((allot_radii(distance, *spread, region_rows)[1], count))
    cost, count = min(found, default=(float("inf"), 0))
    return count, cost
