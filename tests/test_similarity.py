import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

import entry_queries.similarity
from brute import groups, pairs
from pyspark.sql import functions as F

from kindred.operators.clustering import cluster, cluster_incremental, new_neighbours, regroup
from kindred.operators.similarity import (
    _pairs_of,
    JoinLimits,
    candidate_counts,
    distinct_hashes,
    similar_images,
    similar_links,
    similar_pairs,
)
from kindred.functions.bits import block_values
from kindred.operators import similarity
from kindred.operators.components import connected_components
from kindred.plans.key_schemes import (
    KeyScheme,
    RadiusScheme,
    allot_radii,
    ball,
    block_count,
    choose_scheme,
    comparisons_by_radius,
    contiguous_blocks,
    signed,
    strided_blocks,
)
from kindred.plans.thresholds import check_threshold, max_distance

# Limits that force each physical form on small data.
BROADCAST = JoinLimits()
SHUFFLED = JoinLimits(broadcast_keys=0)
REKEYED = JoinLimits(broadcast_keys=0, bucket_rows=8, rekey_rows=8, tile_rows=16, task_keys=2_000)
TILED = JoinLimits(broadcast_keys=0, bucket_rows=1, tile_rows=16, task_tile_comparisons=500)
LISTED = JoinLimits(broadcast_keys=0, bucket_rows=4, rekey_rows=16, tile_rows=16, large_buckets=0)
RADII = {
    "radii": JoinLimits(broadcast_keys=0, radii_blocks=5),
    "radii_tiled": JoinLimits(broadcast_keys=0, bucket_rows=1, tile_rows=16, radii_blocks=8),
    "radii_rekeyed": JoinLimits(broadcast_keys=0, bucket_rows=16, rekey_rows=40, tile_rows=16, radii_blocks=7),
    "radii_listed": JoinLimits(broadcast_keys=0, bucket_rows=4, rekey_rows=64, tile_rows=16, large_buckets=0,
                               radii_blocks=10),
}
# Regions of one value to many, tiles cut into a grid, single values with more rows than a region.
REGIONS = {
    "whole": JoinLimits(broadcast_keys=0, bucket_rows=1, region_blocks=5),
    "small": JoinLimits(broadcast_keys=0, bucket_rows=1, region_blocks=6, region_rows=40),
    "crowded": JoinLimits(broadcast_keys=0, bucket_rows=1, region_blocks=5, region_rows=12, tile_rows=16),
    "few": JoinLimits(broadcast_keys=0, bucket_rows=60, region_blocks=9, region_rows=90),
}
FORMS = {"broadcast": BROADCAST, "shuffled": SHUFFLED, "rekeyed": REKEYED, "tiled": TILED, "listed": LISTED}


def planted(n: int, seed: int, free_bits: int = 64) -> dict[int, int]:
    """Hashes with near copies; only ``free_bits`` low bits vary, so keys get hot."""
    rng = random.Random(seed)
    rows = {}
    while len(rows) < n:
        value = rng.getrandbits(free_bits)
        rows[len(rows) + 1] = signed(value)
        for _ in range(rng.randrange(4)):
            for _ in range(rng.randrange(8)):
                value ^= 1 << rng.randrange(free_bits)
            rows[len(rows) + 1] = signed(value)
    return rows


def images(spark, rows):
    return spark.createDataFrame(list(rows.items()), "image_id bigint, phash bigint").repartition(4)


def unique(rows):
    seen = {}
    for i, h in sorted(rows.items()):
        seen.setdefault(h, i)
    return {i: h for h, i in seen.items()}


def test_thresholds():
    assert [max_distance(t) for t in (80, 90, 95, 100)] == [12, 6, 3, 0]
    for wrong in (0, 85, 99, None):
        with pytest.raises(ValueError):
            check_threshold(wrong)


@pytest.mark.parametrize("layout", [contiguous_blocks, strided_blocks])
def test_blocks_cover_all_bits_once(layout):
    for count in range(1, 30):
        blocks = layout(count)
        assert len(blocks) == count
        assert sum(blocks) == 2**64 - 1
        assert all(b for b in blocks)


def test_scheme_follows_the_size():
    small, large = choose_scheme(6, 1000, 1000), choose_scheme(6, 10**9, 10**9)
    assert small.agree < large.agree
    assert choose_scheme(3, 1000, 1000).key_masks == contiguous_blocks(4)
    assert len(choose_scheme(12, 10**12, 10**12).key_masks) <= 5000


def test_every_close_pair_has_exactly_one_owner():
    rng = random.Random(3)
    for k in (3, 6, 12):
        for agree in (1, 2, 3):
            scheme = KeyScheme(strided_blocks(k + agree), agree)
            for _ in range(50):
                difference = sum({1 << rng.randrange(64) for _ in range(k)})
                agreeing = sum(b for b in scheme.blocks if not difference & b)
                owners = [
                    m for m, r in zip(scheme.key_masks, scheme.reach_masks)
                    if not difference & m and agreeing & r == m
                ]
                assert len(owners) == 1


@pytest.mark.parametrize(
    "form, threshold, free_bits",
    [("broadcast", 80, 64), ("broadcast", 90, 14), ("shuffled", 80, 14), ("shuffled", 90, 64), ("shuffled", 95, 20),
     ("rekeyed", 80, 14), ("rekeyed", 90, 14), ("rekeyed", 95, 14), ("tiled", 80, 14), ("tiled", 90, 14)],
)
def test_pairs_equal_brute_force(spark, scratch, form, threshold, free_bits):
    rows = unique(planted(150, 7 + threshold, free_bits))
    k = max_distance(threshold)
    df = scratch.keep(
        images(spark, rows).select(F.col("image_id").alias("id"), "phash", F.lit(True).alias("fresh")), "rows"
    )
    found = [tuple(r) for r in similar_pairs(df, k, scratch, FORMS[form]).collect()]
    assert len(found) == len(set(found))
    assert set(found) == pairs(rows, k)


@pytest.mark.parametrize("form", ["broadcast", "rekeyed", "tiled"])
def test_fresh_pairs_equal_brute_force(spark, scratch, form):
    rows = unique(planted(150, 11, 20))
    fresh = {i for i in rows if i % 6 == 0}
    df = scratch.keep(
        images(spark, rows).select(
            F.col("image_id").alias("id"), "phash", F.col("image_id").isin(fresh).alias("fresh")
        ), "rows",
    )
    found = [tuple(r) for r in similar_pairs(df, 6, scratch, FORMS[form]).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {p for p in pairs(rows, 6) if p[0] in fresh or p[1] in fresh}


@pytest.mark.parametrize(
    "form, threshold",
    [("broadcast", 80), ("broadcast", 100), ("shuffled", 95), ("rekeyed", 90), ("tiled", 80), ("tiled", 90)],
)
def test_groups_equal_brute_force(spark, scratch, form, threshold):
    rows = planted(200, threshold, 24)
    found = cluster(images(spark, rows), threshold, scratch, FORMS[form])
    assert {r.image_id: r.group_id for r in found.collect()} == groups(rows, max_distance(threshold))


@pytest.mark.parametrize("form", RADII)
@pytest.mark.parametrize("free_bits, part", [(64, 1), (24, 1), (24, 5)])
def test_pairs_by_radii_equal_brute_force(spark, scratch, form, free_bits, part):
    rows = unique(planted(150, 40 + part, free_bits))
    fresh = {i for i in rows if i % part == 0}
    df = scratch.keep(
        images(spark, rows).select(
            F.col("image_id").alias("id"), "phash", F.col("image_id").isin(fresh).alias("fresh")
        ), "rows",
    )
    found = [tuple(r) for r in similar_pairs(df, 12, scratch, RADII[form]).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {p for p in pairs(rows, 12) if p[0] in fresh or p[1] in fresh}


@pytest.mark.parametrize("form", REGIONS)
@pytest.mark.parametrize("free_bits, part", [(64, 1), (24, 1), (64, 4)])
def test_pairs_by_regions_equal_brute_force(spark, scratch, form, free_bits, part):
    rows = unique(planted(150, 60 + part, free_bits))
    fresh = {i for i in rows if i % part == 0}
    df = scratch.keep(
        images(spark, rows).select(
            F.col("image_id").alias("id"), "phash", F.col("image_id").isin(fresh).alias("fresh")
        ), "rows",
    )
    found = [tuple(r) for r in similar_pairs(df, 12, scratch, REGIONS[form]).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {p for p in pairs(rows, 12) if p[0] in fresh or p[1] in fresh}


@pytest.mark.parametrize("form", REGIONS)
def test_groups_by_regions_equal_brute_force(spark, scratch, form):
    rows = planted(200, 82, 30)
    found = cluster(images(spark, rows), 80, scratch, REGIONS[form])
    assert {r.image_id: r.group_id for r in found.collect()} == groups(rows, 12)


@pytest.mark.parametrize("value_rows", [1, 4, 1000])
@pytest.mark.parametrize("bits", [0, 2, 11])
def test_values_inside_regions_equal_brute_force(monkeypatch, value_rows, bits):
    """A tile whose probes come from all regions within the radius, divided down to few rows a value."""
    monkeypatch.setattr(similarity, "VALUE_ROWS", value_rows)
    monkeypatch.setattr(similarity, "FOUND_PAIRS", 50)
    scheme = RadiusScheme(contiguous_blocks(5), (2, 2, 3, 1, 0), True, (bits,) * 5)
    rng = random.Random(bits)
    values = sorted(unique(planted(300, 90)).values(), key=lambda _: rng.random())
    values += [signed((v ^ (1 << rng.randrange(64))) & (1 << 64) - 1) for v in values[:100]]
    found, n_rows = [], 0
    for no, mask, key in {(no, mask, v & mask) for no, mask in enumerate(scheme.masks) for v in values}:
        flips = {signed(flip) for at, _, flip in scheme.entries if at == no}
        rows = [(i, v, True, similarity.BOTH if (v & mask) == key else similarity.FLIPPED)
                for i, v in enumerate(values) if (v & mask) == key or (v & mask) < key and signed((v & mask) ^ key) in flips]
        given = pd.DataFrame(rows, columns=["id", "phash", "fresh", "role"]).assign(no1=no, key1=key, _i=0, _j=0)
        found += similarity._tile_function([scheme], 12, False)(given)[["a", "b"]].itertuples(index=False, name=None)
        n_rows += len(rows)
    want = [(i, j) for (i, x), (j, y) in combinations(enumerate(values), 2) if x != y and bin((x ^ y) & (1 << 64) - 1).count("1") <= 12]
    assert sorted(found) == want


def test_regions_cost_less_than_equal_blocks_or_values():
    """At 2.5 million hashes and 80%: what is estimated to be moved and compared."""
    n = 2_500_000
    count, cost = block_count(12, n, n, JoinLimits().region_rows)
    assert count <= 12
    assert cost < choose_scheme(12, n, n).cost(n, n) / 2
    assert cost < block_count(12, n, n)[1]


@pytest.mark.parametrize("form", ["radii", "radii_tiled", "radii_rekeyed"])
def test_groups_by_radii_equal_brute_force(spark, scratch, form):
    rows = planted(200, 81, 30)
    found = cluster(images(spark, rows), 80, scratch, RADII[form])
    assert {r.image_id: r.group_id for r in found.collect()} == groups(rows, 12)


def test_every_close_pair_is_reported_by_one_block():
    rng = random.Random(5)
    scheme = RadiusScheme(contiguous_blocks(7), (2, 1, 3, -1, 0, 1, 1))
    keys = set(scheme.entries)
    assert sum(r + 1 for r in scheme.radii) == 14
    assert len(keys) == sum(ball(b.bit_count(), r) for b, r in zip(scheme.blocks, scheme.radii))
    for _ in range(300):
        difference = sum({1 << rng.randrange(64) for _ in range(13)})
        met = [no for no, block, flip in keys if difference & block == flip]
        owners = [no for no in met if scheme.owned(no, np.array([difference], dtype=np.uint64))[0]]
        assert len(owners) == 1


def test_radii_avoid_crowded_blocks():
    rng = np.random.default_rng(3)
    even = rng.integers(0, 50, 256).astype(float)
    fresh = np.floor(even / 3)
    met = comparisons_by_radius(even, fresh)
    for radius in range(4):
        near = [[bin(a ^ b).count("1") <= radius for a in range(256)] for b in range(256)]
        assert met[radius] == even @ (np.array(near) @ fresh)
    crowded = np.zeros(256)
    crowded[7] = even.sum()
    blocks = [even * 1000] * 4 + [crowded * 1000] + [even * 1000] * 3
    radii, _ = allot_radii(12, blocks, blocks)
    assert sum(r + 1 for r in radii) == 13
    assert radii[4] == -1
    # Small tables keep equal blocks: 13 of them, all without wrong bits.
    assert block_count(12, 10**5, 10**5)[0] == 13
    assert block_count(12, 10**9, 10**9)[0] < block_count(12, 10**5, 10**5)[0]


def test_tiny_limits_reach_the_tiles(spark, scratch, monkeypatch):
    calls = []
    tiles = similarity._tiles
    monkeypatch.setattr(similarity, "_tiles", lambda *a: calls.append(1) or tiles(*a))
    df = scratch.keep(
        images(spark, {i: i for i in range(200)}).select(
            F.col("image_id").alias("id"), "phash", F.lit(True).alias("fresh")
        ), "rows",
    )
    assert similar_pairs(df, 6, scratch, TILED).count() == len(pairs({i: i for i in range(200)}, 6))
    assert calls


def test_crowded_fingerprints_are_not_broadcast(spark, scratch, monkeypatch):
    """2,000 hashes that differ in their low bits only: few enough to broadcast, too many under one key."""
    calls = []
    keyed = similarity._search_keyed
    monkeypatch.setattr(similarity, "_search_keyed", lambda *a: calls.append(1) or keyed(*a))
    dark = {i: i * 37 for i in range(2000)}
    even = {i: signed(random.Random(i).getrandbits(64)) for i in range(2000)}
    for rows, crowded in ((dark, True), (even, False)):
        calls.clear()
        df = images(spark, rows).select(F.col("image_id").alias("id"), "phash", F.lit(True).alias("fresh"))
        found = similar_pairs(scratch.keep(df, "rows"), 3, scratch)
        assert bool(calls) == crowded
        assert {tuple(r) for r in found.collect()} == pairs(rows, 3)


def test_links_of_a_dense_bucket_stay_few(spark, scratch):
    rows = {i: i for i in range(1, 257)}  # all within 8 bits
    df = scratch.keep(
        images(spark, rows).select(F.col("image_id").alias("id"), "phash", F.lit(True).alias("fresh")), "rows"
    )
    limits = JoinLimits(broadcast_keys=0, bucket_rows=16, tile_rows=512)
    scheme = choose_scheme(12, 256, 256)
    links = similar_links(df, 12, scratch, limits)
    assert links.distinct().count() < len(scheme.key_masks) * 1000
    assert connected_components(links, scratch).where("root = 1").count() == 255


def test_rows_sent_to_tiles_grow_with_the_bucket(spark, scratch, monkeypatch):
    """One bucket of twice the rows sends twice the rows, in few calls of Python."""
    sent, spread = [], similarity._spread

    def spy(keyed, keys, tasks):
        if "role" in keyed.columns:
            sent.append((keyed.count(), keyed.select(*keys).distinct().count()))
        return spread(keyed, keys, tasks)

    monkeypatch.setattr(similarity, "_spread", spy)
    limits = JoinLimits(broadcast_keys=0, bucket_rows=16, tile_rows=16)
    for n in (256, 512):
        rows = images(spark, {i: i for i in range(n)}).select(F.col("image_id").alias("id"), "phash", F.lit(True).alias("fresh"))
        found = similar_pairs(scratch.keep(rows, "rows"), 1, scratch, limits)
        assert {tuple(r) for r in found.collect()} == pairs({i: i for i in range(n)}, 1)
    (rows, calls), (more, more_calls) = sent
    assert more == 2 * rows and calls <= 2 and more_calls <= 2


def test_chain_is_one_group(spark, scratch):
    found = cluster(images(spark, {1: 0, 2: 7, 3: 63}), 95, scratch)
    assert {r.group_id for r in found.collect()} == {1}


def test_copies_make_linear_output(spark, scratch):
    rows = {i: 5 for i in range(1, 101)} | {200: 7, 300: -1}
    found = {tuple(r) for r in similar_images(images(spark, rows), 3, scratch).collect()}
    assert found == {(1, i, 0) for i in range(2, 101)} | {(1, 200, 1)}


def test_lower_threshold_only_merges(spark, scratch):
    rows = images(spark, planted(200, 5, 30))
    fine, coarse = cluster(rows, 95, scratch), cluster(rows, 90, scratch)
    both = fine.join(coarse.select("image_id", F.col("group_id").alias("coarse")), "image_id")
    assert both.groupBy("group_id").agg(F.countDistinct("coarse").alias("n")).where("n > 1").isEmpty()


def test_pair_counts_of_many_images(spark):
    counts = [0, 1, 2, 3, 20_000_000_000, 20_000_000_001, 10**17]
    found = spark.createDataFrame([(n,) for n in counts], "m bigint").select("m", _pairs_of("m").alias("p"))
    assert {int(r.m): int(r.p) for r in found.collect()} == {n: n * (n - 1) // 2 for n in counts}
    assert int(found.agg(F.sum("p")).first()[0]) == sum(n * (n - 1) // 2 for n in counts)


def test_candidate_counts(spark, scratch):
    rows = planted(200, 9, 40) | {1000 + i: 77 for i in range(10)}
    parts = lambda h: [(h >> s) & 0xFFFF for s in (48, 32, 16, 0)]
    items = sorted(rows.items())
    candidates = [
        (a, b) for i, (a, x) in enumerate(items) for b, y in items[i + 1 :]
        if any(p == q for p, q in zip(parts(x), parts(y)))
    ]
    found = candidate_counts(images(spark, rows), block_values(F.col("phash"), 4), 3, scratch).first()
    assert tuple(found) == (len(candidates), len(pairs(rows, 3)))


@pytest.mark.parametrize(
    "form, threshold", [("broadcast", 80), ("broadcast", 100), ("shuffled", 90), ("rekeyed", 95), ("tiled", 90)]
)
def test_incremental_equals_full(spark, scratch, form, threshold):
    rows = planted(200, threshold + 1, 24)
    rng = random.Random(threshold)
    new = {i for i in rows if rng.random() < 0.3}
    old = cluster(images(spark, {i: h for i, h in rows.items() if i not in new}), threshold, scratch)
    pending = images(spark, {i: rows[i] for i in new}).withColumn("group_id", F.lit(None).cast("bigint"))
    found = cluster_incremental(scratch.keep(old, "old"), pending, threshold, scratch, FORMS[form])
    assert {r.image_id: r.group_id for r in found.collect()} == groups(rows, max_distance(threshold))


def test_regroup_equals_full(spark, scratch):
    rows = planted(200, 21, 24)
    state = scratch.keep(cluster(images(spark, rows), 90, scratch), "state")
    rng = random.Random(1)
    gone = {i for i in rows if rng.random() < 0.1}
    moved = {i: signed(rng.getrandbits(24)) for i in rows if i not in gone and rng.random() < 0.1}
    added = {1000 + i: signed(rng.getrandbits(24)) for i in range(10)}
    changed = images(spark, moved | added).withColumn("group_id", F.lit(None).cast("bigint"))
    lost = state.where(F.col("image_id").isin(gone | set(moved)))
    rest = state.where(~F.col("image_id").isin(gone | set(moved)))
    found = regroup(rest, lost.select("group_id"), changed, 90, scratch)
    want = {i: h for i, h in rows.items() if i not in gone} | moved | added
    assert {r.image_id: r.group_id for r in found.collect()} == groups(want, 6)


def test_new_neighbours(spark, scratch):
    rows = planted(150, 31, 24)
    new = {i: h for i, h in rows.items() if i % 4 == 0}
    old = {i: h for i, h in rows.items() if i % 4}
    state = scratch.keep(cluster(images(spark, old), 90, scratch), "state")
    label = {r.image_id: r.group_id for r in state.collect()}
    found = [tuple(r) for r in new_neighbours(state, images(spark, new), 90, scratch).collect()]
    want = {
        (a, label[b]) for a, x in new.items() for b, y in old.items() if ((x ^ y) & (2**64 - 1)).bit_count() <= 6
    }
    assert len(found) == len(set(found)) and set(found) == want


def test_distinct_hashes(spark):
    found = distinct_hashes(images(spark, {3: 9, 1: 9, 2: 4}))
    assert {tuple(r) for r in found.collect()} == {(9, 1, 2), (4, 2, 1)}


def test_probes_are_not_broadcast(spark):
    """137 probes for each of up to 65,536 parts never pass the driver, only parts and counts do."""
    found = entry_queries.similarity.QUERIES["probe_neighbours"][0](spark, "/root/testdata/sf0.01")
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [line for line in lines if "BroadcastHashJoin" in line]
    assert len(joins) == 2 and all("BuildRight" in line for line in joins)


def test_registered_forms_are_entered(spark, monkeypatch):
    entered = set()

    def spy(name, label=lambda args: ""):
        real = getattr(similarity, name)

        def call(*args):
            entered.add(name + label(args))
            return real(*args)

        monkeypatch.setattr(similarity, name, call)

    spy("_search_keyed", lambda args: f"{len(args[1])}")
    spy("_tiles", lambda args: f"{len(args[2])}")
    spy("choose_radii")
    want = {
        "similar_pairs_90_shuffled": {"_search_keyed1"},
        "similar_pairs_90_tiled": {"_search_keyed1", "_tiles1"},
        "similar_pairs_90_listed": {"_search_keyed1", "_tiles1"},
        "similar_pairs_90_rekeyed": {"_search_keyed1", "_search_keyed2", "_tiles2"},
        "components_80_tiled": {"_search_keyed1", "_tiles1"},
        "similar_pairs_80_radii": {"choose_radii", "_search_keyed1"},
        "similar_pairs_80_radii_tiled": {"choose_radii", "_tiles1"},
        "components_80_radii": {"choose_radii", "_tiles1"},
    }
    for name, forms in want.items():
        entered.clear()
        entry_queries.similarity.QUERIES[name][0](spark, "/root/testdata/sf0.01")
        assert forms <= entered, (name, entered)
