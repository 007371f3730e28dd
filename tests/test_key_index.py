import json
import random

import pytest
from brute import groups
from pyspark.sql import functions as F
from test_similarity import images, planted

from kindred.operators.clustering import cluster, cluster_incremental, new_neighbours, regroup
from kindred.plans.key_schemes import signed
from kindred.plans.thresholds import max_distance
from kindred.sources.key_index import IndexInfo, KeyIndex, scratch_index
from kindred.sources.scratch import Scratch

NO_GROUP = "cast(null as bigint)"


def near(x, y, k):
    return ((x ^ y) & (2**64 - 1)).bit_count() <= k


def split(rows, seed, share=0.3):
    rng = random.Random(seed)
    new = {i: h for i, h in rows.items() if rng.random() < share}
    return {i: h for i, h in rows.items() if i not in new}, new


def indexed(spark, scratch, old, threshold, **options):
    state = scratch.keep(cluster(images(spark, old), threshold, scratch), "state")
    return state, scratch_index(scratch.keep(state.select("phash").distinct(), "stored"), max_distance(threshold), scratch, **options)


@pytest.mark.parametrize("threshold, options, lookup_rows", [
    (80, {}, 2_000_000), (90, {"hot_rows": 3, "bucket_rows": 200}, 2_000_000), (95, {"hot_rows": 1, "bucket_rows": 50}, 0),
])
def test_indexed_incremental_equals_full(spark, scratch, threshold, options, lookup_rows):
    rows = planted(200, threshold + 1, 24)
    old, new = split(rows, threshold)
    state, index = indexed(spark, scratch, old, threshold, **options)
    pending = images(spark, new).withColumn("group_id", F.expr(NO_GROUP))
    found = cluster_incremental(state, pending, threshold, scratch, index=index, lookup_rows=lookup_rows)
    assert {r.image_id: r.group_id for r in found.collect()} == groups(rows, max_distance(threshold))
    label = {r.image_id: r.group_id for r in state.collect()}
    k = max_distance(threshold)
    got = [tuple(r) for r in new_neighbours(state, pending, threshold, scratch, index=index, lookup_rows=lookup_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, label[b]) for a, x in new.items() for b, y in old.items() if near(x, y, k)}


def test_index_finds_every_stored_neighbour(spark, scratch):
    rows = planted(300, 5, 24)
    old, new = split(rows, 3)
    more = {i: h for i, h in new.items() if i % 2}
    stored = images(spark, old).select("phash").distinct()
    index = scratch_index(scratch.keep(stored, "stored"), 6, scratch, hot_rows=4, bucket_rows=50)
    index.add(images(spark, more).select("phash").distinct())
    index.add(images(spark, more).select("phash").distinct())  # a run that died and was repeated
    index.forget()
    again = KeyIndex(spark, IndexInfo(**json.loads(index.to_json())))  # as another session would open it
    asked = images(spark, new).select("phash").distinct()
    for distance in (3, 6):
        found = [tuple(r) for r in again.near(asked, distance).collect()]
        want = {(x, y) for x in new.values() for y in (*old.values(), *more.values()) if near(x, y, distance)}
        assert len(found) == len(set(found)) and set(found) == want
    with pytest.raises(ValueError):
        again.near(asked, 12)
    assert again.info.buckets > 8 and spark.read.parquet(f"{again.info.folder}/hot").count() > 0


def test_empty_index(spark, scratch):
    state, index = indexed(spark, scratch, {}, 90)
    pending = images(spark, {1: 5, 2: 4, 3: -1}).withColumn("group_id", F.expr(NO_GROUP))
    found = cluster_incremental(state.select("image_id", "phash", "group_id"), pending, 90, scratch, index=index)
    assert {r.image_id: r.group_id for r in found.collect()} == {1: 1, 2: 1, 3: 3}


def _subtrees(plan):
    """Shuffles of a plan with everything below each."""
    lines = [x for x in plan.split("\n") if x.strip()]
    depth = [len(x) - len(x.lstrip(" :+-|")) for x in lines]
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line or "Exchange RoundRobin" in line:
            below = []
            for k in range(i + 1, len(lines)):
                if depth[k] <= depth[i]:
                    break
                below.append(lines[k])
            yield line, below


def test_a_run_with_few_new_rows_moves_no_stored_row(spark, scratch, monkeypatch):
    """1% new rows: whatever reads the state or its keys is shuffled only behind a broadcast of a counted list."""
    rng = random.Random(8)
    rows = {i: signed(rng.getrandbits(64)) for i in range(20_000)}
    rows |= {30_000 + i: rows[i] ^ 1 for i in range(0, 20_000, 40)}
    new = {i: h for i, h in rows.items() if i % 100 == 7 or i >= 30_000 and i % 200 == 0}
    old = {i: h for i, h in rows.items() if i not in new}
    state, index = indexed(spark, scratch, old, 90)
    pending = scratch.keep(images(spark, new).withColumn("group_id", F.expr(NO_GROUP)), "pending")
    plans = []
    keep = Scratch.keep

    def watched(self, df, name):
        plans.append(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", watched)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = scratch.keep(cluster_incremental(state, pending, 90, scratch, index=index), "result")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    stored, keys = state._kindred_path, index._table
    assert any(stored in p for p in plans) and any(keys in p for p in plans)
    for plan in plans:
        for line, below in _subtrees(plan):
            at = [k for k, x in enumerate(below) if "Scan parquet" in x and (stored in x or keys in x)]
            for k in at:  # the shuffle is above a join that keeps what a broadcast list asks for, or a verified match
                between = "\n".join(below[:k])
                assert "BroadcastHashJoin" in between or "SortMergeJoin" in between, (line, below)
            # the shuffle nearest to a scan of the keys is none: they are read in their buckets
            assert not any(keys in x for x in below[:3]), (line, below)
    assert {r.image_id: r.group_id for r in found.collect()} == groups_by_links(rows)


def groups_by_links(rows):
    """Planted links only: other pairs of 20,000 random fingerprints are farther apart than 6 bits."""
    label = {i: i for i in rows}
    for i in rows:
        if i >= 30_000:
            label[i] = i - 30_000
    return label


def test_regroup_with_an_index_equals_full(spark, scratch):
    rows = planted(200, 21, 24)
    state, index = indexed(spark, scratch, rows, 90)
    rng = random.Random(1)
    gone = {i for i in rows if rng.random() < 0.1}
    moved = {i: signed(rng.getrandbits(24)) for i in rows if i not in gone and rng.random() < 0.1}
    changed = images(spark, moved | {1000 + i: signed(rng.getrandbits(24)) for i in range(10)})
    changed = scratch.keep(changed.withColumn("group_id", F.expr(NO_GROUP)), "changed")
    left = state.where(~F.col("image_id").isin(gone | set(moved)))
    lost = state.where(F.col("image_id").isin(gone | set(moved)))
    found = regroup(left, lost.select("group_id"), changed, 90, scratch, index=index)
    want = {i: h for i, h in rows.items() if i not in gone} | {r.image_id: r.phash for r in changed.collect()}
    assert {r.image_id: r.group_id for r in found.collect()} == groups(want, 6)
