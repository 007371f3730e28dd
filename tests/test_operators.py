import hashlib
import random
import re
from collections import Counter

import pytest
from brute import labels
from pyspark.sql import functions as F

from kindred.functions.bits import block_values, hash_parts, probe_values
from kindred.functions.text_hash import hash_texts
from kindred.functions.vector_hash import hash_vectors, hex_hash
from kindred.operators import snapshot_diff as diff
from kindred.operators.clustering import init_groups, merge_groups
from kindred.operators.components import connected_components
from kindred.operators.grouping import group_members, group_summary
from kindred.operators.numbering import assign_ids, number_rows
from kindred.operators.skew import join_unique
from kindred.operators.spreading import even_partitions
from kindred.plans.key_schemes import signed
from kindred.sources.listing import IMAGE_EXTENSIONS, extension, is_image


def test_parts_round_trip(spark):
    values = [0, -1, 1, signed(1 << 63), signed(0x0123456789ABCDEF), 2**63 - 1]
    rows = hash_parts(spark.createDataFrame([(v,) for v in values], "phash bigint")).collect()
    for row in rows:
        bits = row.phash & (2**64 - 1)
        assert (row.p16_0 << 48) | (row.p16_1 << 32) | (row.p16_2 << 16) | row.p16_3 == bits
        assert (row.p21_0 << 43) | (row.p21_1 << 22) | row.p21_2 == bits
    assert spark.createDataFrame([(-1,)], "h bigint").select(*block_values(F.col("h"), 1)).first()[0] == -1


def test_probe_values(spark):
    rows = probe_values(spark.createDataFrame([(5,)], "part bigint"), "part", 4, 1).select("probe").collect()
    assert {r.probe for r in rows} == {5, 4, 7, 1, 13}
    assert probe_values(spark.range(1).select(F.col("id").alias("part")), "part", 16, 3).count() == 697


def test_vector_hash(spark):
    rng = random.Random(2)
    good = [rng.gauss(0, 1) for _ in range(64)]
    cut = sorted(good[1:])[31]
    want = signed(sum(1 << (63 - i) for i, x in enumerate(good) if x >= cut))
    rows = [
        (1, good), (2, [x * 3 for x in good]), (3, [0.0] * 64), (4, None), (5, [1.0] * 63),
        (6, good[:9] + [None] + good[10:]), (7, [None] + good[1:]), (8, good[:9] + [float("nan")] + good[10:]),
    ]
    found = hash_vectors(spark.createDataFrame(rows, "i int, e array<double>"), "e").orderBy("i").collect()
    assert [r.phash for r in found] == [want, want, -1, None, None, None, None, None]
    assert [r.error for r in found[:3]] == [None] * 3
    assert [r.error for r in found[3:]] == ["no vector", "expected 64 values, found 63"] + [
        "value missing or not a number"] * 3
    top = spark.createDataFrame([(-1,), (1,)], "h bigint").select(hex_hash(F.col("h"))).collect()
    assert [r[0] for r in top] == ["F" * 16, "0" * 15 + "1"]


def plain_simhash(text):
    tokens = [t for t in re.split("[ \n\t]+", text.lower()) if t]
    grams = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or [" ".join(tokens)]
    values = [int(hashlib.md5(g.encode()).hexdigest()[:16], 16) for g in grams]
    return signed(sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in values) >= len(values)))


def test_text_hash(spark):
    rng = random.Random(4)
    words = ["eine", "Öl", "naïve", "x", "12", "de", "STRASSE", "中文"]
    texts = ["", " \n\t", "one", "One  two", "a b c", "a b c d", "tab\tline\nend", "z " * 5000]
    texts += [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 4, 17, 400, 3000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "one two"), (3, "one two"), (None, "a b c"), (99, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    df = df.withColumns({"phash": F.lit("p"), "_n": F.lit(0), "_h": F.lit(0)})
    found = hash_texts(df, "text", ["id"])
    assert found.columns == ["id", "phash", "error"]
    want = Counter((i, None if t is None else plain_simhash(t), "no text" if t is None else None) for i, t in rows)
    assert Counter(map(tuple, found.collect())) == want
    assert hash_texts(df.limit(0), "text", ["id"]).count() == 0
    plan = hash_texts(df, "text", ["id"])._jdf.queryExecution().sparkPlan().toString()
    assert "Python" not in plan and "collect_list" not in plan


def test_extensions(spark):
    cases = {
        "/a/b.JPG": ".jpg", "/a/.jpg": "", "/a/b.c.png": ".png", "/a/b": "", "/a.d/b": "", "/a/b.": "",
        "/a/..png": ".png", "b.HeIc": ".heic", "/v/film.mp4": ".mp4",
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    found = {r.path: (r.ext, r.ok) for r in df.select("path", extension(F.col("path")).alias("ext"), is_image(F.col("path")).alias("ok")).collect()}
    assert found == {p: (e, e in IMAGE_EXTENSIONS) for p, e in cases.items()}
    assert len(IMAGE_EXTENSIONS) == 12


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_components(spark, scratch, hot_rows):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)]  # a chain
    links += [(500, i) for i in range(501, 560)] + [(i, 500) for i in range(560, 600)]  # a hub
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    links += [(7, 7)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r.node: r.root for r in connected_components(df, scratch, hot_rows=hot_rows).collect()}
    want = labels({n for link in links for n in link}, links)
    assert found == {n: r for n, r in want.items() if n != r}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_unique_splits_hot_keys(spark, scratch, how):
    left = spark.createDataFrame([(i % 7 and 1, i) for i in range(100)] + [(None, 200), (9, 201)], "k bigint, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k bigint, w string")
    plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    split = join_unique(left, right, "k", how, scratch, hot_rows=20)
    assert sorted(map(tuple, split.collect()), key=str) == plain


def test_numbers_follow_the_order(spark, scratch):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    found = number_rows(df, ["v"], "n", scratch, after=10).collect()
    assert {r.v: r.n for r in found} == {v: v + 11 for v in range(1000)}
    state = spark.createDataFrame([(41, "/b")], "image_id bigint, path string")
    new = spark.createDataFrame([("/c",), ("/a",)], "path string")
    assert {tuple(r) for r in assign_ids(new, state, scratch).select("path", "image_id").collect()} == {("/a", 42), ("/c", 43)}
    assert assign_ids(new.limit(0), state, scratch).count() == 0


def test_even_partitions(spark, scratch):
    rng = random.Random(6)
    rows = [(f"/p{k:05d}", int(10 ** rng.uniform(1, 5))) for k in range(5000)]
    df = spark.createDataFrame(rows, "path string, size bigint").repartition(7)
    found = even_partitions(df, F.col("size"), ["path"], 16, scratch)
    assert found.columns == ["path", "size"] and {tuple(r) for r in found.collect()} == set(rows)
    sums = [r[0] for r in found.groupBy(F.spark_partition_id()).agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sums) == 16 and max(sums) < 2 * sorted(sums)[8]
    one = even_partitions(spark.createDataFrame([("a", 0), ("b", 1 << 60), ("c", 5)], "path string, size bigint"), F.col("size"), ["path"], 3, scratch)
    assert one.count() == 3 and even_partitions(df.limit(0), F.col("size"), ["path"], 4, scratch).count() == 0


def test_group_members(spark, scratch):
    rows = [(1, "/b", 1), (2, "/a", 1), (3, "/c", 3), (4, "/z", 4), (5, "/y", 4), (6, "/x", 4)]
    df = spark.createDataFrame(rows, "image_id bigint, path string, group_id bigint")
    found = group_members(df, scratch).orderBy("id", "path").select("id", "size", "path").collect()
    assert [tuple(r) for r in found] == [(1, 2, "/a"), (1, 2, "/b"), (2, 3, "/x"), (2, 3, "/y"), (2, 3, "/z")]
    assert tuple(group_summary(df).first()) == (2, 5, 3)
    assert tuple(group_summary(df.limit(0)).first()) == (0, 0, 0)


def test_group_updates(spark, scratch):
    state = spark.createDataFrame(
        [(1, "/a", 1), (2, "/b", 1), (3, "/c", 3), (4, "/d", None), (5, "/e", None)],
        "image_id bigint, path string, group_id bigint",
    )
    new = spark.createDataFrame([("/c",), ("/d",)], "path string")
    assert {r.image_id: r.group_id for r in init_groups(state, new).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: None}
    moves = spark.createDataFrame([(3, 1), (1, 1)], "old bigint, new bigint")
    assert {r.image_id: r.group_id for r in merge_groups(state, moves, scratch).collect()} == {
        1: 1, 2: 1, 3: 1, 4: None, 5: None}


STATE = "image_id bigint, path string, size bigint, modified_ns bigint, phash bigint, group_id bigint"
LISTING = "path string, size bigint, modified_ns bigint"


def test_snapshot_difference(spark):
    state = spark.createDataFrame(
        [(1, "/same", 5, 5, 9, 1), (2, "/size", 5, 5, 9, 1), (3, "/time", 5, 5, 9, 1), (4, "/gone", 5, 5, 9, 1)], STATE
    )
    listing = spark.createDataFrame([("/same", 5, 5), ("/size", 6, 5), ("/time", 5, 6), ("/new", 1, 1)], LISTING)
    actions = diff.diff_snapshots(state, listing)
    assert {r.path: r.action for r in actions.collect()} == {
        "/same": "unchanged", "/size": "modified", "/time": "modified", "/gone": "removed", "/new": "new"}
    names = lambda df: sorted(r.path for r in df.collect())
    assert names(diff.new_files(state, listing)) == ["/new"]
    assert names(diff.modified_files(state, listing)) == ["/size", "/time"]
    assert names(diff.files_to_hash(state, listing)) == ["/new", "/size", "/time"]
    assert names(diff.removed_files(state, listing)) == ["/gone"]
    hashed = spark.createDataFrame([("/new", 1, None), ("/size", None, None)], "path string, phash bigint, error string")
    assert names(diff.stale_paths(diff.removed_files(state, listing), diff.unreadable(hashed))) == ["/gone", "/size"]
    assert names(diff.hashed_new_paths(diff.new_files(state, listing), hashed)) == ["/new"]
    assert diff.unreadable(hashed).first().error == "Error desconocido"


def test_rebuild_decision(spark):
    state = spark.createDataFrame([(1, "/a", 5, 5, 9, 1)], STATE)
    same = spark.createDataFrame([("/a", 5, 5)], LISTING)
    decide = lambda s, f, saved, now: tuple(diff.rebuild_decision(diff.diff_snapshots(s, f), saved, now).first())
    assert decide(state, same, 90, 90) == (False, False, False, False, False)
    assert decide(state, same, 95, 90) == (False, False, True, False, True)
    assert decide(state, same, None, 90)[4] is True
    assert decide(state, spark.createDataFrame([("/a", 5, 6)], LISTING), 90, 90) == (True, False, False, False, True)
    assert decide(state, same.limit(0), 90, 90) == (False, True, False, False, True)
    unlabelled = state.withColumn("group_id", F.lit(None).cast("bigint"))
    assert decide(unlabelled, same, 90, 90) == (False, False, False, True, True)
