import hashlib
from collections import Counter

import numpy as np
import pytest

from kindred.llm import substring_dedup
from kindred.llm.fm_index import FMIndex, repeated_windows
from kindred.llm.substring_dedup import drop_repeated_substrings, repeated_substrings
from tests.llm.cases import documents, frame, prose


def brute(rows, window):
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    often = Counter(b" ".join(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for doc_id, words in texts:
        gone = set()
        for i in range(len(words) - window + 1):
            if often[b" ".join(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def passages():
    """One passage in many documents between different words, and overlapping copies."""
    shared, other = prose(70, 90), prose(71, 50)
    rows = [(k, f"{prose(100 + k, 20 + k % 30)} {shared} {prose(300 + k, 10 + k % 40)}", "en", "s", 0) for k in range(60)]
    rows += [(60 + k, f"{' '.join(shared.split()[k:])} {other} {' '.join(shared.split()[: 50 + k])}", "en", "s", 0) for k in range(25)]
    return rows


@pytest.mark.parametrize("make", [documents, passages])
@pytest.mark.parametrize("shard_tokens, hot_regions", [(400_000, 20_000), (300, 6)])
def test_substrings_match_brute_force(spark, scratch, make, shard_tokens, hot_regions):
    rows = make()
    found = repeated_substrings(frame(spark, rows), scratch, shard_tokens=shard_tokens, hot_regions=hot_regions)
    assert Counter(map(tuple, found.collect())) == Counter(r[:4] for r in brute(rows, 35))


def test_many_partitions_split_an_anchor(spark, scratch):
    rows = passages()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        found = repeated_substrings(frame(spark, rows), scratch).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(map(tuple, found)) == Counter(r[:4] for r in brute(rows, 35))


def test_rows_keep_their_columns(spark, scratch):
    given = frame(spark)
    kept = drop_repeated_substrings(given, scratch)
    assert kept.columns == given.columns
    want = Counter((r[0], r[4]) for r in brute(documents(), 35))
    got = [(r["doc_id"], (r["text"] or "").encode().split()) for r in kept.collect()]
    assert Counter((i, b" ".join(w).decode()) for i, w in got) == want
    assert drop_repeated_substrings(frame(spark, []), scratch).count() == 0


def test_windows_by_backward_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        window, base, parts = int(rng.integers(1, 9)), rng.integers(1, 6, 400), []
        for _ in range(int(rng.integers(2, 30))):
            a = int(rng.integers(0, 380))
            part = base[a : a + int(rng.integers(1, 60))].copy()
            part[rng.integers(0, len(part))] = rng.integers(1, 9)
            parts.append(np.append(part, 0))
        text = np.concatenate(parts)
        ends = np.flatnonzero(text == 0)
        starts = np.concatenate(([0], ends[:-1] + 1))
        got = repeated_windows(FMIndex(text), text, starts, ends - window, window)
        slices = [tuple(text[i : i + window]) for i in range(len(text) - window + 1)]
        often = Counter(s for s in slices if 0 not in s)
        want = [often[s] > 1 for s in slices] + [False] * (window - 1)
        assert got.tolist() == want


def test_rows_without_id_are_told_apart(spark, scratch):
    """A clean text keeps its words beside others of the same (missing or repeated) id."""
    passage = prose(80, 40)
    for doc_id in (None, 5):
        rows = [(doc_id, f"{prose(500 + k, 30)} {passage if k % 2 else prose(700 + k, 40)}", "en", "s", 0) for k in range(200)]
        rows += [(doc_id, rows[0][1], "en", "s", 0)]
        found = repeated_substrings(frame(spark, rows), scratch)
        assert Counter(map(tuple, found.collect())) == Counter(r[:4] for r in brute(rows, 35))


def test_equal_rows_without_id(spark, scratch):
    """Equal rows are independent: each meets its own spans only."""
    rows = [(None, prose(81, 120), "en", "s", 0)] * 1000 + [(1, prose(82, 120), "en", "s", 0)]
    found = repeated_substrings(frame(spark, rows), scratch)
    assert Counter(map(tuple, found.collect())) == Counter(r[:4] for r in brute(rows, 35))


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_a_passage_of_a_third_of_the_documents(spark, scratch, hot_rows):
    """Its anchors are hot: windows are counted, and the hot ones joined apart."""
    shared = prose(83, 80)
    rows = [(k, f"{prose(1000 + k, 25)} {shared if k % 3 == 0 else ''} {prose(2000 + k, 25)}", "en", "s", 0) for k in range(300)]
    found = repeated_substrings(frame(spark, rows), scratch, hot_regions=3, hot_rows=hot_rows)
    assert Counter(map(tuple, found.collect())) == Counter(r[:4] for r in brute(rows, 35))


def test_long_texts_are_read_in_stretches(spark, scratch, monkeypatch):
    monkeypatch.setattr(substring_dedup, "STRETCH_WORDS", 50)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 900)
    rows = documents() + passages()
    found = repeated_substrings(frame(spark, rows), scratch)
    assert Counter(map(tuple, found.collect())) == Counter(r[:4] for r in brute(rows, 35))


def test_columns_that_forbid_nulls(spark, scratch):
    schema = "doc_id long not null, text string not null, n_chars long not null"
    rows = [(k, r[1] or "") for k, r in enumerate(passages()[:20])]
    given = spark.createDataFrame([(*r, 1) for r in rows], schema)
    found = repeated_substrings(given, scratch)
    assert Counter(map(tuple, found.collect())) == Counter(r[:4] for r in brute(rows, 35))
    assert drop_repeated_substrings(given, scratch).count() == 20


def near_copies(n):
    """A passage with one word of its own in each of ``n`` documents, at one of 40 places."""
    rows = []
    for k in range(n):
        shared = prose(84, 80).split()
        shared[2 * (k % 40)] = f"own{k}"
        rows.append((k, f"{prose(3000 + k, 25)} {' '.join(shared)} {prose(4000 + k, 25)}", "en", "s", 0))
    return rows


def test_windows_of_near_copies_do_not_grow_with_their_number(spark, scratch, monkeypatch):
    made, keep = [], scratch.keep

    def kept(df, name):
        out = keep(df, name)
        if name == "windows":
            made.append(out.count())
        return out

    monkeypatch.setattr(scratch, "keep", kept)
    for n in (120, 480):
        rows = near_copies(n)
        found = repeated_substrings(frame(spark, rows), scratch, hot_regions=3)
        assert Counter(map(tuple, found.collect())) == Counter(r[:4] for r in brute(rows, 35))
    assert 0 < made[1] < 2 * made[0], made


@pytest.mark.parametrize("partitions", ["1", "8", "61"])
def test_hot_anchors_of_repeated_words(spark, scratch, partitions):
    """Anchors that occur several times in a region, few different words, texts of one window."""
    rng = np.random.default_rng(5)
    texts = ["d " * n for n in (34, 35, 36, 60, 61)] + ["d e " * n for n in (17, 18, 40)]
    for _ in range(120):
        words = np.array(["d", "e", "ü"])[rng.choice(3, rng.integers(35, 90), p=[0.93, 0.05, 0.02])]
        texts.append(" ".join(words))
    rows = [(k, text, "en", "s", 0) for k, text in enumerate(texts)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = repeated_substrings(frame(spark, rows), scratch, hot_regions=1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(map(tuple, found)) == Counter(r[:4] for r in brute(rows, 35))
