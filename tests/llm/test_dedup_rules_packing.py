import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from kindred.llm import simhash_links
from kindred.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from kindred.llm.packing import WordIds, best_filling, best_fit_packing, lower_bound, packing_plan
from kindred.llm.quality_rules import FIRST_ACCURACIES, FIRST_GOOD, RULES, estimate, good_documents, quality_rules
from kindred.llm.simhash_links import (
    covering_triples,
    drop_near_duplicates,
    fingerprint,
    near_duplicates,
    similar_prints,
)
from tests.llm.cases import SCHEMA, documents, frame

WHITE = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(WHITE, text or "") if w]


# --- exact dedup -------------------------------------------------------------


@pytest.mark.parametrize("chunk_bytes, memory", [(1 << 20, 1 << 20), (200, 3000)])
def test_exact_duplicates_match_brute_force(spark, scratch, chunk_bytes, memory):
    rows = documents()
    groups = defaultdict(list)
    for row in rows:
        groups[re.sub(WHITE, " ", row[1] or "")].append(row[0])
    want = Counter()
    for norm, ids in groups.items():
        known = sorted(x for x in ids if x is not None)
        keep = known[0] if known else None
        digest = hashlib.sha256(norm.encode()).hexdigest()
        left = True
        for x in sorted(ids, key=lambda x: (x is None, x)):
            want[x, keep, len(ids), left, digest] += 1
            left = False
    found = exact_duplicates(frame(spark), scratch, chunk_bytes=chunk_bytes, memory=memory)
    assert Counter(map(tuple, found.collect())) == want
    kept = drop_exact_duplicates(frame(spark), scratch, chunk_bytes=chunk_bytes, memory=memory)
    assert kept.columns == frame(spark).columns
    got = Counter((r["doc_id"], re.sub(WHITE, " ", r["text"] or "")) for r in kept.collect())
    assert got == Counter(
        (min((x for x in ids if x is not None), default=None), norm) for norm, ids in groups.items()
    )


def test_exact_duplicates_of_nothing(spark, scratch):
    empty = frame(spark, [])
    assert exact_duplicates(empty, scratch).count() == 0
    assert drop_exact_duplicates(empty, scratch).count() == 0


# --- quality rules -----------------------------------------------------------


def base_of(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words),
    )


def test_base_statistics_match_brute_force(spark, scratch):
    found = quality_rules(frame(spark), scratch)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r["doc_id"], *[r[n] for n in names]) for r in found.collect())
    assert got == Counter((row[0], *base_of(row[1])) for row in documents())
    assert not found.where("base_failed and kept").count()


def test_rules_tell_quality(spark, scratch):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_rules(docs, scratch).join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    good = [r for r in found if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in found if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.95 * len(bad)


def test_good_documents_keep_all_columns(spark, scratch):
    given = frame(spark)
    kept = good_documents(given, scratch)
    assert kept.columns == given.columns
    want = quality_rules(given, scratch).where("kept").select("doc_id").collect()
    assert Counter(r[0] for r in kept.select("doc_id").collect()) == Counter(r[0] for r in want)
    assert good_documents(frame(spark, []), scratch).count() == 0


def test_rounds_of_the_estimate_are_one_plan(spark):
    """Every round used to be planned and compiled anew by the driver, which filled its memory."""
    votes = [tuple((i // 3**k) % 3 - 1 for k in range(len(RULES))) + (i % 7 + 1,) for i in range(0, 3 ** len(RULES), 5)]
    patterns = spark.createDataFrame(votes, ", ".join(f"vote_{rule} int" for rule in RULES) + ", n bigint")
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for rounds in (1, 12):
        spark.sparkContext.setJobGroup(f"estimate {rounds}", "")
        found = estimate(patterns, rounds)
        jobs[rounds] = len(tracker.getJobIdsForGroup(f"estimate {rounds}"))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[12] == jobs[1]
    assert found != estimate(patterns, 1)
    first = dict.fromkeys(RULES, FIRST_ACCURACIES) | {"good": FIRST_GOOD}
    assert estimate(patterns, 0) == estimate(patterns.limit(0)) == first


# --- SimHash -----------------------------------------------------------------


def brute_print(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def components_of(prints):
    """Per row: a name of its component, from links between all rows."""
    first = {}
    for k, p in enumerate(prints):
        first.setdefault(p, k)
    links = [(first[p], first[q]) for p, q in combinations(first, 2) if (p ^ q).bit_count() <= 4]
    root = roots(links, first.values())
    return [root[first[p]] for p in prints]


def kept_rows(rows, prints):
    """One row per component: smallest id, null last; then fingerprint and hash of the text."""
    best = {}
    for r, p, c in zip(rows, prints, components_of(prints), strict=True):
        signed = p - (p >> 63 << 64)
        h = xxhash.xxh64_intdigest((r[1] or "").encode(), 42) if r[1] is not None else 42
        key = (r[0] is None, r[0] or 0, signed, h - (h >> 63 << 64))
        best[c] = min(best.get(c, (key, r)), (key, r), key=lambda x: x[0])
    return [r for _, r in best.values()]


def test_near_duplicates_match_brute_force(spark, scratch):
    rows = documents()
    prints = [brute_print(r[1]) for r in rows]
    assert all(fingerprint((r[1] or "").encode()) == p for r, p in zip(rows, prints))
    names = components_of(prints)
    least = {}
    for r, c in zip(rows, names):
        if r[0] is not None:
            least[c] = min(r[0], least.get(c, r[0]))
    assert len(set(names)) < len(set(prints))
    for hot_rows in (1_000_000, 5):
        found = near_duplicates(frame(spark), scratch, hot_rows=hot_rows)
        got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found.collect())
        assert got == Counter((r[0], p, least.get(c)) for r, p, c in zip(rows, prints, names))
    kept = drop_near_duplicates(frame(spark), scratch)
    assert kept.columns == frame(spark).columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((r[0], r[1]) for r in kept_rows(rows, prints))
    assert near_duplicates(frame(spark, []), scratch).count() == 0 == drop_near_duplicates(frame(spark, []), scratch).count()


def test_rows_without_id_link_and_ids_do_not_stand_for_rows(spark, scratch, monkeypatch):
    monkeypatch.setattr(simhash_links, "fingerprint", lambda text: int(text.split()[0]))
    rows = [(1, "0"), (None, "15"), (2, "255"), (None, "1048575"), (3, "9223372036854775808"), (None, "72057589742960640")]
    given = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    found = {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in near_duplicates(given, scratch).collect()}
    assert found == {(1, 0): 1, (None, 15): 1, (2, 255): 1, (None, 1048575): None, (3, 1 << 63): 1, (None, 72057589742960640): None}
    # the copy under another id does not take that id's other text along
    rows = [(3, "1023 A"), (5, "1023 A"), (5, "68719476735 B"), (None, "1023 A"), (None, "4503599627370495 C")]
    given = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    kept = drop_near_duplicates(given, scratch)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([rows[0], rows[2], rows[4]])


def test_triples_cover_every_four_positions():
    triples = [set(t) for t in covering_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


@pytest.mark.parametrize("list_limit", [8192, 40, 5])
def test_links_connect_all_within_distance(spark, scratch, list_limit):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = list(base)
    for p in base[:20]:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            prints.append(p ^ np.uint64(sum(1 << int(k) for k in flips)))
    prints += [np.uint64(k) for k in range(120)]
    prints = sorted({int(p) for p in prints})
    rows = [(k, int(np.uint64(p).astype(np.int64))) for k, p in enumerate(prints)]
    links = similar_prints(spark.createDataFrame(rows, "node long, fp long"), scratch, list_limit=list_limit).collect()
    true = {(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4}
    got = {(min(r), max(r)) for r in links}
    assert got <= true
    assert roots(got, range(len(prints))) == roots(true, range(len(prints)))


# --- packing -----------------------------------------------------------------


def test_packing_matches_the_tokenizer(spark, scratch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    capacity = 512
    want = Counter()
    for row in documents():
        ids = [*plain.encode(row[1] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[row[0], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = best_fit_packing(frame(spark), scratch, path, capacity=capacity).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // capacity) + 1
    assert best_fit_packing(frame(spark, []), scratch, path).count() == 0


def test_remembered_words_take_little_memory(monkeypatch):
    import gc
    import tracemalloc

    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    from kindred.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [" ".join(f"w{n:x}" for n in range(at, at + 500)) for at in range(0, 40_000, 500)] + ["", " a  a\x00b ", "w1f w1f"]
    want = [plain.encode(x, add_special_tokens=False).ids for x in texts]

    def held_after(at_once: int) -> int:
        known = WordIds(path)
        gc.collect()
        tracemalloc.start()
        before = pa.total_allocated_bytes()
        for at in range(0, len(texts), at_once):
            ids, sizes = known.of_texts(pa.array(texts[at : at + at_once], pa.string()))
            assert ids.tolist() == [x for own in want[at : at + at_once] for x in own]
            assert sizes.tolist() == [len(own) for own in want[at : at + at_once]]
            del ids, sizes
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
        tracemalloc.stop()
        return held

    assert held_after(10) < 64 * 40_000
    # Forgotten words are learnt again; many bytes of words are forgotten like many words.
    monkeypatch.setattr(packing, "KNOWN_BYTES", 30_000)
    assert held_after(1) < 200_000
    monkeypatch.setattr(packing, "KNOWN_BYTES", 1 << 20)
    monkeypatch.setattr(packing, "KNOWN_WORDS", 700)
    assert held_after(1) < 200_000


def test_best_filling_wastes_least():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = sorted(rng.choice(np.arange(1, 40), 6, replace=False).tolist())
        counts = {x: int(rng.integers(1, 4)) for x in lengths}
        room = int(rng.integers(1, 90))
        sums = {0}
        for x in lengths:
            sums = {s + k * x for s in sums for k in range(counts[x] + 1) if s + k * x <= room}
        assert sum(x * k for x, k in best_filling(lengths, counts, room, 10**6)) == max(sums)


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(6)
    counts = {int(x): int(n) for x, n in zip(rng.integers(1, 101, 60), rng.integers(1, 900, 60), strict=True)}
    plan = packing_plan(counts, 100)
    filled = defaultdict(list)
    for length, n in counts.items():
        first, k, sequence, offset = plan[length]
        number = np.arange(n)
        row = np.searchsorted(first, number, "right") - 1
        step = number - first[row]
        for s, o in zip(sequence[row] + step // k[row], offset[row] + step % k[row] * length, strict=True):
            filled[int(s)].append((int(o), length))
    for parts in filled.values():
        ends = 0
        for o, length in sorted(parts):
            assert o == ends
            ends += length
        assert ends <= 100
    bound = 0  # pieces above 100 - t stand alone, those up to t are put aside
    for t in range(51):
        alone = sum(n for x, n in counts.items() if x > 50)
        room = sum(n * (100 - x) for x, n in counts.items() if 50 < x <= 100 - t)
        rest = sum(n * x for x, n in counts.items() if t <= x <= 50)
        bound = max(bound, alone + max(0, -(-(rest - room) // 100)))
    assert bound <= len(filled) <= 1.01 * bound


def sequences_of(counts, capacity):
    plan = packing_plan(counts, capacity)
    filled = Counter()
    for length, n in counts.items():
        first, k, sequence, _ = plan[length]
        row = np.searchsorted(first, np.arange(n), "right") - 1
        for s in (sequence[row] + (np.arange(n) - first[row]) // k[row]).tolist():
            filled[s] += length
    assert max(filled.values()) <= capacity
    return len(filled)


def test_plan_goes_back_to_other_fillings():
    counts = {2457: 1000, 2253: 2000, 1597: 1000, 1024: 2000, 819: 2000}
    assert lower_bound(counts, 4096) == sequences_of(counts, 4096) == 3000


def test_plan_is_the_least_of_small_tables():
    rng = np.random.default_rng(8)

    def least(left, capacity, rooms=()):
        """Sequences by trying every place of every piece."""
        if not left:
            return len(rooms)
        x, rest = left[0], left[1:]
        places = {r for r in rooms if r >= x}
        tries = [least(rest, capacity, (*(rooms[: rooms.index(r)]), r - x, *rooms[rooms.index(r) + 1 :])) for r in places]
        return min([*tries, least(rest, capacity, (*rooms, capacity - x))])

    for _ in range(30):
        pieces = sorted(rng.integers(8, 60, 7).tolist(), reverse=True)
        assert sequences_of(dict(Counter(pieces)), 100) == least(pieces, 100)


def test_search_for_a_plan_ends_in_time():
    """Lengths at which the bound is not met: the search stops, and every piece has its place."""
    rng = np.random.default_rng(9)
    lengths = Counter(rng.integers(300, 2600, 20_000).tolist())
    start = time.monotonic()
    plan = packing_plan(dict(lengths), seconds=5.0)
    assert time.monotonic() - start < 60
    used = 0
    for length, (first, k, sequence, _) in plan.items():
        upto = np.append(first[1:], lengths[length])
        used = max(used, int((sequence + -(-(upto - first) // k)).max()))
    assert lower_bound(dict(lengths), 4096) <= used <= 1.06 * lower_bound(dict(lengths), 4096)
