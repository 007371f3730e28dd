"""The corpus pipeline against a plain version of every stage."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

import corpus_pipeline
from kindred.llm import quality_rules
from tests.llm.cases import SCHEMA, documents, prose
from tests.llm.test_dedup_rules_packing import WHITE, base_of, brute_print, kept_rows, words_of
from tests.llm.test_substring_dedup import brute


def votes_of(text):
    """Votes of all rules, in their order."""
    n, chars, symbols, dup_lines, repeats, _ = base_of(text)
    words = words_of(text)
    n_lines = sum(bool(words_of(x)) for x in (text or "").split("\n"))
    upper = len(re.findall("[A-Z]", text or ""))
    stop = sum(w in quality_rules.STOP_WORDS for w in words)
    marked = sum(w[-1] in "!?#*$%&|<>" for w in words)
    d = max(1, n)
    mean = chars / d
    tests = [
        (n >= 100, n < 50), (3 <= mean <= 9, not 2.5 <= mean <= 14), (symbols * 50 <= d, symbols * 8 > d),
        (marked * 20 <= d, marked * 4 > d), (upper * 8 <= chars, upper * 3 > chars), (stop * 12 >= d, stop * 50 < d),
        (repeats * 10 <= d, repeats * 3 > d), (n_lines >= 3 and dup_lines == 0, dup_lines * 3 > n_lines),
    ]
    return [-1 if bad else int(good) for good, bad in tests]


def posteriors(votes):
    """Expectation maximisation, document by document."""
    q = quality_rules
    right, good = np.tile(q.FIRST_ACCURACIES, (votes.shape[1], 1)), q.FIRST_GOOD

    def now():
        up = np.log(right[:, 0] / (1 - right[:, 1]))
        down = np.log((1 - right[:, 0]) / right[:, 1])
        odds = math.log(good / (1 - good)) + (votes > 0) @ up + (votes < 0) @ down
        return 1 / (1 + np.exp(-odds))

    for _ in range(q.ROUNDS):
        p = now()
        good = min(max((p.sum() + 1) / (len(p) + 2), 0.01), 0.99)
        for k in range(votes.shape[1]):
            v = votes[:, k]
            a = (p[v > 0].sum() + q.FIRST_ACCURACIES[0]) / (p[v != 0].sum() + 1)
            b = ((1 - p)[v < 0].sum() + q.FIRST_ACCURACIES[1]) / ((1 - p)[v != 0].sum() + 1)
            a = min(max(a, q.LEAST_GOOD), q.MOST_ACCURACY)
            right[k] = a, min(max(b, q.LEAST_BAD, 1 + q.MARGIN - a), q.MOST_ACCURACY)
    return now()


def good_ones(rows):
    p = posteriors(np.array([votes_of(r[1]) for r in rows]))
    return [r for r, good in zip(rows, p, strict=True) if good >= quality_rules.THRESHOLD and not base_of(r[1])[-1]]


def first_of_equals(rows):
    first = {}
    for r in sorted(rows):
        first.setdefault(re.sub(WHITE, " ", r[1]), r)
    return list(first.values())


def first_of_near(rows):
    return kept_rows(rows, [brute_print(r[1]) for r in rows])


def pieces_of(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = Counter()
    for doc_id, text in rows:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            found[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return found


def fixture(spark):
    """Given documents, every awkward row, and planted copies and passages."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    rows += [(r[0] if r[0] is None else r[0] + 10**6, *r[1:]) for r in documents()]
    clean = [r for r in rows if r[0] is not None and r[0] < 10**6 and 100 <= len(words_of(r[1])) < 3000][:8]
    passage = prose(70, 60).split()
    for k, r in enumerate(clean):
        words = words_of(r[1])
        planted = [r[1].replace(" ", "  "), " ".join([*words[:-1], "edited"]), " ".join([*words[: 20 + k], *passage, *words[20 + k : 60 + k][::-1], *words[::3]])]
        rows += [(2 * 10**6 + 10 * k + j, text, r[2], r[3], len(text)) for j, text in enumerate(planted)]
    return rows


def test_every_stage_matches_a_plain_version(spark, tmp_path, monkeypatch):
    rows = fixture(spark)
    given = spark.createDataFrame(rows, SCHEMA)
    given.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def recorded(stage):
        def run(spark, docs, sf_dir):
            assert docs.columns == given.columns
            seen.append([tuple(r) for r in docs.collect()])
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, recorded(f)) for name, f in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(seen[0]) == Counter(rows)
    for before, after, plain in zip(seen, seen[1:], (good_ones, first_of_equals, first_of_near), strict=False):
        want = plain(before)
        assert 0 < len(want) < len(before)
        assert Counter(after) == Counter(want)
    want = {r[0]: (r[2], r[4]) for r in brute(seen[3], 35)}
    whole = {r[0]: r for r in seen[3]}
    assert sorted(r[0] for r in seen[4]) == sorted(whole)
    assert any(n for n, _ in want.values()) and not all(n for n, _ in want.values())
    for r in seen[4]:
        removed, kept = want[r[0]]
        assert r == whole[r[0]] if not removed else (" ".join(words_of(r[1])) == kept and r[2:4] == whole[r[0]][2:4] and r[4] == len(r[1]))
    assert Counter(tuple(r)[:5] for r in packed) == pieces_of([(r[0], r[1]) for r in seen[4]])
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 4096


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_results_outlive_the_next_run(spark):
    """The first stage of a run leaves the tables of an earlier run; later stages clear those before them."""
    last = corpus_pipeline._scratch(spark).keep(spark.range(3), "last")
    kept = corpus_pipeline._scratch(spark, first=True).keep(spark.range(4), "kept")
    assert last.count() == 3
    corpus_pipeline._scratch(spark)
    path = kept._kindred_path
    assert not os.path.exists(path)
    assert last.count() == 3
