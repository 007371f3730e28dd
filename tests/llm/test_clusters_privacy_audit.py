import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.llm.centroid_clusters import centroid_clusters, centroid_digest, nearest, rotated, with_inertia
from kindred.llm.filter_audit import ORDERS, audit_filters, field, packed_outcomes, unpacked
from kindred.llm.personal_data import KINDS, find_personal_data, mask_personal_data, passes_luhn, personal_spans
from tests.llm.cases import documents, frame

VECTORS = "vec_id long, embedding array<float>, label int"

# --- centroid clusters ---------------------------------------------------------


def vector_rows(n=300, seed=5):
    rng = np.random.default_rng(seed)
    spots = rng.normal(size=(12, 64))
    rows = [(k, (spots[k % 12] + rng.normal(scale=0.2, size=64)).astype(np.float32).tolist(), 0) for k in range(n)]
    first = rows[0][1]
    rows += [(1000 + k, first, 0) for k in range(40)] + [(7, first, 1), (7, rows[7][1], 1), (None, first, 0), (None, rows[3][1], 0)]
    rows += [
        (2000, None, 0), (2001, [], 0), (2002, first[:-1], 0), (2003, [*first, 0.0], 0), (2004, [*first[:-1], None], 0),
        (2005, [*first[:-1], math.nan], 0), (2006, [*first[:-1], math.inf], 0), (2007, [0.0] * 64, 0), (2008, [-0.0001] * 64, 0),
    ]
    return rows


def plain_clusters(rows, k=8, rounds=10):
    """Every distance of every round, in Python integers."""
    kept = []
    for vec_id, e, _ in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in e]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        members = defaultdict(list)
        for (c, _), (_, x) in zip(assign(), kept):
            members[c].append(x)
        for c, xs in members.items():
            centroids[c] = [sum(column) // len(xs) for column in zip(*xs)]
    found = assign()
    own = Counter()
    for c, d in found:
        own[c] += d
    return Counter(
        (vec_id, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (vec_id, _), (c, d) in zip(kept, found)
    )


@pytest.mark.parametrize("rows, leading", [(vector_rows(), 8), (vector_rows(60, 6), 2), (vector_rows()[:5], 8)])
def test_clusters_match_plain_lloyd(spark, scratch, rows, leading):
    given_rows = spark.createDataFrame(rows, VECTORS).repartition(4).withColumns({
        "x": F.lit(1), "cluster": F.lit("c"), "sketch": F.lit(0), "distance": F.lit(0), "component": F.lit(0),
    })
    found = with_inertia(*centroid_clusters(given_rows, scratch, leading=leading))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, found.collect())) == plain_clusters(rows)


def test_clusters_of_nothing(spark, scratch):
    for rows in ([], [(1, None, 0)]):
        found = with_inertia(*centroid_clusters(spark.createDataFrame(rows, VECTORS), scratch))
        assert found.count() == 0


def test_large_components_are_bounded(spark, scratch):
    rows = [(k, [float(k)] * 63 + [1e30 * (-1) ** k], 0) for k in range(20)]
    found, centroids = centroid_clusters(spark.createDataFrame(rows, VECTORS), scratch)
    assert found.count() == 20 and found.agg(F.min("distance")).first()[0] >= 0
    assert abs(centroids).max() <= 1 << 27 and len(centroid_digest(centroids[0])) == 64


def test_bounds_miss_nothing_and_spare_most():
    """Ties, equal centroids and every kind of rotation give the plain answer."""
    rng = np.random.default_rng(1)
    spots = rng.integers(-900, 900, size=(8, 64))
    x = (spots[rng.integers(0, 8, 4000)] + rng.integers(-200, 200, size=(4000, 64))).astype(np.int32)
    centroids = spots.astype(np.int64)
    centroids[5] = centroids[2]
    centroids[6] = x[0]
    plain = ((x[:, None, :].astype(np.int64) - centroids[None]) ** 2).sum(axis=2)
    moments = np.cov(x.T)
    for axes in (np.linalg.eigh(moments)[1][:, ::-1], np.eye(64)):
        mean = x.mean(axis=0)
        best, distance, measured = nearest(x, rotated(x, mean, axes, 8), centroids, rotated(centroids, mean, axes, 8))
        assert (best == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    best, _, measured = nearest(x, rotated(x, mean, np.linalg.eigh(moments)[1][:, ::-1], 8), centroids,
                                rotated(centroids, mean, np.linalg.eigh(moments)[1][:, ::-1], 8))
    assert measured < 0.5 * plain.size


# --- personal data ---------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    """The fixed shapes by regular expression."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 14 <= len(digits) <= 19 and passes_luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def base_of(text):
    return [s[:3] for s in personal_spans(text) if s[3]]


PIECES = [
    "@", ".", "a", "b.c", "x@y.de", "+", "1", "12", "255", "256", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", " ", "-", "(", ")",
    "é", "中", "_", "%", "\n", "+1 (555) 123-4567", "378282246310005", "0", "00000", "mailto:", "://", "IBAN", "ssn ", "tel:", "[at]", "[dot]",
    "/", "#", "6011-0009-9013-9424", "999.1.1.1", "İ", "\x00",
]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_base_spans_match_the_patterns(text):
    assert base_of(text) == plain_base(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789 .-+()@aZé_", max_size=60))
def test_base_spans_match_the_patterns_on_dense_text(text):
    assert base_of(text) == plain_base(text)


UNITS = (
    "1", "1.", "1 ", "a@", "é@", "a@b.c@", "+1 ", "+1(", "9-", "a.", "IBAN DE", "tel:1", "x://a@", "(at)a.", "[at]a[dot]", "4111 1111 1111 1111 ",
    "é@é.", "ssn 1", "é.", "iban DE89",
)


@pytest.mark.parametrize("unit", UNITS)
def test_long_texts_take_linear_time(unit):
    text = unit * (2000 // len(unit))
    assert base_of(text) == plain_base(text)
    start = time.process_time()
    personal_spans(unit * (400_000 // len(unit)))
    assert time.process_time() - start < 5


def further(text):
    return [(kind, text[a:b]) for kind, a, b, base in personal_spans(text) if not base]


@pytest.mark.parametrize("text, want", [
    ("write josé.peña@correo.example.es now", [("email", "josé.peña@correo.example.es")]),
    ("write jane [at] mail [dot] example [dot] org now", [("email", "jane [at] mail [dot] example [dot] org")]),
    ("write jane(at)example.org.", [("email", "jane(at)example.org")]),
    ("meet (at) noon. Then go", []),
    ("4111111111111111 4111111111111112", [("card", "4111111111111111")]),
    ("2353820953013741 4550997810720801", []),
    ("4111 1111 1111 1111 5500 0000 0000 0004", [("card", "4111 1111 1111 1111"), ("card", "5500 0000 0000 0004")]),
    ("1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9", []),
    ("IBAN: DE89 3704 0044 0532 0130 00.", [("account", "DE89 3704 0044 0532 0130 00")]),
    ("iban GB82WEST12345698765432 and", [("account", "GB82WEST12345698765432")]),
    ("IBAN GB82WEST12345698765431 and", []),
    ("SSN 123-45-6789, SSN: 000-12-3456", [("ssn", "123-45-6789")]),
    ("ssnow 123-45-6789", []),
    ("see https://joe:secret@host.example/x?y for", [("url", "https://joe:secret@host.example/x?y")]),
    ("see https://host.example/x?y for, http://www.apache.org/licenses/LICENSE-2.0", []),
    ("call tel:5551234567 now", [("phone", "5551234567")]),
    ("hotel:5551234567", []),
])
def test_further_spans(text, want):
    assert further(text) == want


def test_personal_data_of_documents(spark):
    rows = [*documents(), (900, "a@b.cd 1.2.3.4 é\n4111 1111 1111 1111", "en", "s", 1), (901, "+1 (555) 123-4567", "en", "s", 1)]
    rows += [rows[-1]]
    docs = frame(spark, rows)
    found = find_personal_data(docs)
    got = Counter((r["doc_id"], tuple(tuple(s) for s in r["spans"])) for r in found.collect())
    assert got == Counter((r[0], tuple(personal_spans(r[1] or ""))) for r in rows)
    masked = mask_personal_data(docs)
    assert masked.schema == docs.schema
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[900] == "[EMAIL] [IP] é\n[CARD]" and texts[901] == "[PHONE]" and texts[0] is None
    assert find_personal_data(frame(spark, [])).count() == 0
    required = spark.createDataFrame([(1, "a@b.cd")], "doc_id long not null, text string not null")
    assert find_personal_data(required).count() == 1 and mask_personal_data(required).first()["text"] == "[EMAIL]"


# --- filter audit ------------------------------------------------------------------


def fails_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        letter
        for letter, fails in (
            ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text))),
        )
        if fails
    }


def plain_audit(rows, labels):
    good = {i for i, quality, _ in labels if i is not None and quality == 1}
    toxic = {i for i, _, toxic in labels if i is not None and toxic == 1}
    judged = []
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        fails = fails_of(text)
        mine = math.inf if doc_id is None else doc_id
        if any((r[1] or "") == text and r[0] is not None and r[0] < mine for r in rows):
            fails.add("E")
        judged.append((source or "", fails, doc_id in good and doc_id is not None, doc_id in toxic and doc_id is not None))
    out = []
    for part in {p for p, *_ in judged}:
        own = [x[1:] for x in judged if x[0] == part]
        steps, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = [True] * len(own)
            for step, letter in enumerate(order, 1):
                failing = [k for k, x in enumerate(own) if letter in x[0]]
                gone = [k for k in failing if left[k]]
                for k in gone:
                    left[k] = False
                shapley[letter] += len(gone)
                steps.append((
                    part, "".join(order), step, sum(left), len(gone), len(failing) - len(gone),
                    sum(own[k][0] == {letter} for k in failing), sum(own[k][1] for k in gone), sum(own[k][2] for k in gone),
                ))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return Counter(out)


def audit_rows():
    rows = documents()
    rng = random.Random(3)
    texts = [r[1] for r in rows]
    rows += [(500 + k, rng.choice(texts), "en", rng.choice(["s0", "s9", "", None]), 0) for k in range(60)]
    rows += [(3, rows[3][1], "en", "s1", 0), (None, rows[3][1], "en", "s1", 0), (800, "WORD " * 60, "en", "s0", 0)]
    labels = [(k, k % 2, int(k % 7 == 0)) for k in range(0, 560, 3)] + [(3, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0)]
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_audit_matches_brute_force(spark, scratch):
    rows, labels = audit_rows()
    docs = frame(spark, rows).withColumns({"part": F.lit(0), "mask": F.lit(0), "digest": F.lit(0), "good": F.lit(0)})
    found = audit_filters(docs, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("x")), scratch)
    assert found.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    ]
    assert Counter(map(tuple, found.collect())) == plain_audit(rows, labels)


def test_audit_without_documents_or_labels(spark, scratch):
    rows, _ = audit_rows()
    nothing = spark.createDataFrame([], LABELS)
    assert audit_filters(frame(spark, []), nothing, scratch).count() == 0
    assert Counter(map(tuple, audit_filters(frame(spark, rows), nothing, scratch).collect())) == plain_audit(rows, [])


def test_fields_never_carry():
    """Every field can hold the largest count beside the largest counts of its neighbours."""
    packed = packed_outcomes()
    most = (1 << 63) - 1
    for mask in (0, 1, 21, 31):
        total = packed["removed"][mask] * most
        counts = unpacked(total)
        assert set(counts) <= {0, most} and len(counts) == 5 * len(ORDERS)
        for order in (0, 57, 119):
            for step in range(5):
                letters = [mask >> "ABCDE".index(x) & 1 for x in ORDERS[order]]
                want = most * (letters[step] and not any(letters[:step]))
                assert counts[order * 5 + step] == want == total >> field(order, step) & (1 << 64) - 1
