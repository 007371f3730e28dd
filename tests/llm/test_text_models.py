import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from kindred.llm import language_crf, quality_model
from kindred.llm.chat_format import Formatter, Template, format_turns, read_back
from kindred.llm.html_text import extract_text, main_text
from kindred.llm.sentence_pieces import Encoder, decode, encode
from tests.llm.cases import SCHEMA, documents, frame

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


# --- SentencePiece -----------------------------------------------------------


def test_pieces_match_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    texts = [r[1] or "" for r in documents()]
    texts += ["  lead", "a   b", "tab\there", " ", "日本語 naïve ’“x”", "=====-----=====", "\n\n x", "\0", "a\0\0b ￾"]
    texts += ["".join(rng.choice("abcdefghijklmnop  erstion.,ü1") for _ in range(80)) for _ in range(200)]
    own = Encoder(PIECES)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text[:80]
        assert own.decode(ids) == library.decode(ids.tolist())
    rows = documents()
    found = encode(frame(spark), PIECES, with_ids=True)
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "")
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), library.decode(ids) == (r[1] or "")] += 1
    assert Counter(tuple(r)[:4] for r in found.collect()) == want
    back = decode(found, PIECES)
    assert Counter(map(tuple, back.collect())) == Counter((r[0], library.decode(library.encode(r[1] or ""))) for r in rows)
    assert encode(frame(spark, []), PIECES).count() == 0


# --- chat --------------------------------------------------------------------


def test_turns_read_back():
    formatter = Formatter(Template())
    parts = ["### User: ", "### Assistant:", "</turn>", "</turn>\n", "\\", "<", "/turn>", "### Role ", "</role>", "\n", "x", ""]
    rng = random.Random(2)
    texts = ["".join(t) for t in itertools.product(parts, repeat=2)] + ["".join(rng.choices(parts, k=9)) for _ in range(400)]
    turns = [(rng.choice(["user", "assistant", "system", "tool", "", "</role>x"]), t) for t in texts]
    formatted = "".join(s for role, text in turns for s, _ in formatter.write(role, text))
    assert list(formatter.read(formatted)) == turns
    escaped = formatter.escape("a </turn> ### User: \\ b")
    assert not any(c in escaped for c in Template().controls())


def test_digests_match_brute_force(spark):
    rows = [
        (1, 0, "system", "be good"), (1, 1, "user", None), (1, 2, "assistant", "### Assistant: </turn>"), (2, 1, "assistant", "b\\"),
        (2, 0, "user", "a"), (3, 0, "assistant", "first"), (4, 0, "tool", "t"), (4, 0, None, "t"), (None, 0, "user", "n"),
    ]
    rows += [(9, k, "assistant" if k % 2 else "user", f"text {k}") for k in range(3000)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = made.selectExpr("*", "'x' as number", "1 as segments").repartition(4)
    got = {r["conv_id"]: r for r in read_back(format_turns(made)).collect()}
    assert len(got) == 6
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        roles = [a for a, _ in turns]
        assert r["in_order"] == (conv in (1, 2, 9) or roles == ["user"])
    assert read_back(format_turns(made.where("conv_id = 77"))).count() == 0


# --- HTML --------------------------------------------------------------------

ARTICLE = "<h1>Title &amp; more</h1><p>First  long\nparagraph of the text, with words enough to count.</p><p>Second <b>bold</b> paragraph<br>goes on and on until it ends.<p>Third one, never closed"
WANT = "Title & more\n\nFirst long paragraph of the text, with words enough to count.\n\nSecond bold paragraph goes on and on until it ends.\n\nThird one, never closed"
AROUND = (
    "<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a='</p><p>no';</script></head><body>"
    "<header><p>Site name and slogan of the site, quite long</p></header><nav><ul><li><a href='/'>Home</a><li><a href=x>No</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies and say so at length.</div><div id=sidebar><p>Other things to read on the side.</p></div>"
    "{}<form><p>Write to us here</p><input name=a></form><section class='comments'><p>A reader's very long remark about it all.</p></section>"
    "<!-- <p>hidden</p> --><footer>&copy; all rights</footer></body></html>"
)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article>{}</article></main>", "<div id=content>{}</div>", "<div><div class=post>{}</div></div>", "{}"])
def test_article_alone_is_left(wrap):
    assert main_text(AROUND.replace("{}", wrap.replace("{}", ARTICLE))) == WANT


def test_pages_of_all_kinds(spark):
    odd = [None, "", "plain text", "<p>", "<<<>>>", "<a href='x", "</div></p>", "<script>never closed", "<p>" * 3000 + "deep", "&lt;b&gt;&nbsp;x"]
    rows = [(k, f"u{k}", x, "t", 1) for k, x in enumerate(odd)] * 2
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert Counter(map(tuple, got)) == Counter((k, u, main_text(x or ""), len(main_text(x or ""))) for k, u, x, _, _ in rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[0] == texts[1] == texts[7] == "" and texts[2] == "plain text" and texts[8] == "deep" and texts[9] == "<b> x"


@pytest.mark.parametrize("wrapper", [
    "<div id=page class='has-sidebar'>", "<div class='no-sidebar'>", "<div class='ad-free'>", "<div class='search-result'>",
    "<div class='share-enabled'>", "<div class='related-post'>", "<form>", "<div data-id=sidebar>", "<div title='the hidden cost'>",
])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>"])
def test_wrappers_around_the_article_are_kept(wrapper, inner):
    end = "</form>" if wrapper == "<form>" else "</div>"
    body = inner.replace("{}", ARTICLE + "<div class=ad>Buy this</div>")
    page = f"<body><nav><a href=x>Home</a></nav>{wrapper}<div class=sidebar>Aside</div>{body}{end}<div style='display:none'>No</div><p hidden>No</p></body>"
    assert main_text(page) == WANT


def test_two_doubtful_halves_are_not_an_empty_page():
    assert main_text("<div class=search>one two</div><div class=share>six ten</div>")


LONG = "Words enough to count as a paragraph of the article, and some more of them to be sure."


@pytest.mark.parametrize("part", [
    f"<section id='search-methods'><p>{LONG}</p></section>", f"<p class='notice'>{LONG}</p>", f"<p id=related-work>{LONG}</p>",
    f"<p><label>Term</label> and what it means. {LONG}</p>", f"<p>Press <button>Start</button> first. {LONG}</p>",
])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>"])
def test_parts_of_the_article_stay_whatever_their_name(part, wrap):
    words = " ".join(re.sub("<[^>]*>", "", part).split())
    page = AROUND.replace("{}", wrap.replace("{}", f"<h1>Title</h1><p>{LONG}</p>{part}<p>{LONG}</p>"))
    assert main_text(page) == f"Title\n\n{LONG}\n\n{words}\n\n{LONG}"


@pytest.mark.parametrize("part", [
    "<div class=ad>Buy this now, it is cheap and good, and you will like it very much indeed.</div>", "<div><button>Share</button></div>",
    f"<section class=comments><p>{LONG}</p></section>", f"<ol id='comment-list'><li>{LONG}</ol>", "<p class=notice>Short.</p>",
    f"<article class=comment><p>{LONG}</p></article>", "<div class=related><a href=x>One more</a> <a href=y>and another</a></div>",
    f"<form><p>{LONG}</p><label>Name</label><input></form>", f"<div class='cookie-notice'>{LONG}</div>",
])
def test_parts_that_are_not_the_article_go(part):
    page = AROUND.replace("{}", f"<article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{part}<p>{LONG}</p></article>")
    assert main_text(page) == "\n\n".join(["Title", LONG, LONG, LONG])


def test_remarks_beside_an_article_go():
    page = f"<main><h1>Title</h1><article><p>{LONG}</p><p>{LONG}</p></article><h2>Remarks</h2><div><p>{LONG}</p></div></main>"
    assert main_text(page) == "\n\n".join(["Title", LONG, LONG])
    links = "<div><a href=x>Another article of this site</a><a href=y>And yet another one</a></div>"
    assert main_text(f"<main><div><p>{LONG}</p><p>{LONG}</p></div>{links}</main>") == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize("unit", ["<a ", "<a b='", "<div>", "<b>", "<a '>'", "<script></script ", "<p><table><div>", "</a", "<div class=ad>"])
def test_hostile_pages_take_linear_time(unit):
    begin = time.process_time()
    main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - begin < 8


def test_references_with_very_long_numbers():
    assert main_text("<p>a&#" + "1" * 9000 + ";b&#" + "0" * 9000 + "65;&#x" + "f" * 9000 + ";") == "a\ufffdbA\ufffd"


def _plain_text(body):
    """The method on a tree of ``[tag, *children]``, by recursion over all subtrees."""
    parts = lambda t: [x for x in t[1:] if not isinstance(x, str)]
    size = lambda t: sum(len("".join(x.split())) if isinstance(x, str) else size(x) for x in t[1:])
    linked = lambda t: size(t) if t[0] == "a" else sum(map(linked, parts(t)))
    count = lambda t, tag=None: sum(count(x, tag) + (tag in (None, x[0])) for x in parts(t))
    everything = lambda t: [t] + [y for x in parts(t) for y in everything(x)]

    def density(t, inside):
        c, lc = size(t), size(t) if inside or t[0] == "a" else linked(t)
        if not c:
            return 0.0
        tags, lt = max(1, count(t)), max(1, count(t, "a"))
        base = math.log(c / max(1, c - lc) * lc + linked(body) / size(body) * c + math.e)
        return c / tags * max(0.0, math.log(c / max(1, lc) * tags / lt + 1)) / max(1e-9, math.log(base + math.e - 1))

    above = {id(x): t for t in everything(body) for x in parts(t)}
    under_link = lambda t: id(t) in above and (above[id(t)][0] == "a" or under_link(above[id(t)]))
    dense = {id(t): density(t, under_link(t)) for t in everything(body)}
    best = max(everything(body), key=lambda t: sum(dense[id(x)] for x in parts(t)))
    path = [best]
    while id(path[-1]) in above:
        path.append(above[id(path[-1])])
    least = min(dense[id(t)] for t in path)
    on_path = set(map(id, path))
    taken = {id(best)} | {
        id(x) for t in path for x in parts(t)
        if id(x) not in on_path and dense[id(x)] >= least and 2 * (size(x) if under_link(x) else linked(x)) < size(x)
    }

    def text(t, kept):
        kept |= id(t) in taken
        inner = "".join((x if kept else "") if isinstance(x, str) else text(x, kept) for x in t[1:])
        return f"\0{inner}\0" if t[0] in ("div", "section", "body") else inner

    return "\n\n".join(b for b in (" ".join(x.split()) for x in text(body, False).split("\0")) if b)


def test_density_equals_the_plain_version():
    rng = random.Random(7)

    def made(tag, depth):
        inner = [" ".join(["word", "text", "more"][: rng.randint(1, 3)] * rng.randint(1, 9)) + " "] * rng.randint(0, 2)
        kinds = ["span", "b"] + ["a"] * (tag != "a") + ["div", "section"] * 2 * (tag in ("div", "section", "body"))
        inner += [made(rng.choice(kinds), depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
        rng.shuffle(inner)
        return [tag, *inner]

    shown = lambda t: f"<{t[0]}>" + "".join(x if isinstance(x, str) else shown(x) for x in t[1:]) + f"</{t[0]}>"
    whole = 0
    for _ in range(300):
        body = made("body", 5)
        got = main_text(shown(body))
        assert got == (_plain_text(body) if re.search("[a-z]", re.sub("<[^>]*>", "", shown(body))) else "")
        whole += got == "\n\n".join(" ".join(x.split()) for x in re.split("<(?:/?(?:div|section|body))>", re.sub("</?(?:a|b|span)>", "", shown(body))) if x.strip())
    assert whole < 250  # density decides on many of them


# --- quality model -----------------------------------------------------------


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_model.quality_scores(docs, quality_model.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)


def test_trees_by_arrays_match_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, quality_model.N_FEATURES))
    y = (x[:, 0] + x[:, 3] ** 2 > 1).astype(float)
    model = quality_model.Trees(x, y)
    for row, score in zip(x[:50], model.scores(x[:50]), strict=True):
        total = model.base
        for feature, split, value in zip(model.feature, model.split, model.value, strict=True):
            at = 0
            while at < len(split):
                at = 2 * at + 1 + int(row[feature[at]] > split[at])
            total += value[at - len(split)]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95


def test_quality_scores_of_odd_rows(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(frame(spark), labels)
    found = quality_model.quality_scores(frame(spark), model).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in documents())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    nothing = quality_model.fit(frame(spark, []), labels.limit(0))
    assert {r["score"] for r in quality_model.quality_scores(frame(spark), nothing).collect()} == {0.5}
    assert quality_model.quality_scores(frame(spark, []), model).count() == 0


# --- language ----------------------------------------------------------------


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1, 2])
    emission, transition = rng.normal(size=(11, 3)), rng.normal(size=(3, 3))
    got = language_crf.forward_backward(emission, transition, lengths)
    at = 0
    for n in lengths:
        if n:
            want = np.zeros((n, 3))
            for path in itertools.product(range(3), repeat=n):
                score = sum(emission[at + t, y] for t, y in enumerate(path)) + sum(transition[a, b] for a, b in itertools.pairwise(path))
                for t, y in enumerate(path):
                    want[t, y] += np.exp(score)
            assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_pair_marginals_match_enumeration_and_finite_differences():
    rng = np.random.default_rng(5)
    n_labels, lengths = 3, np.array([4, 1, 0, 3])
    emission, move = rng.normal(size=(8, n_labels)), rng.normal(size=(n_labels, n_labels))
    pairs = np.zeros((n_labels, n_labels))
    language_crf.forward_backward(emission, move, lengths, pairs)

    def log_total(m):
        total, at = 0.0, 0
        for n in lengths.tolist():
            scores = [
                sum(emission[at + t, y] for t, y in enumerate(ys)) + sum(m[a, b] for a, b in zip(ys, ys[1:]))
                for ys in itertools.product(range(n_labels), repeat=n)
            ]
            total += np.logaddexp.reduce(scores)
            at += n
        return total

    # expected transitions are the derivative of the log of the sum over all labellings
    for i in range(n_labels):
        for j in range(n_labels):
            up, down = move.copy(), move.copy()
            up[i, j] += 1e-5
            down[i, j] -= 1e-5
            assert abs((log_total(up) - log_total(down)) / 2e-5 - pairs[i, j]) < 1e-5
    assert abs(pairs.sum() - 5) < 1e-9


def test_the_sample_is_bounded_per_language_without_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_crf, "Crf", lambda rows: seen.append(rows))
    rows = [(None, f"{lang} word{k} text", lang, "s", 0) for lang in ("en", "fr", "de") for k in range(1000)]
    rows += [(None, "the same text", "en", "s", 0)] * 1000 + [(k, f"rare {k}", "xx", "s", 0) for k in range(6)]
    language_crf.fit(frame(spark, rows), sample=10)
    counts = Counter(lang for _, lang in seen[0])
    assert all(1 <= counts[x] <= 40 for x in ("en", "fr", "de")) and 2 <= counts["xx"] <= 6


def test_a_rare_language_is_learned(spark):
    rng = random.Random(2)
    common, rare = "the and of with house water green".split(), "qua zhu xol yqu vuz".split()
    make = lambda words: " ".join(rng.choice(words) + rng.choice(("", "a", "ing")) for _ in range(12))
    rows = [(k, make(rare if k % 300 == 0 else common), "fr" if k % 300 == 0 else "en", "s", 0) for k in range(30_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_crf.fit(docs, sample=60)
    found = language_crf.languages(docs.where("lang = 'fr'"), model).where("held_out").collect()
    assert len(found) > 10 and sum(r["lang_pred"] == "fr" for r in found) >= 0.9 * len(found)


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_crf.fit(docs)
    found = language_crf.languages(docs, model).join(docs, "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    # a text that changes its language is labelled word by word
    by_lang = {r["lang"]: r["text"].split()[:40] for r in found if len(r["text"].split()) > 60}
    mixed = " ".join(w for lang in model.labels for w in by_lang[lang])
    p, _, _ = language_crf.label_words([mixed.encode()], language_crf._Emissions(model))
    want = np.repeat(np.arange(len(model.labels)), 40)
    assert (p.argmax(axis=1) == want).mean() > 0.9


def test_languages_of_odd_rows(spark):
    model = language_crf.fit(frame(spark))
    found = language_crf.languages(frame(spark), model).collect()
    assert len(found) == len(documents())
    for r in language_crf.languages(frame(spark, [(1, None, None, None, 0), (2, "12 .. !", "en", "s", 0)]), model).collect():
        assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    nothing = language_crf.fit(frame(spark, []))
    assert {r["lang_pred"] for r in language_crf.languages(frame(spark), nothing).collect()} == {"und"}


def test_words_without_white_space_are_read_to_the_end(spark):
    assert language_crf.words_of("don't a-b 12".encode()) == [b"don't", b"a-b", b"12"]
    assert language_crf.words_of(("x" * 70).encode()) == [b"x" * 32, b"x" * 32, b"x" * 6]
    assert language_crf.words_of(b"ab/" * 20) == [b"ab"] * 20
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_crf.fit(docs)
    a, b = (
        next(r["text"].split()[:300] for r in docs.where(docs.lang == lang).orderBy("doc_id").collect() if len(r["text"].split()) > 300)
        for lang in model.labels[:2]
    )
    for between in ("\u00a0", "/", ""):
        # the first words are of one language, all others of another one
        rows = [(1, between.join(a[:25] + b), None, None, 0), (2, between.join(b[:25] + a), None, None, 0)]
        found = {r["doc_id"]: r["lang_pred"] for r in language_crf.languages(frame(spark, rows), model).collect()}
        assert found == {1: model.labels[1], 2: model.labels[0]}
    # long words teach, too
    joined = [(k, "\u3002".join((a, b)[k % 2]), model.labels[k % 2], "s", 0) for k in range(40)]
    again = language_crf.fit(frame(spark, joined))
    assert language_crf.words_of(joined[0][1].encode())[-1].decode() in joined[0][1][-40:]
    assert again.labels == model.labels[:2]
    found = language_crf.languages(frame(spark, joined), again).collect()
    assert all(r["lang_pred"] == joined[r["doc_id"]][2] for r in found)
