"""Language identification by a linear-chain conditional random field.

Words are labelled one by one: affixes, character n-grams and a lexicon give
each word a score per language, learned transitions tie neighbours together,
and forward-backward gives the probability of each label, also where languages
alternate within a text.  A document's language is the one with the largest
mean probability over its words.

The model is fitted on stretches of at most ``STRETCH`` words of about
``SAMPLE`` documents per language (all where there are fewer), chosen by a hash
of id and text; rows equal in both are learned once.  Stretches of different
documents are joined, so that the transitions see changes of language.
Predictions read every word.

Words stand between ASCII white space.  One of more than ``LETTERS`` letters
(text without such space) is several words: it is split at what is neither a
letter, a mark nor an apostrophe, and then after every ``LETTERS`` letters.

Nulls: a null text has no words; a text without a letter is ``und`` with score
0.  Of languages with equal means the first in alphabetical order stands.  A null language teaches nothing; with nothing to learn all is ``und``.
Repeated rows get equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import crc_bucket, utf8

FOLDS, HELD_OUT = 4, 2
SAMPLE, STRETCH = 750, 60
LETTERS = 32
HASH_SIZE = 1 << 15
LEXICON = 300
EPOCHS, RATE, BATCH = 4, 0.3, 64
KNOWN_WORDS, WORDS_AT_ONCE = 800_000, 800_000
UNDETERMINED = "und"


def _letters(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalpha())


def words_of(text: bytes) -> list[bytes]:
    """Words of a text; one of more than ``LETTERS`` letters is several."""
    own = text.split()
    if max(map(len, own), default=0) <= LETTERS:
        return own
    words: list[bytes] = []
    for word in own:
        if len(word) <= LETTERS or sum(map(str.isalpha, long := word.decode("utf-8", "replace"))) <= LETTERS:
            words.append(word)
            continue
        start, n = 0, 0
        for i, c in enumerate(long):
            letter = c.isalpha()
            inside = letter or c in "'\u2019" or unicodedata.category(c)[0] == "M"
            if not inside or letter and n == LETTERS:
                if n:
                    words.append(long[start:i].encode())
                start, n = i + (not inside), 0
            n += letter
        if n:
            words.append(long[start:].encode())
    return words


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed affixes, n-grams and lexicon entry of a word; none without a letter."""
    core = _letters(word)
    if not core:
        return []
    marked = f"<{core}>"
    parts = {f"p{core[:k]}" for k in (1, 2, 3)} | {f"s{core[-k:]}" for k in (1, 2, 3)}
    parts.update(marked[i : i + k] for k in (1, 2, 3) for i in range(len(marked) - k + 1))
    found = [zlib.crc32(x.encode()) % HASH_SIZE for x in parts]
    if core in lexicon:
        found.append(HASH_SIZE + lexicon[core])
    return found


def forward_backward(
    emission: np.ndarray, transition: np.ndarray, lengths: np.ndarray, pairs: np.ndarray | None = None
) -> np.ndarray:
    """Label probabilities of sequences that lie one after another.

    ``emission`` and ``transition`` are log scores.  Sequences advance side by
    side, longest first, so each step works on a prefix of them.  The
    probabilities of all pairs of neighbouring labels are added to ``pairs``.
    """
    psi = np.exp(emission - emission.max(axis=1, keepdims=True, initial=-np.inf))
    move = np.exp(transition)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    start = (np.cumsum(lengths) - lengths)[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")  # sequences longer than each step
    out = np.empty_like(psi)
    state = None
    for t in range(steps):
        at = start[: active[t]] + t
        state = psi[at] if t == 0 else (state[: active[t]] @ move) * psi[at]
        state = state / state.sum(axis=1, keepdims=True)
        out[at] = state
    back = np.ones((len(size), psi.shape[1]), psi.dtype)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        both = out[at] * back[:k]
        out[at] = both / both.sum(axis=1, keepdims=True)
        onward = psi[at] * back[:k]
        if pairs is not None and t:
            before = out[at - 1]  # forward states still
            whole = ((before @ move) * onward).sum(axis=1, keepdims=True)
            pairs += (before.T @ (onward / whole)) * move
        new = onward @ move.T
        back[:k] = new / new.sum(axis=1, keepdims=True)
    return out


class Crf:
    """Weights by feature and label, and transitions."""

    def __init__(self, given: list[tuple[str, str]], seed: int = 7):
        texts = [([w.decode() for w in words_of(text.encode())], lang) for text, lang in given]
        self.labels = sorted({lang for _, lang in texts})
        number = {lang: k for k, lang in enumerate(self.labels)}
        n = len(self.labels)
        by_label = [Counter() for _ in range(n)]
        for text, lang in texts:
            by_label[number[lang]].update(map(_letters, text))
        words = dict.fromkeys(w for c in by_label for w, _ in c.most_common(LEXICON) if w)
        self.lexicon = {w: k for k, w in enumerate(words)}
        self.weights = np.zeros((HASH_SIZE + len(self.lexicon), n), np.float32)
        self.transition = np.zeros((n, n), np.float32)
        if n:
            self._fit([(ws, number[lang]) for ws, lang in texts], np.random.default_rng(seed))

    def _fit(self, texts: list[tuple[list[str], int]], rng: np.random.Generator) -> None:
        known: dict[str, list[int]] = {}
        half = STRETCH // 2
        pieces = [(ws[i : i + half], y) for ws, y in texts for i in range(0, len(ws), half)]
        weight_sum, move_sum = np.full_like(self.weights, 1e-2), np.full_like(self.transition, 1e-2)
        for _ in range(EPOCHS):
            order = rng.permutation(len(pieces))
            for at in range(0, len(order), 2 * BATCH):
                chosen = [pieces[k] for k in order[at : at + 2 * BATCH]]
                words = [w for ws, _ in chosen for w in ws]
                if not words:
                    continue
                labels = np.repeat([y for _, y in chosen], [len(ws) for ws, _ in chosen])
                # two pieces to a sequence
                sizes = np.array([len(ws) for ws, _ in chosen])
                lengths = np.add.reduceat(sizes, np.arange(0, len(sizes), 2))
                lengths = lengths[lengths > 0]
                found = [known.get(w) or known.setdefault(w, word_features(w, self.lexicon)) for w in words]
                counts = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter((f for x in found for f in x), np.int64, counts.sum())
                owner = np.repeat(np.arange(len(words)), counts)
                emission = np.zeros((len(words), len(self.labels)), np.float32)
                np.add.at(emission, owner, self.weights[flat])
                expected = np.zeros((len(self.labels),) * 2)
                p = forward_backward(emission, self.transition, lengths, expected)
                error = p.copy()
                error[np.arange(len(words)), labels] -= 1
                gradient = np.zeros_like(self.weights)
                np.add.at(gradient, flat, error[owner])
                used = np.unique(flat)
                g = gradient[used] / BATCH
                weight_sum[used] += g**2
                self.weights[used] -= RATE * g / np.sqrt(weight_sum[used])
                ends = np.cumsum(lengths)
                inner = np.setdiff1d(np.arange(len(words)), np.append(ends - 1, len(words) - 1))
                seen = np.zeros_like(expected)
                np.add.at(seen, (labels[inner], labels[inner + 1]), 1)
                g = ((expected - seen) / BATCH).astype(np.float32)
                move_sum += g**2
                self.transition -= RATE * g / np.sqrt(move_sum)


class _Emissions:
    """Scores of words, remembered by a worker."""

    def __init__(self, model: Crf):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(self.model.labels)), np.float32)
        self.letters = np.zeros(0, bool)

    def learn(self, words: list[bytes]) -> None:
        model = self.model
        found = [word_features(w.decode("utf-8", "replace"), model.lexicon) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((f for x in found for f in x), np.int64, counts.sum())
        sums = np.concatenate((np.zeros((1, len(model.labels))), np.cumsum(model.weights[flat], axis=0, dtype=np.float64)))
        ends = np.cumsum(counts)
        for w in words:
            self.number[w] = len(self.number)
        self.scores = np.concatenate((self.scores, (sums[ends] - sums[ends - counts]).astype(np.float32)))
        self.letters = np.concatenate((self.letters, counts > 0))


def label_words(texts: list[bytes], known: _Emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities per word, whether it has a letter, and words per text."""
    words: list[bytes] = []
    lengths = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = words_of(text)
        lengths[i] = len(own)
        words += own
    if len(known.number) > KNOWN_WORDS:
        known.clear()
    new = list(dict.fromkeys(w for w in words if w not in known.number))
    if new:
        known.learn(new)
    at = np.fromiter(map(known.number.__getitem__, words), np.int64, len(words))
    return forward_backward(known.scores[at], known.model.transition, lengths), known.letters[at], lengths


def _predict(model: Crf, key: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = sys.modules.setdefault("_kindred_crf", ModuleType("_kindred_crf")).__dict__
        if store.get("key") != key:
            store.update(key=key, known=_Emissions(model))
        known = store["known"]

        def judged(texts: list[bytes]) -> tuple[list[str], list[float]]:
            if not model.labels:
                return [UNDETERMINED] * len(texts), [0.0] * len(texts)
            p, letters, lengths = label_words(texts, known)
            sums = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(np.where(letters[:, None], p, 0), axis=0, dtype=np.float64)))
            n = np.concatenate(([0], np.cumsum(letters)))
            ends = np.cumsum(lengths)
            mean = (sums[ends] - sums[ends - lengths]) / np.maximum(1, n[ends] - n[ends - lengths])[:, None]
            some = n[ends] > n[ends - lengths]
            best = mean.argmax(axis=1)
            names = [model.labels[k] if s else UNDETERMINED for k, s in zip(best.tolist(), some.tolist(), strict=True)]
            return names, np.where(some, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0).tolist()

        for batch in batches:
            names, scores, held, size = [], [], [], 0
            for text in [*utf8(batch["text"]), None]:
                if text is not None:
                    held.append(text)
                    size += len(text) // 6 + 1
                if held and (text is None or size > WORDS_AT_ONCE):
                    a, b = judged(held)
                    names += a
                    scores += b
                    held, size = [], 0
            yield batch.drop_columns(["text"]).append_column("lang_pred", pa.array(names, pa.string())).append_column(
                "score", pa.array(scores, pa.float64())
            )

    return run


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stretch of each text, from the place that a hash picks."""
    for batch in batches:
        texts = []
        for text, place in zip(utf8(batch["text"]), batch["place"].to_pylist(), strict=True):
            words = words_of(text)
            first = place % max(1, len(words) - STRETCH + 1)
            texts.append(b" ".join(words[first : first + STRETCH]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "lang": batch["lang"]})


def fit(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Crf:
    """A model from stretches of documents outside the held-out fold, about ``sample`` per language."""
    usable = docs.where(F.col(lang).isNotNull() & (crc_bucket(doc_id, FOLDS) != HELD_OUT)).select(
        F.col(doc_id).alias("_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    pick = F.xxhash64("_id", "text")
    counts = usable.groupBy("lang").agg(F.approx_count_distinct(pick).alias("n")).collect()
    # One condition per language, so a rare language is learned whole beside a frequent one.
    limits = {r["lang"]: int(min(1.0, sample / max(1, r["n"])) * (1 << 30)) for r in counts}
    limit = F.create_map(*[F.lit(x) for item in limits.items() for x in item])[F.col("lang")] if limits else F.lit(0)
    chosen = usable.where(F.pmod(pick, F.lit(1 << 30)) < limit)
    rows = (
        chosen.select(F.xxhash64("_id", F.lit(1)).alias("place"), "text", "lang")
        .mapInArrow(_stretches, "text string, lang string")
        .distinct()
        .collect()
    )
    return Crf(sorted((r["text"], r["lang"]) for r in rows))


def languages(docs: DataFrame, model: Crf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    import uuid

    given = docs.select(
        F.col(doc_id).alias("doc_id"), (crc_bucket(doc_id, FOLDS) == HELD_OUT).alias("held_out"), F.col(text).alias("text")
    )
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    return given.mapInArrow(_predict(model, uuid.uuid4().hex), schema)
