"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are laid out one after another and a suffix array
indexes them.  Every piece of the vocabulary finds all its occurrences by one
binary search; an occurrence is an edge from its first to its last position.
Edges sorted by position are relaxed from left to right: of the edges that end
at a position the one stands that the merge order allows after the piece before
it.  The vocabulary is a byte-pair one, for which exactly one does, so the
result is that of the merges themselves.  Characters without a piece fall back
to bytes.

Text is cut where white space begins, which is exact as no piece holds white
space after another character; the model is tested for that.

Nulls: a null text is empty; empty texts have no ids.  Repeated rows give
repeated results.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
KNOWN_WORDS, CHARS_AT_ONCE = 800_000, 2_000_000
NEVER = 1 << 40

_CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def piece_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (code points, 0 between words) in the order of their next ``depth`` characters."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        step *= 2
        if step >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))


class Pieces:
    """Vocabulary and merge order of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        n = sp.get_piece_size()
        names = [sp.id_to_piece(k) for k in range(n)]
        plain = [not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)) for k in range(n)]
        if any(p and SPACE in x.lstrip(SPACE) for x, p in zip(names, plain, strict=True)):
            raise ValueError("a piece holds white space after another character")
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.raw = [bytes([int(x[3:5], 16)]) if sp.is_byte(k) else x.encode() if plain[k] else b"" for k, x in enumerate(names)]
        number = {x: k for k, x in enumerate(names) if plain[k]}
        order = np.argsort([-sp.get_score(k) for k in range(n)], kind="stable")
        self.priority = np.empty(n + 1, np.int64)
        self.priority[order] = np.arange(n)
        self.unknown = n  # a character without a piece; nothing merges with it
        self.priority[n] = NEVER
        pairs: dict[tuple[int, int], int] = {}
        for x, k in number.items():
            for cut in range(1, len(x)):
                if x[:cut] in number and x[cut:] in number:
                    pairs[number[x[:cut]], number[x[cut:]]] = k
        self._width = n + 1
        keys = np.array([a * self._width + b for a, b in pairs], np.int64)
        by_key = np.argsort(keys)
        self._pair_keys, self._pair_ids = keys[by_key], np.array(list(pairs.values()), np.int64)[by_key]
        self._spines(number, pairs)
        usable = [x for x in number if self.reachable[number[x]]]
        self.ids = np.array([number[x] for x in usable], np.int64)
        self.lengths = np.array([len(x) for x in usable], np.int64)
        self.depth = int(self.lengths.max())
        self.chars = np.full((len(usable), self.depth), -1, np.int64)
        for row, x in enumerate(usable):
            self.chars[row, : len(x)] = [ord(c) for c in x]

    def _spines(self, number: dict[str, int], pairs: dict[tuple[int, int], int]) -> None:
        """Pieces along the right and the left edge of each piece's own merges, smallest first."""
        self.reachable = np.zeros(self._width, bool)
        split: dict[int, tuple[int, int]] = {}
        for x, k in number.items():
            if any(c not in number for c in x):
                continue
            parts = [number[c] for c in x]
            last = None
            while len(parts) > 1:
                best = min(
                    ((self.priority[m], i) for i in range(len(parts) - 1) if (m := pairs.get((parts[i], parts[i + 1]))) is not None),
                    default=None,
                )
                if best is None:
                    break
                i = best[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [pairs[last]]
            if parts == [k]:
                self.reachable[k] = True
                if last:
                    split[k] = last
        deep = 2 + max(len(x) for x in number)
        self.right, self.left = np.full((self._width, deep), -1, np.int64), np.full((self._width, deep), -1, np.int64)
        for k in range(self._width):
            for table, side in ((self.right, 1), (self.left, 0)):
                spine, now = [k], k
                while now in split:
                    now = split[now][side]
                    spine.append(now)
                table[k, : len(spine)] = spine[::-1]

    def _merge_priority(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Priority of the merge of two pieces, ``NEVER`` if there is none."""
        key = a * self._width + b
        at = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == key, self.priority[self._pair_ids[at]], NEVER)

    def follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the merges leave ``first`` and ``second`` side by side.

        Walks both inner edges in the order in which the pieces on them arise;
        an earlier merge across the border rules the pair out.  Of equal merges
        the left one comes first.
        """
        ok = np.ones(len(first), bool)
        i, j = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        open_ = np.arange(len(first))
        while len(open_):
            f, s = first[open_], second[open_]
            up_a, up_b = self.right[f, i[open_] + 1], self.left[s, j[open_] + 1]
            end_a = np.where(up_a >= 0, self.priority[up_a] * 3, 3 * NEVER)
            end_b = np.where(up_b >= 0, self.priority[up_b] * 3 + 2, 3 * NEVER)
            across = self._merge_priority(self.right[f, i[open_]], self.left[s, j[open_]]) * 3 + 1
            bad = across < np.minimum(end_a, end_b)
            ok[open_[bad]] = False
            step_a = end_a <= end_b
            i[open_] += step_a
            j[open_] += ~step_a
            open_ = open_[~bad & ((up_a >= 0) | (up_b >= 0))]
        return ok

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence of a piece in ``text``."""
        order = piece_suffixes(text, self.depth)
        padded = np.concatenate((text, np.zeros(self.depth, text.dtype)))

        def bound(strict: bool) -> np.ndarray:
            """Number of suffixes before each piece, or before or starting with it."""
            low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(text), np.int64)
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                at = order[middle]
                sign = np.zeros(len(open_), np.int64)
                for k in range(self.depth):
                    want = self.chars[open_, k]
                    got = padded[at + k]
                    undecided = (sign == 0) & (want >= 0)
                    if not undecided.any():
                        break
                    sign = np.where(undecided, np.sign(got - want), sign)
                before = (sign < 0) | ((sign == 0) & (not strict))
                low[open_[before]] = middle[before] + 1
                high[open_[~before]] = middle[~before]
            return low

        low, high = bound(True), bound(False)
        count = high - low
        piece = np.repeat(self.ids, count)
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        start = order[at]
        return start, start + np.repeat(self.lengths, count), piece

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        joined = "\0".join(words) + "\0"
        text = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths + 1) - lengths - 1
        start, end, piece = self.edges(text)
        single = np.zeros(len(text) + 1, bool)
        single[start[end - start == 1]] = True
        inside = np.ones(len(text), bool)
        inside[first + lengths] = False
        lost = np.flatnonzero(inside & ~single[:-1])
        start, end = np.concatenate((start, lost)), np.concatenate((end, lost + 1))
        piece = np.concatenate((piece, np.full(len(lost), self.unknown)))
        word_start = np.repeat(first, lengths + 1)
        offset = end - word_start[start]
        order = np.lexsort((start, offset))
        start, end, piece, offset = start[order], end[order], piece[order], offset[order]
        last, back = np.full(len(text) + 1, -1, np.int64), np.full(len(text) + 1, -1, np.int64)
        cuts = np.searchsorted(offset, np.arange(1, int(lengths.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, t = start[a:b], piece[a:b]
            before = np.where(s == word_start[s], -1, last[s])
            fits = np.ones(b - a, bool)
            check = np.flatnonzero(before >= 0)
            if len(check):
                pairs, where = np.unique(before[check] * self._width + t[check], return_inverse=True)
                fits[check] = self.follows(pairs // self._width, pairs % self._width)[where]
            e = end[a:b][fits]
            last[e], back[e] = t[fits], s[fits]
        # walk back from the ends of all words side by side
        steps = []
        at = first + lengths
        owner = np.flatnonzero(lengths > 0)
        at = at[owner]
        while len(owner):
            steps.append((owner, last[at], at - back[at]))
            at = back[at]
            more = at > first[owner]
            owner, at = owner[more], at[more]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word = np.concatenate([x[0] for x in steps])
        ids = np.concatenate([x[1] for x in steps])
        depth = np.concatenate([np.full(len(x[0]), k) for k, x in enumerate(steps)])
        order = np.lexsort((-depth, word))
        word, ids = word[order], ids[order]
        if (ids == self.unknown).any():
            word, ids = self._with_bytes(words, word, ids)
        return ids, np.bincount(word, minlength=len(words))

    def _with_bytes(self, words: list[str], word: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the ids of their bytes."""
        out_word, out_ids, at, now = [], [], 0, -1
        for w, k in zip(word.tolist(), ids.tolist(), strict=True):
            if w != now:
                now, at = w, 0
            if k == self.unknown:
                own = [int(self.byte_ids[b]) for b in words[w][at].encode()]
                at += 1
            else:
                own = [k]
                at += len(self.raw[k].decode())
            out_ids += own
            out_word += [w] * len(own)
        return np.array(out_word, np.int64), np.array(out_ids, np.int64)


class Encoder:
    """Ids of texts; words are remembered."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {}
        self._flat, self._starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words: list[str] = []
        per_text = []
        for text in texts:
            own = _CUT.findall(self.pieces.library.normalize(text)) if text else []
            per_text.append(len(own))
            words += own
        if len(self._number) > KNOWN_WORDS:
            self._clear()
        new = list(dict.fromkeys(w for w in words if w not in self._number))
        if new:
            plain = [w.replace("\0", "￾") for w in new]  # 0 stands between words; no piece has either
            ids, counts = self.pieces.encode_words(plain)
            if any("\0" in w for w in new):
                ids, counts = self._with_zeros(new, ids, counts)
            for w in new:
                self._number[w] = len(self._number)
            self._flat = np.concatenate((self._flat, ids))
            self._starts = np.concatenate((self._starts, self._starts[-1] + np.cumsum(counts)))
        at = np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))
        sizes = self._starts[at + 1] - self._starts[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._flat[np.repeat(self._starts[at] - (ends - sizes), sizes) + np.arange(total)]
        before = np.concatenate(([0], ends))
        upto = np.concatenate(([0], np.cumsum(per_text))).astype(np.int64)
        return np.split(ids, before[upto[1:-1]]) if texts else []

    def _with_zeros(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k, w in enumerate(words):
            if "\0" in w:
                own = [self.pieces.encode_words([x])[0] if x != "\0" else self.pieces.byte_ids[:1] for x in re.findall("\0|[^\0]+", w)]
                parts[k] = np.concatenate(own)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the space that encoding puts first goes."""
        raw = self.pieces.raw
        text = b"".join([raw[k] for k in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    store = sys.modules.setdefault("_kindred_pieces", ModuleType("_kindred_pieces")).__dict__
    if path not in store:
        store[path] = Encoder(path)
    return store[path]


def _encode(path: str, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)

        def encoded(ids: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
            found = own.encode(texts)
            columns = {
                "doc_id": pa.array(ids, kind),
                "n_ids": pa.array(map(len, found), pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                "round_trip": pa.array([own.decode(x) == t for x, t in zip(found, texts, strict=True)], pa.bool_()),
            }
            if with_ids:
                columns["ids"] = pa.array([x.tolist() for x in found], pa.list_(pa.int64()))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                size += len(text or "")
                if size > CHARS_AT_ONCE:
                    yield encoded(ids, texts, batch["doc_id"].type)
                    ids, texts, size = [], [], 0
            if ids:
                yield encoded(ids, texts, batch["doc_id"].type)

    return run


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, round_trip`` and on request ``ids`` of every text."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<long>" * with_ids
    return given.mapInArrow(_encode(path, with_ids), f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean{extra}")


def _decode(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int64)) for x in batch["ids"].to_pylist()]
            yield batch.drop_columns(["ids"]).append_column("text", pa.array(texts, pa.string()))

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``."""
    given = encoded.select("doc_id", "ids")
    return given.mapInArrow(_decode(path), f"doc_id {given.schema['doc_id'].dataType.simpleString()}, text string")
