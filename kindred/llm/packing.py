"""Best-fit packing of tokenised documents into sequences by bin completion.

Spark tokenises the documents and cuts longer ones into pieces.  How pieces
share sequences depends on their lengths alone, and there are at most
``capacity`` lengths, so the plan is made from the number of pieces per length.
First the longest piece left is completed by the filling that wastes least, as
often as its lengths last.  Where that needs more sequences than the lower bound
L2 of Martello and Toth, a search goes back to other undominated fillings and
other numbers of repeats, fewest deviations first, and leaves what cannot beat
the best plan.  It ends at the bound, when all is searched, or after ``PLAN_NODES``
steps or ``PLAN_SECONDS`` with the best plan so far.  Spark then numbers the
pieces within their length (salted, so that a length that a third of all pieces
share is not one group) and each number finds its place in the plan.

Nulls: a null text is empty; an empty text is the end id alone.  A null id is
kept.  Equal rows are packed as often as they occur.  An empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import sys
import time
import zlib
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.sources.scratch import Scratch

CAPACITY = 4096
END_ID = 1
# Fillings looked at per step before the best one so far is taken.
SEARCH_NODES = 2000
# Steps and seconds of the search for a plan with fewer sequences.
PLAN_NODES = 20_000
PLAN_SECONDS = 60.0
# Words that a Python worker remembers (and their bytes), bytes of text split and new words encoded at once.
KNOWN_WORDS, KNOWN_BYTES = 500_000, 16 << 20
BYTES_AT_ONCE, WORDS_AT_ONCE = 3 << 20, 8_000
ROWS_PER_SALT, LEAST_SALTS = 20_000, 32

# A word that cannot be part of another one marks the ends of words.
_MARK = "\x00"


class WordIds:
    """Token ids of white-space words, remembered up to ``KNOWN_WORDS`` and ``KNOWN_BYTES``.

    A worker keeps this between tasks, beside the memory of all later steps, so
    words stay in Arrow and no Python object stays per word.

    Valid for tokenizers that never join text across ASCII white space and drop
    it; :func:`tokenizer_is_by_word` tests that.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._encode = Tokenizer.from_file(path).encode_batch_fast
        self._mark = self._encode([_MARK], add_special_tokens=False)[0].ids
        self._clear()

    def _clear(self) -> None:
        # The empty word, between white space and the end of a text, has no ids.
        self._words = pa.array([""], pa.string())
        self._flat = np.zeros(0, np.uint32)
        self._starts = np.zeros(2, np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has; marks between words tell them apart."""
        if len(self._mark) != 1 or any(_MARK in w for w in words):
            ids = [np.array(x.ids, np.uint32) for x in self._encode(words, add_special_tokens=False)]
            return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        between = f" {_MARK} "
        texts = [between.join(words[i : i + 500]) + between for i in range(0, len(words), 500)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self._encode(texts, add_special_tokens=False)])
        is_mark = ids == self._mark[0]
        return ids[~is_mark], np.diff(np.flatnonzero(is_mark), prepend=-1) - 1

    def _learn(self, new: pa.Array) -> None:
        found, lengths = [self._flat], []
        for at in range(0, len(new), WORDS_AT_ONCE):
            words = new.slice(at, WORDS_AT_ONCE).cast(pa.binary()).to_pylist()
            ids, own = self._encode_words([w.decode("utf-8", "replace") for w in words])
            found.append(ids)
            lengths.append(own)
        self._words = pa.concat_arrays([self._words, new])
        self._flat = np.concatenate(found)
        self._starts = np.concatenate((self._starts, self._starts[-1] + np.cumsum(np.concatenate(lengths))))

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids per text (strings, none null).

        Splitting and numbering of the words stay in Arrow; Python sees new
        words only.
        """
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        if len(self._words) > KNOWN_WORDS or self._words.nbytes + words.nbytes > KNOWN_BYTES:
            self._clear()
        number = pc.index_in(words, value_set=self._words)
        is_new = pc.is_null(number)
        number = number.fill_null(0).to_numpy().astype(np.int64)
        new = words.filter(is_new)
        if len(new):
            number[is_new.to_numpy(zero_copy_only=False)] = np.arange(len(self._words), len(self._words) + len(new))
            self._learn(new)
        at = number[coded.indices.to_numpy()]
        sizes = self._starts[at + 1] - self._starts[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        ids = self._flat[np.repeat(self._starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        before = np.concatenate(([0], ends))
        upto = np.concatenate(([0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))))
        return ids, before[upto[1:]] - before[upto[:-1]]


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer; it outlives a task, as Spark reuses its workers."""
    store = sys.modules.setdefault("_kindred_word_ids", ModuleType("_kindred_word_ids"))
    if path not in store.__dict__:
        store.__dict__[path] = WordIds(path)
    return store.__dict__[path]


def tokenizer_is_by_word(path: str) -> bool:
    """Whether the file's rules drop white space before the merges."""
    import json

    with open(path) as file:
        rules = json.load(file)
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    special = [x["content"] for x in rules.get("added_tokens", [])]
    return any(
        x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] for x in steps
    ) and not any(c.isspace() for x in special for c in x)


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    """Pieces of each document, with ids on request."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)

        def pieces(ids: list, texts: pa.Array) -> pa.RecordBatch:
            tokens, counts = known.of_texts(texts)
            out: list[list] = [[], [], [], [], [], []]
            at = 0
            for doc_id, n in zip(ids, counts.tolist(), strict=True):
                own = np.append(tokens[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for piece, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    row = (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part if with_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            count = 6 if with_ids else 5
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out[:count], kinds, strict=False)], names[:count]
            )

        for batch in batches:
            id_type = batch["doc_id"].type
            texts = batch["text"].cast(pa.string()).fill_null("")
            upto = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy())))
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + BYTES_AT_ONCE, "right")) - 1)
                yield pieces(batch["doc_id"].slice(at, end - at).to_pylist(), texts.slice(at, end - at))
                at = end
            # Idle workers stay beside the steps that follow.
            batch = texts = None
            pa.default_memory_pool().release_unused()

    return run


def tokenised_pieces(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and on request ``ids``."""
    if not tokenizer_is_by_word(path):
        raise ValueError("the tokenizer must drop white space before its merges")
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return given.mapInArrow(_cut(path, capacity, end_id, with_ids), schema)


# --- the plan ----------------------------------------------------------------


def best_filling(lengths: list[int], counts: dict[int, int], room: int, nodes: int = SEARCH_NODES) -> list[tuple[int, int]]:
    """``(length, how many)`` of the filling of ``room`` that wastes least.

    ``lengths`` is ascending.  Branches take a length as often as possible
    first and then less often, longest lengths first: a filling is dominated
    by one with a longer piece in the place of a shorter one, so of equal
    waste the first found stands.  A branch ends where even all shorter pieces
    cannot beat the incumbent.
    """
    below = [0]
    for length in lengths:
        below.append(below[-1] + length * counts[length])
    best: list[tuple[int, int]] = []
    least = room
    seen = 0
    stack = [(room, bisect.bisect_right(lengths, room), [])]
    while stack and least and seen < nodes:
        left, upto, taken = stack.pop()
        seen += 1
        if left < least:
            least, best = left, taken
        upto = min(upto, bisect.bisect_right(lengths, left))
        if not upto or left - min(below[upto], left) >= least:
            continue
        length = lengths[upto - 1]
        most = min(counts[length], left // length)
        stack.append((left, upto - 1, taken))  # last: none of this length
        for k in range(1, most + 1):
            stack.append((left - k * length, upto - 1, [*taken, (length, k)]))
    return best


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: L2 of Martello and Toth."""
    if not counts:
        return 0
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    number = np.concatenate(([0], np.cumsum(n)))
    volume = np.concatenate(([0], np.cumsum(n * x)))
    half = int(np.searchsorted(2 * x, capacity, "right"))  # longer ones stand in sequences of their own
    alone = int(number[-1] - number[half])
    aside = np.arange(half)  # shorter ones than this are put aside
    upto = np.maximum(half, np.searchsorted(x, capacity - x[:half], "right"))
    room = (number[upto] - number[half]) * capacity - (volume[upto] - volume[half])
    more = -(-(volume[half] - volume[aside] - room) // capacity)
    return alone + max(0, int(more.max(initial=0)))


Filling = list[tuple[int, int]]


def _greedy(left: dict[int, int], capacity: int, nodes: int) -> list[tuple[Filling, int]]:
    """Fillings and how often each is taken; always the least waste for the longest piece."""
    left = dict(left)
    lengths = list(left)
    steps = []
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        open_lengths = lengths if left[longest] else lengths[:-1]
        filling = best_filling(open_lengths, left, capacity - longest, nodes)
        left[longest] += 1
        wanted = {longest: 1}
        for length, k in filling:
            wanted[length] = wanted.get(length, 0) + k
        times = min(left[length] // k for length, k in wanted.items())
        for length, k in wanted.items():
            left[length] -= k * times
            if not left[length]:
                lengths.remove(length)
        steps.append((list(wanted.items()), times))
    return steps


def _dominates(better: Filling, other: Filling) -> bool:
    """Whether the pieces of ``other`` are seen to fit into those of ``better``."""
    if sum(k for _, k in better) > 64 or sum(k for _, k in other) > 64:
        return False
    rooms = sorted(length for length, k in better for _ in range(k))
    for length, k in sorted(other, reverse=True):
        for _ in range(k):
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                return False
            bisect.insort(rooms, rooms.pop(at) - length)
    return True


def fillings(lengths: list[int], counts: dict[int, int], room: int, waste: int, nodes: int) -> tuple[list[Filling], bool]:
    """Undominated fillings that waste at most ``waste``, least first, and whether these are all."""
    below = [0]
    for length in lengths:
        below.append(below[-1] + length * counts[length])
    found: list[tuple[int, Filling]] = []
    stack = [(room, bisect.bisect_right(lengths, room), [], room + 1)]
    seen = 0
    while stack and seen < nodes:
        left, upto, taken, skipped = stack.pop()
        seen += 1
        fits = bisect.bisect_right(lengths, left)
        if fits < upto:
            upto = fits
        if left - min(below[upto], left) > waste or left >= skipped and left - below[upto] >= skipped:
            continue  # too much waste, or a skipped piece would fit whatever follows
        if not upto:
            if left <= waste and left < skipped:
                found.append((left, taken))
            continue
        length = lengths[upto - 1]
        most = min(counts[length], left // length)
        for k in range(most + 1):
            # of this length some stay out: a filling with room for one more is dominated
            out = skipped if k == counts[length] else min(skipped, length)
            stack.append((left - k * length, upto - 1, [*taken, (length, k)] if k else taken, out))
    found.sort(key=lambda x: (x[0], [(-a, -k) for a, k in x[1]]))
    kept: list[Filling] = []
    for _, filling in found:
        if len(kept) < 200 and not any(_dominates(other, filling) for other in kept):
            kept = [other for other in kept if not _dominates(filling, other)]
            kept.append(filling)
    return kept, not stack and len(kept) < 200


def _search(
    counts: dict[int, int], capacity: int, best: list[tuple[Filling, int]], nodes: int, plan_nodes: int, seconds: float
) -> list[tuple[Filling, int]]:
    """A plan with fewer sequences than ``best`` where one is found, else ``best``."""
    least = sum(times for _, times in best)
    bound = lower_bound(counts, capacity)
    seen, allowed, met_limit = 0, 0, True
    until = time.monotonic() + seconds

    def choices(left: dict[int, int], used: int) -> list[tuple[Filling, int]]:
        """All fillings of the longest piece, as often as they can be; then fewer times."""
        lengths = sorted(left)
        longest = lengths[-1]
        spare = (least - 1 - used) * capacity - sum(x * n for x, n in left.items())
        if spare < 0:
            return []
        rest = {**left, longest: left[longest] - 1}
        open_lengths = lengths if rest[longest] else lengths[:-1]
        room = capacity - longest
        found, complete = fillings(open_lengths, rest, room, spare, nodes)
        if not complete:
            first = best_filling(open_lengths, rest, room, nodes)
            found = [first] + [x for x in found if x != first]
        often, fewer = [], []
        for filling in found:
            wanted = {longest: 1}
            for length, k in filling:
                wanted[length] = wanted.get(length, 0) + k
            waste = capacity - sum(x * k for x, k in wanted.items())
            most = min(left[x] // k for x, k in wanted.items())
            most = min(most, spare // waste) if waste else most
            if most:
                often.append((list(wanted.items()), most))
            while most > 1:
                most //= 2
                fewer.append((list(wanted.items()), most))
        return often + fewer

    def goes_on() -> bool:
        return least > bound and seen < plan_nodes and time.monotonic() < until

    while met_limit and goes_on():
        met_limit = False
        known: dict[tuple, int] = {}  # deviations left when a state was met
        steps: list[tuple[Filling, int]] = []
        start = {x: n for x, n in counts.items() if n}
        frames = [(start, 0, allowed, iter(enumerate(choices(start, 0))))]
        while frames and goes_on():
            left, used, deviations, open_ = frames[-1]
            at, step = next(open_, (None, None))
            if at is None or at > deviations:
                met_limit |= at is not None
                frames.pop()
                if frames:
                    steps.pop()
                continue
            seen += 1
            filling, times = step
            now = dict(left)
            for length, k in filling:
                now[length] -= k * times
                if not now[length]:
                    del now[length]
            total = used + times
            if total + lower_bound(now, capacity) >= least:
                continue
            if not now:
                best, least = [*steps, step], total
                continue
            state = (total, *sorted(now.items()))
            if known.get(state, -1) >= deviations - at:
                continue
            known[state] = deviations - at
            steps.append(step)
            frames.append((now, total, deviations - at, iter(enumerate(choices(now, total)))))
        allowed = 2 * allowed + 1
    return best


def packing_plan(
    counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES, plan_nodes: int = PLAN_NODES,
    seconds: float = PLAN_SECONDS,
) -> dict[int, np.ndarray]:
    """Places by length: rows ``first number, pieces per sequence, first sequence, offset``.

    Piece ``r`` of a length belongs to the last row whose first number is not
    above ``r``.
    """
    given = {length: n for length, n in sorted(counts.items()) if n}
    steps = _search(given, capacity, _greedy(given, capacity, nodes), nodes, plan_nodes, seconds)
    used = dict.fromkeys(given, 0)
    places: dict[int, list[tuple[int, int, int, int]]] = {length: [] for length in given}
    sequence = 0
    for filling, times in steps:
        offset = 0
        for length, k in filling:
            places[length].append((used[length], k, sequence, offset))
            used[length] += k * times
            offset += k * length
        sequence += times
    return {length: np.array(rows, np.int64).T for length, rows in places.items()}


def _place(plan: dict[int, np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for own in np.unique(length).tolist():
                at = np.flatnonzero(length == own)
                first, k, first_sequence, first_offset = plan[own]
                row = np.searchsorted(first, number[at], "right") - 1
                step = number[at] - first[row]
                sequence[at] = first_sequence[row] + step // k[row]
                offset[at] = first_offset[row] + step % k[row] * own
            kept = batch.drop_columns(["number"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> DataFrame:
    """``pieces`` (a stored table) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = packing_plan(counts, capacity, nodes)
    salts = max(LEAST_SALTS, -(-max(counts.values(), default=0) // ROWS_PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
        .drop("n")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("row", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    numbered = numbered.select(*pieces.columns, (F.col("before") + F.col("row")).alias("number"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(_place(plan), f"{columns}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, scratch: Scratch, path: str, **options) -> DataFrame:
    """Pieces of all documents with their place in the sequences."""
    capacity = options.get("capacity", CAPACITY)
    return pack(scratch.keep(tokenised_pieces(docs, path, **options), "pieces"), capacity)
