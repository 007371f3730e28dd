"""Chat formatting by a finite-state machine and a declarative template.

The template names, per role, what stands before and after a turn and whether
its text counts for the loss.  Texts are escaped so that no control string of
the template can occur inside one, and the output can be read back.

Rows are dealt out by conversation and sorted by turn; one pass with bounded
memory writes the segments, so a conversation of any length passes as a stream.

Nulls: a null text or role is empty.  An unknown role is written under a
generic mark and is never in order.  Rows with equal turn numbers go by role,
then text.  A null conversation id is a conversation of its own.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a chat format, and the order in which roles may follow."""

    before: dict[str, str] = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
    )
    other: tuple[str, str] = ("### Role ", "</role>")
    after: str = "</turn>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
        }
    )

    def controls(self) -> list[str]:
        return sorted({x.strip() for x in (*self.before.values(), *self.other, self.after)}, key=len, reverse=True)


_ESCAPED = re.compile(r"\\(.)", re.S)


class Formatter:
    """Writes and reads turns of one template."""

    def __init__(self, template: Template):
        self.template = template
        controls = "|".join(map(re.escape, template.controls()))
        self._escape = re.compile(rf"\\|(?:{controls})")
        marks = "|".join(re.escape(x) for x in sorted(template.before.values(), key=len, reverse=True))
        named, close = map(re.escape, template.other)
        body = r"((?:\\.|(?!" + re.escape(template.after) + r")[^\\])*)"
        self._turn = re.compile(rf"(?:({marks})|{named}{body.replace(re.escape(template.after), close)}{close}){body}{re.escape(template.after)}", re.S)
        self._role = {v: k for k, v in template.before.items()}

    def escape(self, text: str) -> str:
        """A backslash doubles; a control string gets one after its first character."""
        return self._escape.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return _ESCAPED.sub(r"\1", text)

    def write(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of a turn and whether they count for the loss."""
        t = self.template
        head = t.before.get(role) or f"{t.other[0]}{self.escape(role)}{t.other[1]}"
        return [(head, False), (self.escape(text), role in t.loss), (t.after, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """``role, text`` of every turn."""
        at = 0
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            yield (self._role[m[1]] if m[1] else self.unescape(m[2])), self.unescape(m[3])
            at = m.end()


_TURNS = "conv_id long, number long, in_order boolean, segments array<struct<text: string, loss: boolean>>"


def _write(template: Template):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter, now, state, number = Formatter(template), object(), "", 0
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            numbers, order, segments = [], [], []
            rows = zip(*[batch[c].to_pylist() for c in ("conv_id", "role", "text")], strict=True)
            for conv_id, role, text in rows:
                if conv_id != now:
                    now, state, number = conv_id, "", 0
                role = role or ""
                order.append(role in template.follows.get(state, ()))
                numbers.append(number)
                segments.append([{"text": x, "loss": loss} for x, loss in formatter.write(role, text or "")])
                state, number = role or "?", number + 1
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], pa.array(numbers, pa.int64()), pa.array(order, pa.bool_()), pa.array(segments, kind)],
                ["conv_id", "number", "in_order", "segments"],
            )

    return run


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, number, in_order, segments`` per turn, conversations together and in order.

    The text of a conversation is that of its segments one after another.
    """
    given = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_write(template or Template()), _TURNS)


_DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"
)


def _read_back(template: Template):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(template)
        names = [x.split()[0] for x in _DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        now, done = None, []

        def digest(c: dict) -> tuple:
            return (c["id"], c["turns"], c["all"].hexdigest(), c["loss_chars"], c["loss"].hexdigest(), c["chars"], c["ok"])

        for batch in batches:
            rows = zip(*[batch[c].to_pylist() for c in ("conv_id", "in_order", "segments")], strict=True)
            for conv_id, ok, segments in rows:
                if now is None or conv_id != now["id"]:
                    if now:
                        done.append(digest(now))
                    now = {"id": conv_id, "turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "ok": True}
                formatted = "".join(s["text"] for s in segments)
                now["chars"] += len(formatted)
                now["ok"] &= ok
                for role, text in formatter.read(formatted):
                    now["turns"] += 1
                    now["all"].update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        text = formatter.unescape(s["text"])
                        now["loss_chars"] += len(text)
                        now["loss"].update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(digest(now), kinds, strict=True)], names)

    return run


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of what the output of :func:`format_turns` says when it is read again."""
    return formatted.mapInArrow(_read_back(template or Template()), _DIGESTS)
