"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds the anchors: at-signs
(also written ``[at]``), plus signs, digits, schemes and identifier cues.  A
parser that belongs to the anchor expands it to both sides and validates what it
finds.  Base spans are, kind by kind, the leftmost non-overlapping matches of
fixed shapes; a match that fails its check is used up.  Further spans come from
parsers that know more than the shape:

* ``email``: letters of any script, and written-out at-signs and dots;
* ``card``: a number of its own inside a longer chain of numbers that failed as
  a whole, grouped as cards are, with an issuer's first digit;
* ``phone``: digits after ``tel:``;
* ``account``: an IBAN after its cue, by country length rule and remainder 1;
* ``ssn``: nine digits after their cue, without the numbers never given out;
* ``url``: an address that carries a user's name or password.

A further span is never equal to a base one.  Offsets are code points.

Every anchor moves on from where the last expansion of its kind ended, so a
text is read a bounded number of times however long it is.

Nulls: a null text is empty; a null id is kept.  Rows are independent, so
repeated rows give repeated results.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which they are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "ssn", "url")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?)"
_SPELLED = re.compile(rf"\s?([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,24}})\b", re.I)
_TEL = re.compile(r"\+?[0-9](?:[ ().-]?[0-9]){6,14}")
_CUE_GAP = re.compile(r"(?:[ ]?(?:no|nr|number|num)\b\.?)?[ ]?[:#=]?[ ]?", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?!000|666|9)([0-9]{3})([- ]?)(?!00)[0-9]{2}\2(?!0000)[0-9]{4}(?![0-9])")
_USER = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=:-]{1,256}@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s\"<>]*)?")

# Groups of digits that cards are printed in.
_CARD_GROUPS = ((14,), (15,), (16,), (17,), (18,), (19,), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))


def _spellings(*words: str) -> list[str]:
    return sorted({form for w in words for form in (w, w.upper(), w.capitalize())})


@lru_cache(maxsize=1)
def _anchors():
    """The automaton; values are ``(what, length)``."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    groups = {
        "at": ["@"], "spelled": _spellings("[at]", "(at)"), "plus": ["+"], "digit": list("0123456789"),
        "scheme": ["://"], "tel": _spellings("tel:"), "iban": _spellings("iban"),
        "ssn": _spellings("ssn", "social security"),
    }
    for what, words in groups.items():
        for word in words:
            automaton.add_word(word, (what, len(word)))
    automaton.make_automaton()
    return automaton


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _is_card(digits: str) -> bool:
    return 14 <= len(digits) <= 19 and passes_luhn(digits)


def _cards_inside(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Cards that stand as whole groups inside a chain that is none."""
    groups = [(m.start(), m.end()) for m in _DIGITS.finditer(text, start, end)]
    at = 0
    while at < len(groups):
        for shape in _CARD_GROUPS:
            own = groups[at : at + len(shape)]
            if [b - a for a, b in own] == list(shape) and len(own) < len(groups):
                digits = "".join(text[a:b] for a, b in own)
                if digits[0] in "23456" and passes_luhn(digits):
                    yield own[0][0], own[-1][1]
                    at += len(shape) - 1
                    break
        at += 1


def _left_of(text: str, at: int, low: int, wide: bool = False) -> int:
    """Start of the local part that ends at ``at``, not before ``low``."""
    while at > low and (text[at - 1] in _LOCAL or wide and text[at - 1].isalnum()):
        at -= 1
    return at


def _valid_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
    return int(number) % 97 == 1


def personal_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """``kind, start, end, base`` of a text, by start, kind as listed and end."""
    found: list[tuple[str, int, int, bool]] = []
    more: list[tuple[str, int, int]] = []
    email_end = wide_end = ip_end = chain_end = cue_end = 0
    n = len(text)
    for last, (what, size) in _anchors().iter(text):
        start, after = last - size + 1, last + 1
        if what == "digit":
            if start >= ip_end:
                m = _IP.match(text, start)
                if m:
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                        found.append(("ip", start, ip_end, True))
                else:  # no start within this run of digits can match
                    ip_end = _DIGITS.match(text, start).end()
            if start >= chain_end:
                m = _CHAIN.match(text, start)
                chain_end = m.end() if m else after
                if m and chain_end - start >= 14:
                    if _is_card(m[0].replace(" ", "").replace("-", "")):
                        found.append(("card", start, chain_end, True))
                    else:
                        more += [("card", a, b) for a, b in _cards_inside(text, start, chain_end)]
        elif what == "at":
            first = _left_of(text, start, email_end)
            m = _DOMAIN.match(text, after) if first < start else None
            if m:
                email_end = m.end()
                found.append(("email", first, email_end, True))
            # letters of other scripts to either side
            beside = (text[first - 1] if first > wide_end else "") + (text[after] if after < n else "")
            beside += text[m.end()] if m and m.end() < n else ""
            if not beside.isascii():
                first = _left_of(text, start, max(wide_end, cue_end), True)
                while first < start and not text[first].isalnum():
                    first += 1
                m = _WIDE_DOMAIN.match(text, after) if first < start else None
                if m and not text[first : m.end()].isascii():
                    wide_end = m.end()
                    more.append(("email", first, wide_end))
        elif what == "plus":
            m = _PHONE.match(text, start)
            if m and 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", start, m.end(), True))
        elif start < cue_end:
            continue
        elif what == "spelled":
            gap = start - (start > 0 and text[start - 1] == " ")
            first = _left_of(text, gap, cue_end)
            m = _SPELLED.match(text, after) if first < gap else None
            if m:
                cue_end = m.end()
                more.append(("email", first, cue_end))
        elif what == "scheme":
            m = _USER.match(text, after)
            first = start
            while first > cue_end and start - first < 16 and (text[first - 1].isascii() and text[first - 1].isalpha()):
                first -= 1
            if m and first < start:
                cue_end = m.end()
                more.append(("url", first, cue_end))
        elif what == "tel":
            m = _TEL.match(text, after)
            if m and (start == 0 or not text[start - 1].isalnum()):
                cue_end = m.end()
                more.append(("phone", after, cue_end))
        elif start and text[start - 1].isalnum() or after < n and text[after].isalpha():
            continue  # inside a longer word
        elif what == "iban":
            gap = _CUE_GAP.match(text, after).end()
            m = _IBAN.match(text, gap)
            for end in range(m.end(), gap + 14, -1) if m else ():
                if text[end - 1] != " " and not text[end : end + 1].isalnum() and _valid_iban(text[gap:end]):
                    cue_end = end
                    more.append(("account", gap, end))
                    break
        else:
            gap = _CUE_GAP.match(text, after).end()
            m = _SSN.match(text, gap)
            if m:
                cue_end = m.end()
                more.append(("ssn", gap, cue_end))
    base = {x[:3] for x in found}
    found += [(*x, False) for x in dict.fromkeys(more) if x not in base]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    names = ("kind", "start", "end", "base")
    for batch in batches:
        spans = [
            [dict(zip(names, s, strict=True)) for s in personal_spans(x or "")] for x in batch["text"].to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], ["doc_id", "spans"])


_SPANS = "spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` of every document; nothing is shuffled."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(_find, f"doc_id {kind}, {_SPANS}")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _mask(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    out, at = [], 0
    for kind, start, end, _ in spans:
        if end > at:
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join(out) + text[at:]


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with the kind's name in place of each span of the text.

    Spans that overlap are masked together under the name of the first.  A null
    text stays null.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x if x is None else _mask(x, personal_spans(x)) for x in batch[text].to_pylist()]
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
