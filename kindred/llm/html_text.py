"""Main text of web pages by composite text density.

Every node of the page gets its characters per tag, adjusted for links; the
subtree whose children's densities have the largest sum is the core of the
page.  The smallest density on the way from there to the body is the threshold:
neighbours along that way that reach it belong to the article too.  Where the
core lies in an ``article``, the outermost one is the text, with headings that
stand before it (so is the only article inside the core, if it holds a quarter
of its text); in a ``main`` without one, neighbours need half the threshold.

What is boilerplate by its element (menus, scripts, ...) is left out before
densities are computed.  A class, id or role and a form only make a subtree
doubtful.  Outside ``article`` and ``main`` it is left out unless it holds one of
them, or holds blocks and more text outside links than the rest of the page, or
nothing would be left without the doubtful ones.  Inside, names made only of
words for adverts, reader comments, consent and the like (``PLAIN_WORDS``) leave
it out under the same terms, other names (``search-methods``, ``notice``) only
where most of its text are links or it has less than half the article's text
per tag.  A button that is no part of a sentence is doubtful in the same way.

Nulls: a null page is empty; a page without text gives an empty text.  Pages
are independent, so repeated rows give repeated results.  Very long and hostile
pages: one pass forward, open elements are found by their name, so the time
grows with the length of the page.  A quote that stays open up to the end of the
page hides no ``>``, neither there nor in later tags; a tag that never ends is
text, as is a character reference without a number Unicode has (one U+FFFD).
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
WALLS = frozenset("table ul ol dl body html article section div".split())
P_WALLS = WALLS - {"div", "section", "article"}
# Elements and class words of what is not the article.
DROPPED = RAW | frozenset("head nav footer aside menu select option dialog object canvas audio video input".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup popover promo promoted promotion recommended related reply replies respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
# Of these, the ones that no part of an article is named by, and words that only say how a part is built.
PLAIN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus gdpr menubar nav navbar navigation newsletter pager pagination promo promoted share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget widgets".split()
)
BUILT_WORDS = frozenset(
    "area bar block body bottom box buttons container content form inner item left links list notice banner right section slot "
    "text thread top unit wrap wrapper reader user".split()
)
# Beside one of these, a class word says something about another part of the page.
DENIALS = frozenset("no not non has have with without free enabled disabled".split())

_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_QUOTED = re.compile(r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_LONG_NUMBER = re.compile(r"&#([0-9]{8,}+);?")


def _decode(text: str) -> str:
    """Character references decoded, numbers of any length included."""

    def number(m: re.Match) -> str:
        digits = m[1].lstrip("0") or "0"
        return html.unescape(f"&#{digits};") if len(digits) < 8 else "\ufffd"

    return html.unescape(_LONG_NUMBER.sub(number, text) if "&#" in text else text)


class Page:
    """Nodes of a page in document order, and its runs of text."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped = ["#"], [-1], [False]
        self.doubtful: dict[int, bool] = {}  # whether it is named by plain words only
        self.in_article = [False]  # whether an ``article`` or ``main`` is around the node
        self.runs: list[tuple[int, str]] = []  # node, text; "" ends a block
        self._stack = [0]
        self._depths: dict[str, list[int]] = defaultdict(list)  # of open nodes, by tag
        self._parse(source)

    def _judge(self, tag: str, attributes: str, in_article: bool) -> tuple[bool, bool | None]:
        """Whether a node is left out, and if it is doubtful whether plainly so."""
        doubtful = True if tag == "form" else False if tag == "button" else None
        dropped = tag == "header" and not in_article
        if attributes and tag not in ("html", "body", "main") and (tag != "article" or self._depths["article"]):
            given: dict[str, str] = {}
            for name, *values in _ATTRIBUTE.findall(attributes):
                given.setdefault(name.lower(), _decode("".join(values)))
            dropped |= "hidden" in given or bool(_NO_DISPLAY.search(given.get("style", "")))
            for name in " ".join(given.get(k, "") for k in ("class", "id", "role")).lower().split():
                words = {w for w in re.split(r"[^a-z]+", name) if w}
                if not words & DENIALS and (words & DROPPED_WORDS or ("header" in words and not in_article)):
                    plain = bool(words & PLAIN_WORDS) and words <= PLAIN_WORDS | BUILT_WORDS
                    doubtful = bool(doubtful) or plain
        return dropped, doubtful

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._close(("p",), P_WALLS)
            self.runs.append((self._stack[-1], ""))
        if tag in CLOSES:
            self._close(CLOSES[tag], WALLS)
        node, parent = len(self.tags), self._stack[-1]
        in_article = bool(self._depths["article"] or self._depths["main"])
        dropped = self.dropped[parent] or tag in DROPPED
        if not dropped:
            dropped, doubtful = self._judge(tag, attributes, in_article)
            if doubtful is not None and not dropped:
                self.doubtful[node] = doubtful
        self.tags.append(tag)
        self.parents.append(parent)
        self.dropped.append(dropped)
        self.in_article.append(in_article)
        if tag == "br" or tag == "hr":
            self.runs.append((parent, " "))
        if tag not in VOID:
            self._depths[tag].append(len(self._stack))
            self._stack.append(node)

    def _close(self, names: Iterable[str], walls: Iterable[str] = ()) -> None:
        """Close the nearest open node of ``names``, unless a wall is nearer."""
        depths = self._depths
        depth = max([depths[tag][-1] for tag in names if depths[tag]], default=0)
        if not depth or any(depths[tag] and depths[tag][-1] >= depth for tag in walls):
            return
        closed = self._stack[depth:]
        if any(self.tags[k] in BLOCK for k in closed):
            self.runs.append((closed[0], ""))
        for k in closed:
            self._depths[self.tags[k]].pop()
        del self._stack[depth:]

    def _parse(self, source: str) -> None:
        at = look = 0  # from where text is not yet taken, and a tag is looked for
        last, quotes = source.rfind(">"), True
        while m := _START.search(source, look):
            comment = m[0] == "<!--"
            if not comment and m.end() > last:
                look = m.end()
                continue
            if m.start() > at:
                self.runs.append((self._stack[-1], _decode(source[at : m.start()])))
            if comment:
                end = source.find("-->", m.end())
                at = look = end + 3 if end >= 0 else len(source)
                continue
            whole = _QUOTED.match(source, m.end()) if m[2] and quotes else None
            if m[2] and not whole:
                quotes = False
            at = look = whole.end() if whole else source.index(">", m.end()) + 1
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag not in VOID:
                    self._close((tag,))
                continue
            self._open(tag, source[m.end() : at - 1])
            if tag in RAW and tag not in VOID:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = look = source.find(">", end.end()) + 1 if end and end.end() <= last else len(source)
                self._depths[tag].pop()
                self._stack.pop()
        if at < len(source):
            self.runs.append((self._stack[-1], _decode(source[at:])))


def _settle(page: Page, in_link: list[bool]) -> None:
    """Drop the doubtful subtrees that are not the article."""
    n = len(page.tags)
    plain, linked = [0] * n, [0] * n
    holds = [tag in ("article", "main") and not gone for tag, gone in zip(page.tags, page.dropped, strict=True)]
    for k, text in page.runs:
        if not page.dropped[k]:
            (linked if in_link[k] else plain)[k] += len("".join(text.split()))
    blocks = [False] * n  # whether a block lies inside
    own, size = plain[:], [int(not gone) for gone in page.dropped]
    for k in range(n - 1, 0, -1):
        parent = page.parents[k]
        plain[parent] += plain[k]
        linked[parent] += linked[k]
        size[parent] += size[k]
        holds[parent] |= holds[k]
        blocks[parent] |= not page.dropped[k] and (blocks[k] or page.tags[k] in BLOCK)
    article = [0] * n  # the outermost one around a node
    for k in range(1, n):
        article[k] = article[page.parents[k]] or (k if page.tags[k] in ("article", "main") else 0)
    rest, parts = plain[:], size[:]  # of an article without its doubtful parts
    inside: list[bool] = [False] * n  # of a doubtful part already counted
    for k in range(1, n):
        inside[k] = inside[page.parents[k]]
        if k in page.doubtful and page.in_article[k] and not inside[k]:
            inside[k] = True
            rest[article[k]] -= plain[k]
            parts[article[k]] -= size[k]
    gone = [False] * n
    for k, named in page.doubtful.items():
        if page.tags[k] == "button" and own[page.parents[k]]:
            continue
        if not page.in_article[k]:
            gone[k] = not (holds[k] or blocks[k] and 2 * plain[k] > plain[0])
        elif named:
            gone[k] = not (blocks[k] and 2 * plain[k] > plain[0])
        else:
            around = article[k]
            sparse = 2 * plain[k] * parts[around] < rest[around] * size[k]
            gone[k] = sparse or linked[k] > plain[k]
    for k in range(1, n):
        gone[k] |= gone[page.parents[k]]
    if any(count and not out for count, out in zip(own, gone, strict=True)):
        page.dropped = [a or b for a, b in zip(page.dropped, gone, strict=True)]


def main_text(source: str) -> str:
    """Blocks of the article, two line breaks between them."""
    page = Page(source)
    n = len(page.tags)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = page.tags[k] == "a" or in_link[page.parents[k]]
    if page.doubtful:
        _settle(page, in_link)
    for k, text in page.runs:
        if not page.dropped[k]:
            size = len("".join(text.split()))
            chars[k] += size
            link_chars[k] += size * in_link[k]
    for k in range(n - 1, 0, -1):  # children stand after their parents
        if page.dropped[k]:
            continue
        parent = page.parents[k]
        tags[parent] += tags[k] + 1
        link_tags[parent] += link_tags[k] + (page.tags[k] == "a")
        chars[parent] += chars[k]
        link_chars[parent] += link_chars[k]
    if not chars[0]:
        return ""
    share = link_chars[0] / chars[0]

    def density(k: int) -> float:
        """Composite text density; a count of zero stands as one."""
        c, t = chars[k], max(1, tags[k])
        if not c:
            return 0.0
        links, plain, lt = max(1, link_chars[k]), max(1, c - link_chars[k]), max(1, link_tags[k])
        base = math.log(c / plain * link_chars[k] + share * c + math.e)
        return c / t * max(0.0, math.log(c / links * t / lt + 1)) / max(1e-9, math.log(base + math.e - 1))

    dense = [0.0 if page.dropped[k] else density(k) for k in range(n)]
    sums = [0.0] * n
    for k in range(1, n):
        sums[page.parents[k]] += dense[k]
    body = next((k for k in range(n) if page.tags[k] == "body"), 0)
    inside = [False] * n
    inside[body] = True
    for k in range(body + 1, n):
        inside[k] = inside[page.parents[k]]
    best = max((k for k in range(n) if inside[k] and not page.dropped[k]), key=lambda k: sums[k], default=body)
    under, nested, articles = [False] * n, [False] * n, []  # outermost articles inside the core
    for k in range(best, n):
        parent = page.parents[k]
        under[k] = k == best or under[parent]
        nested[k] = k != best and (nested[parent] or page.tags[parent] == "article")
        if under[k] and page.tags[k] == "article" and not nested[k] and not page.dropped[k]:
            articles.append(k)
    if len(articles) == 1 and 4 * chars[articles[0]] >= chars[best]:
        best = articles[0]
    path = [best]
    while path[-1] != body and page.parents[path[-1]] >= 0:
        path.append(page.parents[path[-1]])
    threshold = min(dense[k] for k in path)
    around = next((k for tag in ("article", "main") for k in reversed(path) if page.tags[k] == tag), 0)
    whole = around if page.tags[around] == "article" else best
    taken, on_path = {whole}, set(path)
    in_main = [False] * n
    for k in range(1, n):
        parent = page.parents[k]
        in_main[k] = in_main[parent] or page.tags[k] == "main"
        if parent not in on_path or k in on_path or page.dropped[k]:
            continue
        heading = page.tags[k] in ("h1", "h2", "h3")
        if page.tags[whole] == "article":
            beside = heading and k < whole
        else:
            enough = dense[k] >= (threshold / 2 if in_main[k] else threshold)
            beside = heading or enough and 2 * link_chars[k] < chars[k]
        if beside:
            taken.add(k)
    kept = [False] * n
    for k in range(n):
        kept[k] = not page.dropped[k] and (k in taken or k > 0 and kept[page.parents[k]])
    blocks, now = [], []
    for k, text in [*page.runs, (0, "")]:
        if not text:
            block = " ".join("".join(now).split())
            if block:
                blocks.append(block)
            now = []
        elif kept[k]:
            now.append(text)
    return "\n\n".join(blocks)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x or "") for x in batch["html"].to_pylist()]
        yield batch.drop_columns(["html"]).append_column("text", pa.array(texts, pa.string())).append_column(
            "n_chars", pa.array(map(len, texts), pa.int64())
        )


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
