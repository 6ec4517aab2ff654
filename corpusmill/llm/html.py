"""Main text of web pages by tag-path ratios.

Every stretch of text of a page hangs at a path of tags from the root, class names
included. For each path the text length and the punctuation per stretch are summed up; both
ratios are smoothed along the page, multiplied, and a path counts as content where the
product reaches a share of the page's spread. Paths through elements that never hold the
article, such as menus or forms, are left out before. Pages are independent, so the work is
one pass over the table without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ship_package

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)",
    re.S,
)
SPECIAL = re.compile(r"[>\"']")
# Names begin where no other character of a name stands before: each is tried once.
ATTRIBUTE = re.compile(r"""(?<![^\s=/>"'])(?P<name>[^\s=/>"']++)\s*+=\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)'|(?P<p>[^\s>]+))""")
WHITE = re.compile(r"\s+")
NAME_PART = re.compile(r"[a-z]+")
MARKS = frozenset(".,;:!?…。，、；：！？")

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select xmp".split())
APART = RAW | frozenset("nav header footer aside form button head menu dialog label fieldset canvas audio video map datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag that ends the open element of these names.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# Words in class, id and role that name a part of the page other than the article.
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(frozen=True)
class HtmlSettings:
    """Width of smoothing in blocks and the share of the spread at which a path is content."""

    width: float = 1.0
    share: float = 0.5


@dataclass(frozen=True)
class Block:
    path: int  # number of the tag path on its page
    parent: int  # number of the path above
    text: str
    inside: bool  # below an article or main element
    heading: bool


@dataclass(frozen=True)
class Element:
    tag: str
    path: int
    parent: int
    side: bool
    inside: bool
    heading: bool


def _is_side(tag: str, attributes: str) -> bool:
    if tag in APART:
        return True
    if "=" in attributes and tag not in ("html", "body", "article", "main"):
        for m in ATTRIBUTE.finditer(attributes):
            name = m["name"].lower()
            value = (m["d"] or m["s"] or m["p"] or "").lower()
            if name in ("class", "id", "role") and not SIDE_NAMES.isdisjoint(NAME_PART.findall(value)):
                return True
            if name == "aria-hidden" and value == "true":
                return True
            if name == "style" and "display:none" in value.replace(" ", ""):
                return True
    return any(x.lower() == "hidden" for x in attributes.split() if "=" not in x)


def _label(tag: str, attributes: str) -> str:
    """Name of an element in a path: its tag and the class."""
    if "class" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            if m["name"].lower() == "class":
                return f"{tag}.{(m['d'] or m['s'] or m['p'] or '').strip()}"
    return tag


class PageBlocks:
    """Blocks of text of one page, in page order, without those of side elements."""

    def __init__(self) -> None:
        self.stack = [Element("", 0, 0, False, False, False)]
        self.numbers: dict[tuple[int, str], int] = {}
        self.counts: Counter = Counter()  # open elements by tag
        self.side = 0
        self.parts: list[str] = []
        self.blocks: list[Block] = []

    def text(self, raw: str) -> None:
        if not self.side and raw:
            self.parts.append(html.unescape(raw) if "&" in raw else raw)

    def flush(self) -> None:
        if self.parts:
            text = WHITE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(top.path, top.parent, text, top.inside, top.heading))

    def push(self, tag: str, attributes: str) -> None:
        top, side = self.stack[-1], _is_side(tag, attributes)
        path, parent = top.path, top.parent
        if tag in BLOCKS:
            parent = path
            path = self.numbers.setdefault((path, _label(tag, attributes)), len(self.numbers) + 1)
        inside, heading = top.inside or tag in ARTICLE_TAGS, top.heading or tag in HEADINGS
        self.stack.append(Element(tag, path, parent, side, inside, heading))
        self.counts[tag] += 1
        self.side += side

    def pop(self) -> None:
        gone = self.stack.pop()
        self.counts[gone.tag] -= 1
        self.side -= gone.side

    def close_open(self, names: set[str], limits: set[str]) -> None:
        """End the innermost open element of the names, unless one of the limits is open inside."""
        if not any(self.counts[n] for n in names):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in limits:
                return
            if self.stack[at].tag in names:
                while len(self.stack) > at:
                    self.pop()
                return

    def open(self, tag: str, attributes: str, alone: bool) -> None:
        if tag in BLOCKS:
            self.flush()
            self.close_open({"p"}, APART | {"td", "th", "li", "button"}) if tag != "br" else None
        if tag in ENDS:
            self.close_open(ENDS[tag], LIMITS.get(tag, set()))
        if tag not in VOID and not alone:
            self.push(tag, attributes)

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.counts[tag]:
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()


class TagEnds:
    """Ends of tags, in time that grows with the page only, however many tags are broken.

    A scan from a tag's name hops over quoted values. One that meets a quote without its
    partner fails, and so does every later scan that comes past one of its stops; these are
    remembered, so no stop is passed twice in vain.
    """

    def __init__(self, page: str):
        self.page = page
        self.doomed: set[int] = set()
        self.stretch = (0, -1)  # between these places the next stop is the second

    def _stop(self, at: int) -> int:
        """The next bracket or quote from ``at`` on, the page's length if there is none."""
        begin, stop = self.stretch
        if not begin <= at <= stop:
            m = SPECIAL.search(self.page, at)
            stop = m.start() if m else len(self.page)
            self.stretch = (at, stop)
        return stop

    def find(self, at: int) -> int:
        """Place of the bracket that ends the tag, the page's length without one, -1 for an open quote."""
        passed = []
        while True:
            stop = self._stop(at)
            if stop == len(self.page) or self.page[stop] == ">":
                return stop
            passed.append(stop)
            partner = -1 if stop in self.doomed else self.page.find(self.page[stop], stop + 1)
            if partner < 0:
                self.doomed.update(passed)
                return -1
            at = partner + 1


def page_blocks(page: str) -> list[Block]:
    """Parse a page, however broken: unclosed elements end with their parents or the page."""
    blocks, at, size, ends = PageBlocks(), 0, len(page), TagEnds(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            blocks.text(page[at:])
            break
        m = TOKEN.match(page, mark)
        end = ends.find(m.end()) if m and m["tag"] else None
        if m is None or end == -1:  # a plain "<"
            blocks.text(page[at : mark + 1])
            at = mark + 1
            continue
        blocks.text(page[at:mark])
        at = m.end() if end is None else min(end + 1, size)
        if m["cdata"] is not None:
            blocks.text(m["cdata"])
        elif m["tag"]:
            tag, attributes = m["tag"].lower(), page[m.end() : end]
            alone = attributes.endswith("/")
            if m["close"]:
                blocks.close(tag)
            elif tag in RAW and not alone:
                last = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                close = page.find(">", last.end()) if last else -1
                at = close + 1 if close >= 0 else size
            else:
                blocks.open(tag, attributes[:-1] if alone else attributes, alone and tag not in BLOCKS)
    blocks.flush()
    return blocks.blocks


def _smooth(values: np.ndarray, width: float) -> np.ndarray:
    """Gaussian smoothing along the page; the ends are repeated."""
    reach = max(1, math.ceil(width))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    padded = np.concatenate([[values[0]] * reach, values, [values[-1]] * reach])
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def content_blocks(blocks: list[Block], s: HtmlSettings) -> list[Block]:
    """Blocks at the paths whose smoothed, fused ratio of text and punctuation is high.

    Where a page has an article or main element, other paths don't compete. A heading goes
    with the content of its parent path, which has little punctuation of its own.
    """
    if any(b.inside for b in blocks):
        blocks = [b for b in blocks if b.inside]
    if not blocks:
        return []
    sums: dict[int, list[float]] = {}
    for b in blocks:
        total = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        total[0] += len(b.text)
        total[1] += sum(c in MARKS for c in b.text)
        total[2] += 1
    lengths = np.array([sums[b.path][0] / sums[b.path][2] for b in blocks])
    marks = np.array([sums[b.path][1] / sums[b.path][2] for b in blocks])
    fused = np.sqrt(_smooth(lengths, s.width) * (1 + _smooth(marks, s.width)))
    best: dict[int, float] = {}
    for b, x in zip(blocks, fused):
        best[b.path] = max(best.get(b.path, 0.0), float(x))
    limit = s.share * float(np.std(fused)) if len(best) > 1 else 0.0
    chosen = {path for path, x in best.items() if x >= limit}
    parents = {b.parent for b in blocks if b.path in chosen}
    return [b for b in blocks if b.path in chosen or (b.heading and b.parent in parents)]


def main_text(page: str, s: HtmlSettings = HtmlSettings()) -> str:
    """Content blocks of a page, two line feeds between them."""
    return "\n\n".join(b.text for b in content_blocks(page_blocks(page), s))


def extract(pages: DataFrame, s: HtmlSettings = HtmlSettings(), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page row.

    A NULL or empty page, and one without content, has an empty text. Repeated rows repeat;
    NULL in other columns stays.
    """
    ship_package(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("page_id"), F.col("url"), F.col(html_col).alias("html"))
    kinds = [source.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", s) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return source.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
