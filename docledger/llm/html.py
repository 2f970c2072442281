"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams events. Each block of a page, those of menus and footers too, is a line with its text and the
number of its tags; their ratio, smoothed over neighbouring lines with a Gaussian, is clustered by a threshold of one standard
deviation. Lines belong to regions, the nearest container each. A region whose smoothed ratio, weighted by text, reaches the
threshold is content and gives all its lines, so that a short paragraph between long ones stays. Where a page has article or main
elements with text, only regions within them are chosen from, and one below the threshold goes only if most of its text is links.

Menus, headers, footers and the like are lines of the page but never content. An element that a word of its class, id or role marks
(sidebar, share, comments) goes too, but not if it holds most of the text there is to choose from; reader comments go unless nothing
else is left. A mark alone therefore never empties a page.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.words import slices

SIGMA = 1.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no line of the page, and others whose lines are never content.
UNSEEN = frozenset("head title script style noscript template button select textarea iframe object svg canvas audio video".split())
NEVER = frozenset("nav header footer aside form dialog menu".split()) | UNSEEN
MAIN = frozenset(("article", "main"))
CONTAINERS = frozenset("article main section div td body".split())
BLOCKS = frozenset(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of a class, id or role that mark an element as no main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr legal login masthead menu "
    "menubar modal nav navbar navigation newsletter notice outbrain overlay pager pagination popup promo promoted recommended related replies reply search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe taboola teaser toolbar widget".split()
)
#: Marks of what readers wrote, and first words of a class name that only tell of something elsewhere.
READERS = frozenset("comment comments disqus reply replies".split())
TELLING = frozenset("has no with without is".split())
HEADERS = frozenset(("header", "site-header", "page-header", "top-header", "global-header"))
#: A start tag that ends an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
INLINE = frozenset("p li b i a span".split())
SCOPES = frozenset("ul ol table dl div section article main aside nav header footer form body td blockquote".split())


class _Open(NamedTuple):
    name: str = ""
    unseen: bool = False
    out: bool = False
    region: int = 0
    main: bool = False
    mark: int = 0


class _Line(NamedTuple):
    text: str
    tags: int
    linked: int
    out: bool
    region: int
    main: bool
    mark: int


class _Lines(HTMLParser):
    """The lines of a page. Every event takes constant time beside the elements it opens or closes: places of open elements are kept by name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []
        self.outs: list[int] = []  # open elements, not within another such, that are never content or marked
        self.lines: list[_Line] = []
        self.marks: list[tuple[int, bool]] = [(0, False)]  # of each mark: the one around it, whether readers wrote
        self.regions, self.text, self.tags, self.linked, self.seen_main = 1, [], 0, 0, False

    def top(self) -> _Open:
        return self.open[-1] if self.open else _Open()

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                top = self.top()
                self.lines.append(_Line(line, max(self.tags, 1), self.linked, top.out, top.region, top.main, top.mark))
            self.text = []
        self.tags = self.linked = 0

    def pop_to(self, at: int) -> None:
        if any(x.name in BLOCKS or x.name in NEVER for x in self.open[at:]):
            self.end_line()
        for x in reversed(self.open[at:]):
            self.places[x.name].pop()
            if x.name in SCOPES:
                self.scopes.pop()
        while self.outs and self.outs[-1] >= at:
            self.outs.pop()
        del self.open[at:]

    def place(self, name: str) -> int:
        return self.places[name][-1] if self.places[name] else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in MAIN or tag == "body":  # an element left open in front of the main text does not swallow it
            if self.outs and not self.seen_main:
                self.pop_to(self.outs[0])
        if tag in CLOSES:
            at = max(map(self.place, CLOSES[tag]))
            if at >= 0 and (not self.scopes or at >= self.scopes[-1]):
                self.pop_to(at)
        if tag in BLOCKS or tag in NEVER:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        top = self.top()
        out, region, mark = top.out or tag in NEVER, top.region, top.mark
        if tag not in ("html", "body", "main"):
            hidden, marked, readers = _marks(attrs)
            out = out or hidden
            if marked and not out:
                self.marks.append((mark, readers))
                mark = len(self.marks) - 1
        if tag in CONTAINERS or mark != top.mark:
            region, self.regions = self.regions, self.regions + 1
        main = top.main or (tag in MAIN and not out)
        self.seen_main = self.seen_main or (main and not mark)
        if (out or mark) and not (top.out or top.mark):
            self.outs.append(len(self.open))
        self.places[tag].append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append(_Open(tag, top.unseen or tag in UNSEEN, out, region, main, mark))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        at = self.place(tag)
        if at >= 0 and not (tag in INLINE and self.scopes and self.scopes[-1] > at):
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        if not self.top().unseen:
            self.text.append(data)
            if self.places["a"]:
                self.linked += len(data.strip())


def _marks(attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, marked as no main text, marked as readers' text."""
    hidden = marked = readers = False
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for token in value.lower().split():
                told = re.split("[^a-z]+", token)
                if told[0] not in TELLING:
                    marked = marked or token in HEADERS or not MARKS.isdisjoint(told)
                    readers = readers or not READERS.isdisjoint(told)
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
    return hidden, marked, readers


def _unmarked(lines: list[int], size: np.ndarray, page: _Lines) -> list[int]:
    """The lines without those of marked elements; marks that hold more than half of these lines' text do not count, and those of
    readers count as long as anything else is left."""
    held = np.zeros(len(page.marks))
    for i in lines:
        held[page.lines[i].mark] += size[i]
    total = held.sum()
    for m in range(len(held) - 1, 0, -1):
        held[page.marks[m][0]] += held[m]
    for readers_too in (False, True):
        gone = [False] * len(held)
        for m in range(1, len(held)):
            around, readers = page.marks[m]
            gone[m] = gone[around] or 2 * held[m] <= total or (readers and not readers_too)
        left = [i for i in lines if not gone[page.lines[i].mark]]
        if left:
            return left
    return lines


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbours; weights are renewed at the ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[middle] / np.convolve(np.ones(len(values)), kernel)[middle]


def content_lines(html: str) -> list[str]:
    """The blocks of a page's main text, in page order."""
    page = _Lines()
    page.feed(html)
    page.close()
    page.end_line()
    lines = page.lines
    pool = [i for i, x in enumerate(lines) if not x.out]
    if not pool:
        return []
    size = np.array([len(x.text) for x in lines], float)
    ratio = smooth(size / np.array([x.tags for x in lines]))
    threshold = ratio.std()
    main = [i for i in pool if lines[i].main]
    pool = _unmarked(main or pool, size, page)
    _, region = np.unique([lines[i].region for i in pool], return_inverse=True)
    text = np.bincount(region, size[pool])
    content = np.bincount(region, size[pool] * ratio[pool]) / text >= threshold
    if main:
        content |= 2 * np.bincount(region, [lines[i].linked for i in pool]) <= text
    if not content.any():
        content[text.argmax()] = True
    return [lines[i].text for i, r in zip(pool, region, strict=True) if content[r]]


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, kept columns, text, n_chars) of every page: blocks joined by one space; n_chars counts code points.

    Null and empty pages, and pages without main text, give an empty text. Repeated rows each give a row; null keys stay; other
    columns are not read.
    """
    names = [f"k{i}" for i in range(len(keep) + 1)]
    rows = pages.select(*[F.col(c).alias(n) for c, n in zip((key, *keep), names, strict=True)], F.col(html).alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(names)):
                texts = [" ".join(content_lines(x)) if x else "" for x in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    out = rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
    return out.select(*[F.col(n).alias(c) for c, n in zip((key, *keep), names, strict=True)], "text", "n_chars")
