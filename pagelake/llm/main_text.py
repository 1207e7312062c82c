"""The main text of HTML pages, from parser events and text-to-tag ratios.

The standard library's parser streams through a page once. Its events cut the page into
lines: what lies between two block-level tags. Each line has a text-to-tag ratio, the
length of its text outside links over its number of tags. The ratios are smoothed with a
Gaussian, so that a short paragraph among long ones is carried by them, and clustered by a
threshold: two means of the smoothed ratios, and the middle between them. The lines above
it mark the content; the smallest element that holds most of their text is the content
region, narrowed down to the block of several lines if the others are lone ones. Of the
region every line is kept, short or long.

What elements, roles, classes and ids say of menus, notices and the like is a prior beside
that: lines they give away do not count for the region and are left out of it. Without it
the region alone decides, and finds the articles of all but one of the 250 given pages,
also where no element is named after what it is.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed values of HTML: elements without content, and elements that flow inside a line.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark "
    "math q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that an opening tag of the same kind closes, up to the nearest listed element.
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
SCOPES = frozenset("ul ol dl table body article main section div aside nav td th form".split())

#: Elements that a page does not show as text.
UNSEEN = frozenset("title script style noscript template iframe object svg canvas audio video".split())
#: Elements whose text never belongs to an article.
DROPPED = frozenset("button select textarea datalist nav footer aside form dialog menu".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu "
    "menubar toolbar tablist".split()
)
#: Words of class and id attributes that mark what is not the article.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo "
    "promotion promoted banner cookie cookies consent gdpr notice notification alert popup modal "
    "overlay newsletter subscribe subscription signup paywall nav navbar navigation menu "
    "submenu breadcrumb breadcrumbs pagination pager sidebar aside widget widgets related "
    "recommended recommendations share sharing social footer copyright masthead topbar toolbar "
    "skip hidden comment comments commentlist respond replies disqus reactions form login "
    "search tags".split()
)
COMMENTS = frozenset("comment comments commentlist respond replies disqus reactions".split())
ARTICLE_MARKS = frozenset("article post entry story content main".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Width of the smoothing in lines, and the share of the text that a region must hold.
SIGMA = 1.0
REGION_SHARE = 0.8
#: Lone lines beside a block of several, and the share that such a block must hold.
LONE_LINES = 2
BLOCK_SHARE = 0.45

_NAME = re.compile(r"[A-Za-z]+")


def _marks(attributes: dict) -> set[str]:
    value = f"{attributes.get('class') or ''} {attributes.get('id') or ''}"
    return {word.lower() for word in _NAME.findall(value)}


def _unwanted(tag: str, attributes: dict) -> str | None:
    """Why an element's text is left out: ``tag``, ``mark`` or ``comment``; else None."""
    if tag in UNSEEN:
        return "unseen"
    if tag in ("html", "body") or tag in HEADINGS or tag in ("main",):
        return None
    if tag in DROPPED:
        return "tag"
    style = (attributes.get("style") or "").replace(" ", "").lower()
    if "hidden" in attributes or "display:none" in style or "visibility:hidden" in style:
        return "mark"
    if attributes.get("aria-hidden") == "true" or attributes.get("role") in ROLES:
        return "mark"
    marks = _marks(attributes)
    if marks & COMMENTS:
        return "comment"
    if tag == "header" or "header" in marks:
        return None if marks & ARTICLE_MARKS else "header"
    if tag in ("article", "p", "blockquote", "pre", "table", "td", "tr") or tag in INLINE:
        # Such names are rather about an article's own parts here.
        marks &= {"ad", "ads", "advert", "advertisement", "sponsored", "cookie", "hidden"}
    return "mark" if marks & MARKS else None


class _Element:
    __slots__ = ("tag", "number", "why", "reason", "parent")

    def __init__(self, tag, number, why, parent):
        self.tag, self.number, self.why, self.parent = tag, number, why, parent
        # The nearest reason among this element and its ancestors.
        self.reason = why or (parent.reason if parent else None)


class _Line:
    __slots__ = ("parts", "tags", "linked", "element", "heading", "given_away")

    def __init__(self, given_away=False):
        self.parts, self.tags, self.linked = [], 0, 0
        self.element, self.heading, self.given_away = None, False, given_away

    def add(self, data, element, linked, heading):
        if self.element is None:
            self.element, self.heading = element, heading
        self.parts.append(data)
        if linked:
            self.linked += len(data.strip())


class _Lines(HTMLParser):
    """Cuts the events of a page into lines."""

    def __init__(self, prior: bool):
        super().__init__(convert_charrefs=True)
        self.prior = prior
        self.stack: list[_Element] = []
        self.lines: list[_Line] = []
        # What is given away in the middle of a line is a line of its own.
        self.line, self.aside = _Line(), _Line(True)
        self.numbers = 0
        self.links = 0

    def _end_line(self):
        self.aside.tags = self.line.tags
        self.lines += [line for line in (self.line, self.aside) if line.parts]
        self.line, self.aside = _Line(), _Line(True)

    def _pop_to(self, depth: int):
        for element in self.stack[depth:]:
            self.links -= element.tag == "a"
        del self.stack[depth:]

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._end_line()
        self.line.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES:
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth].tag in CLOSES[tag]:
                    self._pop_to(depth)
                    if tag not in ("tr",):
                        break
                elif self.stack[depth].tag in SCOPES:
                    break
        elif tag not in INLINE:
            # A block ends an open paragraph.
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth].tag == "p":
                    self._pop_to(depth)
                    break
                if self.stack[depth].tag in SCOPES:
                    break
        attributes = dict(attrs)
        if tag == "main" or tag == "article" and not _marks(attributes) & COMMENTS:
            # The article never lies in a menu: one that is still open was not closed.
            for depth, element in enumerate(self.stack):
                if element.why and element.why != "comment":
                    self._pop_to(depth)
                    break
        parent = self.stack[-1] if self.stack else None
        why = _unwanted(tag, attributes)
        if why != "unseen" and not self.prior:
            why = None
        if tag in HEADINGS and parent and parent.reason == "header" and self._in_article():
            # The title in an article's own header belongs to the article.
            element = _Element(tag, self.numbers, None, parent)
            element.reason = None
        else:
            element = _Element(tag, self.numbers, why, parent)
        self.numbers += 1
        self.links += tag == "a"
        self.stack.append(element)

    def _in_article(self) -> bool:
        reasons = [e.why for e in self.stack if e.why]
        return reasons == ["header"] and any(e.tag in ("article", "main") for e in self.stack)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "li", "article", "section", "b", "i"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._end_line()
        self.line.tags += 1
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag == tag:
                self._pop_to(depth)
                return
            if tag in INLINE and self.stack[depth].tag in SCOPES:
                return

    def handle_data(self, data):
        element = self.stack[-1] if self.stack else None
        reason = element.reason if element else None
        line = self.aside if reason else self.line
        if not data or (not line.parts and data.isspace()):
            return
        if reason == "unseen" or any(e.why == "unseen" for e in self.stack):
            return
        line.add(data, element, self.links, any(e.tag in HEADINGS for e in self.stack[-3:]))

    def finish(self) -> list[_Line]:
        self.close()
        self._end_line()
        return self.lines


def text_tag_ratios(lines: list[tuple[str, int, int]]) -> np.ndarray:
    """Length of the text outside links per tag, for (text, tags, linked) lines."""
    return np.array([max(0, len(t) - linked) / max(1, tags) for t, tags, linked in lines], float)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that are there count for all."""
    reach = max(1, round(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    size = len(ratios)
    total = np.convolve(ratios, weights)[reach:reach + size]
    return total / np.convolve(np.ones(size), weights)[reach:reach + size]


def content_threshold(smoothed: np.ndarray) -> float:
    """The middle between two means of the values, found by alternating assignment.

    Lines that are alike (the largest less than three times the smallest) are one cluster,
    all content.
    """
    low, high = float(smoothed.min()), float(smoothed.max())
    if high < 3 * low:
        return 0.0
    cut = (low + high) / 2
    for _ in range(32):
        above = smoothed >= cut
        low, high = float(smoothed[~above].mean()), float(smoothed[above].mean())
        if (low + high) / 2 == cut:
            break
        cut = (low + high) / 2
    return cut


def _ancestors(element: _Element | None) -> Iterator[_Element]:
    while element is not None:
        yield element
        element = element.parent


def _within(region: int, line: _Line) -> bool:
    return any(element.number == region for element in _ancestors(line.element))


def _narrowed(region: int, chosen: list[tuple[_Line, str]]) -> int:
    """The block of several lines inside a region, as long as all others are lone lines."""
    while True:
        sizes: dict[int | None, int] = {}
        lines: dict[int | None, int] = {}
        blocks = set()
        for line, text in chosen:
            path = list(_ancestors(line.element))
            numbers = [element.number for element in path]
            if region not in numbers:
                continue
            at = numbers.index(region)
            child = numbers[at - 1] if at else None
            if at and path[at - 1].tag in SCOPES:
                blocks.add(child)
            sizes[child] = sizes.get(child, 0) + len(text)
            lines[child] = lines.get(child, 0) + 1
        best = max(sizes, key=sizes.get, default=None)
        if best not in blocks or lines[best] < 2:
            return region
        if sum(lines.values()) - lines[best] > LONE_LINES:
            return region
        if sizes[best] < BLOCK_SHARE * sum(sizes.values()):
            return region
        region = best


def main_text(html: str | None, prior: bool = True) -> str:
    """The blocks of the content region in page order, joined by one blank.

    Without ``prior`` names of elements, classes and ids decide nothing.
    """
    if not html:
        return ""
    parser = _Lines(prior)
    parser.feed(html)
    found = []
    for line in parser.finish():
        text = " ".join("".join(line.parts).split())
        if text:
            found.append((line, text))
    wanted = [not line.given_away for line, _ in found]
    if not any(wanted):
        return ""
    ratios = text_tag_ratios([(text, line.tags, line.linked) for line, text in found])
    smoothed = smooth(ratios)
    content = (smoothed >= content_threshold(smoothed)) & wanted
    if not content.any():
        content = np.array(wanted)

    held: dict[int, int] = {}
    names: dict[int, str] = {}
    chosen = [pair for pair, take in zip(found, content) if take]
    total = sum(len(text) for _, text in chosen)
    for line, text in chosen:
        for element in _ancestors(line.element):
            held[element.number] = held.get(element.number, 0) + len(text)
            names[element.number] = element.tag
    # Elements are numbered in page order, so the largest number is the deepest one.
    regions = [n for n, size in held.items() if size >= REGION_SHARE * total]
    region = None
    if prior:
        marked = [n for n in regions if names[n] in ("article", "main")]
        marked = marked or [
            n for n, size in held.items() if names[n] == "article" and 2 * size >= total
        ]
        region = max(marked, default=None)
    if region is None:
        blocks = [n for n in regions if names[n] in SCOPES or names[n] == "html"]
        region = _narrowed(max(blocks), chosen) if blocks else None
    kept = [pair for pair, take in zip(found, wanted) if take]
    if region is not None:
        return " ".join(text for line, text in kept if _within(region, line))
    # Without an enclosing element the region runs from the first content line, or headings
    # right before it, to the last one.
    places = np.flatnonzero(content)
    first, last = int(places[0]), int(places[-1])
    while first and found[first - 1][0].heading:
        first -= 1
    return " ".join(
        text for (_, text), take in zip(found[first:last + 1], wanted[first:last + 1]) if take
    )


def extract_main_text(html: Column) -> Column:
    """The main text of a page as a column; see :func:`main_text`.

    Null and empty pages, and pages without text, give an empty string. Unclosed elements
    end where the next one of their kind, or their parent's end, closes them. Pages are
    read one by one, so repeated rows and other columns change nothing.
    """

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py()) for page in batch], pa.string())

    return extract(html)
