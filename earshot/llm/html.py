"""Operator 4: the main text of HTML pages.

A streaming parser (the standard library's) turns a page into blocks: the text between block-level tags, with the tags
seen and the link text in each. A block is the method's line. Its text-to-tag ratio, 0 inside subtrees that are never
content (menus, headers, footers, sidebars, notices, adverts, forms, comments), is smoothed with a Gaussian over the
block sequence, and the blocks above a threshold (a share of the ratios' deviation) are clustered as content. The
region is the deepest element that holds nearly all clustered text and leaves no headline outside, whatever its name.
The text is what the clustering chose, in the region or not, and those blocks of the region that are no boilerplate
(of blocks that are mostly links, only where the smoothed ratio is over the threshold).

Parsing takes time in proportion to the page: open elements are a stack with the places of each tag, and the text
clustered in each element is summed once from the leaves up.

Cases: a null or empty page, or one without content, gives an empty string; a page cut off in mid-tag loses that tag
only; unclosed elements end where their parents do; pages of any length and depth are parsed whole; repeated rows are
treated alike; an empty table gives no rows; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import arrow, ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template svg math iframe object head title select textarea button canvas audio video map datalist".split())
BOILER = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist form".split())
#: Words of class and id names that mark a subtree as no content.
ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond replies breadcrumb breadcrumbs pagination pager related recommended recommendations skip hidden".split()
)
UNLESS_CONTENT = frozenset("nav navbar navigation menu sidebar sidenav aside header masthead topbar footer bottombar toolbar widget widgets tags meta".split())
CONTENT = frozenset("content article main post entry body text story page".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that the region doesn't move into.
LEAVES = frozenset(("p", "li", "tr", "td", "pre", "blockquote", "ul", "ol", "dl", "table"))
#: Elements that a paragraph start or a list item closes implicitly.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_SCOPE = frozenset(("ul", "ol", "dl", "table", "select", "menu"))

SIGMA = 2.0
#: Blocks whose smoothed ratio exceeds this share of the ratios' standard deviation are content.
THRESHOLD = 0.5
#: Share of the clustered text that a child must hold for the region to move into it.
HOLDS = 0.8

_WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("place", "tag", "parent", "block", "boiler", "silent")

    def __init__(self, place: int, tag: str, parent: "Element | None", boiler: bool, silent: bool):
        self.place, self.tag, self.parent = place, tag, parent
        #: The nearest block-level element, itself included.
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.boiler = boiler or (parent is not None and parent.boiler)
        self.silent = silent or (parent is not None and parent.silent)


class Blocks(HTMLParser):
    """Collects [text, tags, link characters, block element, is boilerplate] of each block, and all elements in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element(0, "#root", None, False, False)]
        self.open = [self.elements[0]]
        #: Depths of the open elements of a tag, and the depth of the outermost silent one.
        self.depths: dict[str, list[int]] = {}
        self.silent_from = 0
        #: Links opened up to this depth don't count.
        self.link_floor = 0
        self.blocks: list[list] = []
        self.text: list[str] = []
        self.tags = 0
        self.links = 0

        #: Place from which on no comment is closed, so that the rest isn't searched again.
        self.unclosed: int | None = None

    def close(self) -> None:
        self.unclosed = None
        super().close()

    def parse_comment(self, i: int, report: int = 1) -> int:
        if self.unclosed is not None and i >= self.unclosed:
            return -1
        end = super().parse_comment(i, report)
        if end < 0:
            self.unclosed = i
        return end

    @property
    def top(self) -> Element:
        return self.open[-1]

    def push(self, tag: str, boiler: bool, silent: bool) -> None:
        made = Element(len(self.elements), tag, self.top, boiler, silent)
        if made.silent and not self.top.silent:
            self.silent_from = len(self.open)
        self.elements.append(made)
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append(made)

    def pop(self) -> None:
        self.depths[self.open.pop().tag].pop()

    def depth_of(self, tags: Iterable[str]) -> int:
        """Depth of the innermost open element of these tags; 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append([text, self.tags, self.links, self.top.block, self.top.boiler])
                self.tags = 0
            self.text, self.links = [], 0

    def pop_to(self, tags: tuple[str, ...], scope: Iterable[str] = ()) -> None:
        """Closes the nearest open element of these tags, and what is open inside, unless a scope element is nearer."""
        depth = self.depth_of(tags)
        if depth and depth > self.depth_of(t for t in scope if t not in tags):
            self.flush()
            while len(self.open) > depth:
                self.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.top.silent and tag not in ("body", "main", "article"):
            if tag not in VOID:
                self.push(tag, False, True)
            return
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            if tag in ("body", "main", "article"):
                self.leave_boilerplate()
            if tag in CLOSED_BY:
                self.pop_to(CLOSED_BY[tag], LIST_SCOPE)
            elif self.top.block.tag == "p":
                self.pop_to(("p",))
        elif tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            silent, boiler = tag in SILENT, self.is_boiler(tag, attrs)
            if silent:
                self.text.append(" ")
            self.push(tag, boiler, silent)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.top.tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.top.silent
        if tag in VOID:
            return
        depth = self.depth_of((tag,))
        if self.top.silent:
            # nothing inside a silent element closes one around it
            if depth >= self.silent_from:
                while len(self.open) > depth:
                    self.pop()
        elif tag in BLOCK:
            self.pop_to((tag,), ("article", "main", "body"))
        elif depth and self.open[depth].block is self.top.block:
            while len(self.open) > depth:
                self.pop()

    def handle_data(self, data: str) -> None:
        if not self.top.silent and data:
            self.text.append(data)
            if self.depth_of(("a",)) > self.link_floor:
                self.links += len(data.strip())

    def leave_boilerplate(self) -> None:
        """An article or main element is content even if a menu, header or head before it was never closed."""
        while len(self.open) > 1 and (self.top.boiler or self.top.silent):
            self.pop()
        self.link_floor = len(self.open) - 1

    def is_boiler(self, tag: str, attrs: list) -> bool:
        if tag in BOILER:
            return True
        if tag == "header":
            return not self.depth_of(("article", "main"))
        if tag in ("html", "body", "main", "article"):
            return False
        words: set[str] = set()
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if not value:
                continue
            if name == "role" and value.strip().lower() in ROLES:
                return True
            if name == "style" and "display:none" in value.lower().replace(" ", ""):
                return True
            if name in ("class", "id"):
                words.update(_WORD.findall(value.lower()))
        if not words or tag in HEADINGS:
            return False
        if words & ALWAYS:
            return True
        return bool(words & UNLESS_CONTENT) and not words & CONTENT and (tag in ("div", "section", "ul", "ol", "table") or self.top.block is self.top)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with the kernel cut at three sigma and renormalised at the ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    part = np.convolve(values, kernel)[reach : reach + len(values)]
    return part / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def levels(blocks: list[list]) -> tuple[np.ndarray, np.ndarray, float]:
    """The text-to-tag ratios of blocks, the smoothed ones, and the threshold."""
    ratio = np.array([0.0 if b[4] else max(len(b[0]) - b[2], 0) / max(b[1], 1) for b in blocks])
    return ratio, smooth(ratio), THRESHOLD * float(ratio.std())


def region(blocks: list[list], chosen: np.ndarray, elements: list[Element]) -> Element:
    """The deepest element that holds nearly all the chosen text and leaves no headline outside.

    Elements stand behind their parents, so sums over what is inside them are made in one pass from the end.
    """
    mass, heads = [0] * len(elements), [0] * len(elements)
    for b, c in zip(blocks, chosen, strict=True):
        mass[b[3].place] += len(b[0]) if c else 0
        heads[b[3].place] += not b[4] and b[3].tag in ("h1", "h2")
    best: list[Element | None] = [None] * len(elements)
    for e in reversed(elements[1:]):
        up = e.parent.place
        mass[up] += mass[e.place]
        heads[up] += heads[e.place]
        # the first child of the most text
        if mass[e.place] and (best[up] is None or mass[e.place] >= mass[best[up].place]):
            best[up] = e
    at = elements[0]
    while (to := best[at.place]) is not None:
        if mass[to.place] < HOLDS * mass[0] or to.tag in LEAVES or to.tag in HEADINGS or heads[at.place] > heads[to.place]:
            break
        at = to
    return at


def chosen_blocks(blocks: list[list], elements: list[Element]) -> list[bool]:
    """The blocks that are main text."""
    boiler = np.array([b[4] for b in blocks])
    ratio, level, threshold = levels(blocks)
    over = level > threshold
    chosen = over & ~boiler & (ratio > 0)
    if not chosen.any():
        chosen = ~boiler
    if not chosen.any():
        return [False] * len(blocks)
    within, inside = region(blocks, chosen, elements), [False] * len(elements)
    for e in elements:
        inside[e.place] = e is within or (e.parent is not None and inside[e.parent.place])
    linked = np.array([2 * b[2] > len(b[0]) for b in blocks])
    keep = ~boiler & (chosen | (np.array([inside[b[3].place] for b in blocks]) & (over | ~linked)))
    # and the headings before a kept block
    for i in range(len(blocks) - 2, -1, -1):
        keep[i] = keep[i] or (blocks[i][3].tag in HEADINGS and not boiler[i] and not linked[i] and keep[i + 1])
    return keep.tolist()


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by newlines."""
    if not html:
        return ""
    at = html.rfind("<")
    if at > html.rfind(">") and re.match(r"<($|[/!?a-zA-Z])", html[at:]):
        html = html[:at]
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    if not parser.blocks:
        return ""
    return "\n".join(b[0] for b, k in zip(parser.blocks, chosen_blocks(parser.blocks, parser.elements), strict=True) if k)


def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extracted(df: DataFrame, html: Column) -> Column:
    """A column of main texts."""
    ship(df.sparkSession)
    return arrow(_main_text, "string")(html)


def page_texts(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) of the contract."""
    rows = pages.select("page_id", "url", extracted(pages, F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
