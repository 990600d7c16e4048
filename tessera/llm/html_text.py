"""HTML main text: parser events, text-to-tag ratio of each line, Gaussian smoothing and threshold clustering.

The standard library's parser streams events; every block element starts a new line, which knows its text, its number of
tags and the element it stands in. The ratio of text to tags is smoothed along the page, and the threshold that parts the
smoothed ratios into two clusters best says which lines are content. An element weighs the sum of its lines' lengths times their
logarithmic distance from the threshold; the heaviest element is the content region, and where it stands in an article or the
main element, or holds articles with content, these are. All lines of the region stay, the short ones between the
others too, but for page furniture (menus, headers, adverts, forms, comments, ...) and, where no article bounds the
region, for elements below the threshold before its first and after its last line of content.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tessera.llm.common import map_texts

#: Elements that start a line of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no text, and elements whose text is never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg canvas audio video select textarea button datalist".split())
#: Page furniture by element (a header in an article is none), by role and by words in class or id.
FURNITURE = frozenset("nav header footer aside form menu dialog search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
    "consent disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo sidebar sidebars sponsor sponsored toolbar".split()
)
#: Words that may also name content: what stands in such an element goes only where its ratio is below the threshold.
HINTS = frozenset("alert disclaimer promoted promotion related replies reply respond response share sharing social subscribe widget".split())
#: Words that say nothing beside one of these; any other word beside it names something else (as in "share-price").
FILLERS = frozenset("area bar block body bottom box button buttons container content count fixed form global group holder icons inner item items left link links list main module page panel post primary region right row secondary section site slot sticky text thread title top unit wrap wrapper zone".split())
#: Of these, those that tell an article element of a reader's comment from the article itself.
COMMENT_WORDS = frozenset("comment comments commentlist replies reply respond".split())
#: Class names that begin so tell what an element has or lacks, not what it is.
ABOUT = frozenset("has no non with without".split())
#: Elements that hold a line of their own but are no region of the page.
SINGLE = frozenset("p li dt dd td th tr h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption summary".split())
#: Elements that a new one closes when their end tag is left out.
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=20_000)
def _kind(tag: str, attrs: tuple) -> int:
    """2 page furniture by its attributes, 1 maybe, 0 not."""
    found = 0
    for key, value in attrs:
        if not value:
            if key == "hidden":
                return 2
        elif key in ("class", "id") and tag not in ("html", "body", "main"):
            for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
                parts = [x for x in re.split(r"[^a-z]+", name) if x]
                if not parts or parts[0] in ABOUT:
                    continue
                hard = COMMENT_WORDS if tag == "article" else FURNITURE_WORDS
                named = [x for x in parts if x not in FILLERS]
                if named and hard.issuperset(x for x in named if x not in HINTS) and not hard.isdisjoint(named):
                    return 2
                if named and tag != "article" and HINTS.issuperset(named):
                    found = 1
        elif key == "role" and value.strip().lower() in FURNITURE_ROLES or key == "aria-hidden" and value.strip().lower() == "true":
            return 2
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return found


@dataclass
class Line:
    box: int  #: number of the innermost element
    kind: int  #: 2 in page furniture, 1 maybe, 0 not
    parts: list[str] = field(default_factory=list)
    tags: int = 1
    text: str = ""


class LineParser(HTMLParser):
    """Lines of a page, in page order. Elements are numbered from 1 as they begin; 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # element, number, kind, hidden
        self.at: dict[str, list[int]] = defaultdict(list)  # where each element stands open in the stack
        self.blocks: list[int] = []
        self.lines: list[Line] = []
        self.names, self.parents = [""], [0]
        self.fresh = True

    def _close(self, k: int) -> None:
        """Close the open elements from place `k` on."""
        while len(self.stack) > k:
            self.at[self.stack.pop()[0]].pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "hr":
                self.fresh = True
            elif self.lines and not self.fresh:
                self.lines[-1].tags += 1
                if tag == "br":
                    self.lines[-1].parts.append(" ")
            return
        if tag in BLOCKS:
            # an open p ends where a block begins, also through the inline elements left open in it
            while self.blocks and tag in CLOSED_BY.get(self.stack[self.blocks[-1]][0], ()):
                self._close(self.blocks[-1])
            self.fresh = True
        elif self.lines and not self.fresh:
            self.lines[-1].tags += 1
        _, around, kind, hidden = self.stack[-1]
        if kind < 2:
            if tag in FURNITURE and not (tag == "header" and (self.at["article"] or self.at["main"])):
                kind = 2
            elif attrs:
                kind = max(kind, _kind(tag, tuple(attrs)))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.at[tag].append(len(self.stack))
        self.names.append(tag)
        self.parents.append(around)
        self.stack.append((tag, len(self.names) - 1, kind, hidden or tag in HIDDEN))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        places = self.at[tag]
        # a stray inline end tag doesn't close the block around it
        if places and (tag in BLOCKS or not self.blocks or places[-1] > self.blocks[-1]):
            self._close(places[-1])
        if tag in BLOCKS:
            self.fresh = True

    def handle_data(self, data):
        _, number, kind, hidden = self.stack[-1]
        if hidden or self.fresh and not data.strip():
            return
        if self.fresh or not self.lines:
            self.lines.append(Line(number, kind))
            self.fresh = False
        self.lines[-1].parts.append(data)


def smoothed_ratios(lines: list[tuple[str, int]], sigma: float) -> np.ndarray:
    """Characters per tag of each line, smoothed with a Gaussian whose ends are normalised."""
    ratio = np.array([len(t) / max(1, n) for t, n in lines], dtype=float)
    radius = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[radius : radius + len(ratio)]
    return np.convolve(ratio, kernel, "full")[radius : radius + len(ratio)] / weight


def threshold(values: np.ndarray) -> float:
    """Halfway between the two clusters of values that lie furthest apart (largest variance between them); the value if all are equal."""
    v = np.sort(values)
    n = np.arange(1, len(v))
    below, total = np.cumsum(v)[:-1], v.sum()
    between = n * (len(v) - n) * (below / n - (total - below) / (len(v) - n)) ** 2
    if len(v) < 2 or between.max() < 1e-12:
        return float(v[0])
    at = int(between.argmax())
    return float(v[at] + v[at + 1]) / 2


def content_lines(parser: LineParser, lines: list[Line], above: np.ndarray, alone: np.ndarray) -> list[Line]:
    """The lines of the content region. above: how far each line is above the threshold, smoothed; alone: by its own ratio."""
    names, parents = parser.names, parser.parents
    holds = [n in BLOCKS - SINGLE or n in ("td", "th") for n in names]  # cells may lay out a page
    free = [k for k, x in enumerate(lines) if x.kind == 0 or x.kind == 1 and above[k] >= 0]
    if not free:
        return []
    core = [k for k in free if above[k] >= 0]
    weight, inside = np.zeros(len(names)), np.zeros(len(names), dtype=np.int64)
    for k in free:
        weight[lines[k].box] += len(lines[k].text) * above[k]
        inside[lines[k].box] += 1
    named = np.zeros(len(names), dtype=np.int64)  # outermost article or main around each element
    for e in range(1, len(names)):
        named[e] = named[parents[e]] or (e if names[e] in ("article", "main") else 0)
    for e in range(len(names) - 1, 0, -1):
        weight[parents[e]] += weight[e]
        inside[parents[e]] += inside[e]
    regions = [e for e in range(len(names)) if inside[e] and holds[e]] or [0]
    region = max(regions, key=lambda e: (weight[e], e))
    around = np.zeros(len(names), dtype=bool)  # elements in the region

    def spread(chosen: set[int]) -> None:
        for e in range(len(names)):
            around[e] = e in chosen or e > 0 and around[parents[e]]

    articles = {int(named[lines[k].box]) for k in core} - {0}
    spread({region})
    if named[region]:
        # articles side by side are all content; a main element holds all of it
        spread({int(named[region])} if names[named[region]] == "main" else {e for e in articles if names[e] == "article"} | {int(named[region])})
        return [lines[k] for k in free if around[lines[k].box]]
    held = {e for e in articles if around[e]}
    if held:
        spread(held)
        return [lines[k] for k in free if around[lines[k].box]]
    # one line is no region: the innermost element around it with more, short of the whole page, is taken as it is
    wide = region
    while wide and (inside[wide] < 2 or not holds[wide]):
        wide = parents[wide]
    if wide != region and names[wide] not in ("", "html", "body") and 2 * weight[wide] >= weight[region]:
        spread({wide})
        return [lines[k] for k in free if around[lines[k].box]]
    own = [k for k in free if around[lines[k].box]]
    part = np.zeros(len(names), dtype=np.int64)  # the region's part that each element belongs to; 0 the region itself
    for e in range(1, len(names)):
        if around[e] and e != region:
            up = parents[e]
            part[e] = e if up == region or not around[up] or part[up] == 0 else part[up]
    # lines that only stand near long ones are no content of their own
    best = [k for k in own if above[k] >= 0 and alone[k] >= 0]
    if not best:
        return [lines[k] for k in own]
    full = {part[lines[k].box] for k in best}

    def stays(k: int) -> bool:
        p = part[lines[k].box]
        return best[0] <= k <= best[-1] or p != 0 and (names[p] in SINGLE or p in full)

    return [lines[k] for k in own if stays(k)]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Main text of a whole page: its blocks in page order, one to a line; empty if there is none."""
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    lines = []
    for x in parser.lines:
        x.text = _SPACE.sub(" ", "".join(x.parts)).strip()
        if x.text:
            lines.append(x)
    if not lines:
        return ""
    smooth = np.log1p(smoothed_ratios([(x.text, x.tags) for x in lines], sigma))
    cut, own = threshold(smooth), np.log1p([len(x.text) / x.tags for x in lines])
    return "\n".join(x.text for x in content_lines(parser, lines, smooth - cut, own - cut))


def extract_text(pages: DataFrame, *, html_col: str = "html", carry: list[str] | None = None, sigma: float = 1.0) -> DataFrame:
    """`carry` columns (all by default) of every page, with `main_text` string and `n_chars` long (its code points).

    A null or empty page, and one without content, gives the empty string. Broken markup never fails: tags that don't match
    are closed where the next block begins; time grows in proportion to a page's length. Equal pages get equal texts. Columns with these two names are replaced.
    """

    def run(pages_):
        texts = [main_text(p.decode("utf-8", "replace") if p else None, sigma) for p in pages_]
        return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

    fields = [T.StructField("main_text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_texts(pages, html_col, list(pages.columns) if carry is None else carry, fields, run, rows=200)
