"""Operator 8: main text of raw web pages.

Events of the standard library's streaming parser are turned into lines, one for each block of text, with the
tags met in it. Text-to-tag ratios of all lines are smoothed by a Gaussian over neighbouring lines and split into
two clusters by a threshold; lines above it mark where the content is. Marked text chooses the region: all
articles, if they hold most of the marked text, and otherwise the smallest container that holds most of it, widened
while that adds only headings and marked lines, or the main element around that container. Inside the region every block is kept, short ones too, but for boxes that are no
part of the article by their tag, role or class (menus, adverts, comments and so on). What is a box is judged by the
marked text again: a class name that only suggests one counts no longer where hardly any marked text would be left
without it, and a tag or plain name where none would.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never content, with everything inside. Their text is not even collected.
SILENT = frozenset("script style noscript template svg math iframe object button select option textarea datalist title head canvas audio video map".split())
BOXES = frozenset("nav footer aside form dialog menu fieldset".split())
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol section table td ul li blockquote center p span address".split())
#: Elements that can be a content region; paragraphs and lists are only parts of one.
REGIONS = frozenset("article body center div main section table td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that name a box outside the article; the second set matches beginnings.
NAMES = frozenset("ad ads adbox adslot nav navbar menu menubar notice notices header masthead aside widget widgets login signin signup search pager pagination tags toolbar copyright legal disclaimer alert alerts overlay paywall teaser teasers gdpr outbrain taboola disqus rail toc hidden skip".split())
STARTS = ("advert", "sponsor", "newsletter", "subscri", "recommend", "related", "cookie", "consent", "breadcrumb", "sidebar", "footer", "navig", "promo", "social", "share", "sharing", "banner", "popup", "modal", "comment", "reply", "replies", "respond", "responses", "discussion", "topbar", "topnav", "colophon")
#: Words that say nothing beside such names.
NEUTRAL = frozenset("area bar block box container form inner item items link links list outer posts section slot thread unit wrap wrapper".split())
NEGATED = frozenset("no has with without".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: How sure a box is: by a class name among other words, by its tag, role or a plain name, or because it is not shown.
MAYBE, SURELY, NEVER_SHOWN = range(3)


def _named(part: str) -> bool:
    return part in NAMES or part.startswith(STARTS)


def boxes(tag: str, attrs: list[tuple[str, str | None]]) -> list[tuple[int, str]]:
    """(how sure, name) for all that says that this element is no part of an article."""
    found = [(SURELY, tag)] if tag in BOXES else []
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            found.append((NEVER_SHOWN, ""))
        elif name == "role" and value.lower() in ROLES:
            found.append((SURELY, value.lower()))
        elif name in ("class", "id") and tag not in ("html", "body", "main"):
            for word in value.split():
                parts = [p.lower() for p in _PART.findall(word) if not p.isdigit()]
                if not parts or parts[0] in NEGATED:
                    continue
                if tag == "article":
                    if any(p.startswith(("comment", "related", "teaser", "promo", "advert", "sponsor")) for p in parts):
                        found.append((SURELY, f".{word}"))
                elif any(map(_named, parts)):
                    found.append((SURELY if all(_named(p) or p in NEUTRAL for p in parts) else MAYBE, f".{word}"))
    return found


class Lines(HTMLParser):
    """Collects lines: (text, tags, containers, the boxes that it is in, in an article, in main, a heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple] = []
        self.text: list[str] = []
        self.tags = 0
        self.made = 0
        self.silent = 0
        self.quiet: list[str] = []
        #: Open elements: (tag, number, boxes so far, number of the outermost article, in main, in a header of the article)
        self.open: list[tuple] = [("", 0, (), 0, False, False)]
        self.heading = False

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, _, box, article, main, header = self.open[-1]
            box = (*box, (SURELY, "header")) if header and not self.heading else box
            self.lines.append((text, max(1, self.tags), tuple(x[1] for x in self.open if x[0] in REGIONS or not x[1]), box, article, main, self.heading))
            self.tags = 0
        self.text.clear()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.quiet:
            if tag == self.quiet[-1] and tag not in VOID:
                self.quiet.append(tag)
            elif tag == "body" and self.quiet[0] == "head" or tag in ("article", "main") and self.quiet[0] in ("head", "title"):
                self.quiet.clear()
            else:
                return
            if self.quiet:
                return
        if tag in SILENT:
            self.end_line() if tag in ("head", "title") else None
            self.quiet.append(tag)
            return
        if tag in BLOCKS:
            self.end_line()
        if tag in HEADINGS:
            self.heading = True
        if tag in CONTAINERS:
            if tag == "p":  # a paragraph ends the one before it
                while self.open[-1][0] in ("p", "span"):
                    self.open.pop()
            elif tag in BLOCKS and self.open[-1][0] == "p":
                self.open.pop()
            if tag in ("article", "main"):  # a menu that was never closed does not hold the article
                while len(self.open) > 1 and self.open[-1][0] in ("nav", "header", "ul", "ol", "li", "p", "span"):
                    self.open.pop()
            _, _, box, article, main, header = self.open[-1]
            self.made += 1
            box = (*box, *boxes(tag, attrs))
            if tag == "header":
                box, header = box if article or main else (*box, (SURELY, tag)), True
            if tag == "article" and not article:
                article = self.made
            main = main or tag == "main" or any(n == "role" and v == "main" for n, v in attrs)
            self.open.append((tag, self.made, box, article, main, header))
        elif tag not in VOID and tag not in BLOCKS and (found := boxes(tag, attrs)):
            self.made += 1
            last = self.open[-1]
            self.open.append((tag, self.made, (*last[2], *found), *last[3:]))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in SILENT:
            self.tags += 1
            if tag in BLOCKS and not self.quiet:
                self.end_line()
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.quiet:
            if tag == self.quiet[-1]:
                self.quiet.pop()
            elif tag in ("body", "html"):
                self.quiet.clear()
            return
        if tag in BLOCKS:
            self.end_line()
        if tag in HEADINGS:
            self.heading = False
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
            if tag in ("span", "p", "li") and self.open[k][0] in ("article", "main", "body", "table"):
                break

    def handle_data(self, data):
        if not self.quiet:
            self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """Gaussian average over neighbouring lines; weights beyond the ends are left out."""
    reach = max(1, int(2 * sigma + 0.5))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(ratios, kernel)[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]


def threshold(values: np.ndarray) -> float:
    """Border between two clusters in one dimension (two means, from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        below, above = values[values < middle], values[values >= middle]
        if not len(below):
            return middle
        now = float(below.mean()), float(above.mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


MOST = 0.8  # share of the marked text that a region holds
FULL = 100.0  # characters for a tag from which on a line is plainly text
LEAST = 0.1  # share of the marked text that class names which only suggest a box leave over


def marks(lines: list[tuple]) -> np.ndarray:
    """Which lines are in the cluster of high text-to-tag ratios? Ratios above FULL count as FULL: one endless line makes no other a menu."""
    wide = smoothed(np.minimum(FULL, np.array([len(x[0]) / x[1] for x in lines])))
    return wide >= threshold(wide)


def vetoes(lines: list[tuple], marked: np.ndarray) -> set[tuple[int, str]]:
    """The boxes that count on this page: while too little marked text is left, the one that holds the most of it goes."""
    sizes = [(len(x[0]), set(x[3])) for x, mark in zip(lines, marked) if mark]
    total = sum(n for n, _ in sizes)
    held: dict[tuple[int, str], int] = {}
    for n, own in sizes:
        for box in own:
            held[box] = held.get(box, 0) + n
    on = {box for x in lines for box in x[3]}
    while True:
        left = sum(n for n, own in sizes if not own & on)
        free = [box for box in on if box[0] == MAYBE and held.get(box, 0) >= LEAST * total] if left < LEAST * total else []
        if not free and not left:
            free = [box for box in on if box[0] == SURELY and held.get(box, 0)]
        if not free:
            return on
        on.discard(max(free, key=lambda box: (held[box], box)))


def extract(html: str | None) -> str:
    """Main text, blocks joined by newlines; empty for null, empty or text-free pages."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    if not parser.lines:
        return ""
    marked = marks(parser.lines)
    on = vetoes(parser.lines, marked)
    kept = [(x, mark) for x, mark in zip(parser.lines, marked) if not on.intersection(x[3])]
    lines = [x for x, _ in kept]
    if not lines:
        return ""
    weight: dict[int, int] = {}
    in_articles = 0
    for text, _, path, _, article, *_ in [x for x, mark in kept if mark] or lines:
        for region in path:
            weight[region] = weight.get(region, 0) + len(text)
        in_articles += len(text) if article else 0
    enough = MOST * weight[0]
    if in_articles >= enough:
        return "\n".join(x[0] for x in lines if x[4])
    # Numbers grow with depth, so the largest number that holds most of the marked text is the smallest container.
    best = max(region for region, n in weight.items() if n >= enough)
    way = next(x[2] for x in lines if best in x[2])
    for region in reversed(way[: way.index(best)]):  # further out while that adds only headings and marked text
        if not all(mark or x[6] or best in x[2] for x, mark in kept if region in x[2]):
            break
        best = region
    in_main = any(x[5] and best in x[2] for x in lines) and all(x[5] for x in lines if best in x[2])
    return "\n".join(x[0] for x in lines if (x[5] if in_main else best in x[2]))


def main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with `out`, the main text of each whole page. No shuffle.

    Null and empty html, and pages without text, give an empty string; pages of any length are parsed whole, one
    at a time; repeated rows and other columns stay, but for an `out` that is there already; an empty table gives
    no rows.
    """

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py()) for x in column], pa.string())

    return pages.withColumn(out, run(F.col(html)))
