"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clusters.

The standard library's parser streams events; a block's text is a line.  A line's ratio is its characters outside
links over its tags.  Ratios are smoothed by a Gaussian, and lines above the standard deviation of the smoothed
ratios cluster into content regions.  The lowest element that holds all of them is the article: its short lines
belong to it, its runs of links do not, and where it is the whole page it goes from the first to the last region.

Elements whose name, class, id or role tells that they are no article (menus, footers, adverts, forms, comments)
have ratio 0, unless they are wrappers: a page's main heading or most of its text lies in them.

All is linear in the page: elements are numbers with parents, and what an element holds is summed from the last
element to the first.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sliced, texts

# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template iframe svg math object canvas audio video head title select textarea button".split())
#: Elements that are no article unless its heading is in them; a form may also be the wrapper of a page.
BESIDE = frozenset("nav footer aside form dialog menu".split())
#: Words of a class or id that mark what is no article, as its only, first or last part.  The strong ones may hold more text than the article does.
STRONG = r"ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w+|comments?|commentlist|disqus\w*|repl(?:y|ies)|respond"
WEAK = r"banner|promo\w*|notices?|alert|side-?bar|widgets?|menu|nav\w*|breadcrumbs?|masthead|site-header|page-header|top-?bar|foot\w*|copyright|share\w*|sharing|social|related|recommend\w*|pagination|pager|log-?in|sign-?up|search\w*|skip\w*|toolbar|hidden"
#: First parts of a class that speaks of something else on the page.
ABOUT = r"(?:has|no|with|without|hide|show|is|not)[_-]"


def _words(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|\s)(?!{ABOUT})(?:(?:{words})(?:[_-]\S*)?|\S*[_-](?:{words}))(?=\s|$)", re.I)


MARKS = ((2, _words(STRONG)), (1, _words(WEAK)))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
SIGMA, RADIUS = 1.0, 2
#: Share of the text that a wrapper holds, and that an element holds which says it is the article.
WRAPPER, MOST = 0.5, 0.9
#: Lines of links in a row that make a menu.
MENU = 3
_TORN = re.compile(r"<[A-Za-z/!?]")
#: Marks of elements: none, a word that wrappers have too, a word that none has, an element beside the article, nothing to read.
NONE, SOFT, HARD, NAMED, NEVER = range(5)


class Events(HTMLParser):
    """Lines (text, characters outside links, tags, innermost element) in page order, and elements by number: name, parent, mark."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.names, self.parents, self.marks = [""], [0], [NONE]  # element 0 is the page
        self.open: list[int] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # places in ``open`` by name
        self.blocks: list[int] = []  # places in ``open`` of blocks
        self.parts: list[str] = []
        self.plain: list[str] = []
        self.tags = 0

    def flush(self):
        if words := " ".join("".join(self.parts).split()):
            plain = len(" ".join("".join(self.plain).split()))
            self.lines.append((words, plain, max(1, self.tags), self.open[-1] if self.open else 0))
            self.tags = 0
        self.parts, self.plain = [], []

    def close_from(self, place: int):
        for k in range(len(self.open) - 1, place - 1, -1):
            name = self.names[self.open.pop()]
            self.at[name].pop()
            if self.blocks and self.blocks[-1] == k:
                self.blocks.pop()

    def mark(self, tag: str, attrs) -> int:
        a = dict(attrs)
        if tag in SILENT or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower():
            return NEVER
        if tag in ("html", "body"):
            return NONE
        said = f"{a.get('class') or ''} {a.get('id') or ''}"
        word = next((k for k, pattern in MARKS if pattern.search(said)), NONE)
        if word == HARD:
            return HARD
        if tag in BESIDE and tag != "form" or (a.get("role") or "").lower() in ROLES or tag == "header" and not (self.at["article"] or self.at["main"]):
            return NAMED
        return SOFT if word or tag == "form" else NONE

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            # a block ends an open paragraph
            if self.blocks and self.names[self.open[self.blocks[-1]]] == "p":
                self.close_from(self.blocks[-1])
        elif tag == "br":
            self.handle_data(" ")
        self.tags += 1
        if tag in VOID:
            return
        self.names.append(tag)
        self.parents.append(self.open[-1] if self.open else 0)
        self.marks.append(self.mark(tag, attrs))
        self.at[tag].append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(len(self.names) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        # no end of an inline element closes a block around it
        if self.at[tag] and (tag in BLOCK or not self.blocks or self.at[tag][-1] > self.blocks[-1]):
            self.close_from(self.at[tag][-1])

    def handle_data(self, data):
        if self.open and self.names[self.open[-1]] in ("script", "style"):
            return
        self.parts.append(data)
        self.plain.append(" " if self.at["a"] else data)


def summed(values: list[int], parents: list[int]) -> list[int]:
    """What each element and all in it have."""
    out = list(values)
    for k in range(len(out) - 1, 0, -1):
        out[parents[k]] += out[k]
    return out


def inherited(own: list[bool], parents: list[int]) -> list[bool]:
    out = list(own)
    for k in range(1, len(out)):
        out[k] = out[k] or out[parents[k]]
    return out


def beside(parser: Events) -> list[bool]:
    """For each element whether it is, or lies in, what is no article."""
    parents, marks, names = parser.parents, parser.marks, parser.names
    never = inherited([m == NEVER for m in marks], parents)
    text = [0] * len(names)
    for _, plain, _, node in parser.lines:
        text[node] += 0 if never[node] else plain
    text = summed(text, parents)
    # the article's landmark: an element that says so and holds most of the text, else the first main heading
    said = [k for k, n in enumerate(names) if n in ("article", "main") and marks[k] in (NONE, SOFT) and text[k] >= WRAPPER * text[0] and text[k]]
    marked = inherited([m in (HARD, NAMED, NEVER) for m in marks], parents)
    mark = max(said, default=None) or next((k for k, n in enumerate(names) if n == "h1" and not marked[k]), None)
    around = set()
    while mark:
        around.add(mark)
        mark = parents[mark]
    wraps = [k in around or m == SOFT and text[0] > 0 and text[k] >= WRAPPER * text[0] for k, m in enumerate(marks)]
    return inherited([m == NEVER or m != NONE and not w for m, w in zip(marks, wraps)], parents)


def smoothed(ratio: list[float]) -> list[float]:
    weights = [math.exp(-d * d / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    total = sum(weights)
    n = len(ratio)
    return [sum(w * ratio[k + d] for w, d in zip(weights, range(-RADIUS, RADIUS + 1)) if 0 <= k + d < n) / total for k in range(n)]


def content(html: str, chunk: int = 1 << 16) -> str:
    """Blocks of the article, joined by line breaks; '' if the page has none."""
    parser = Events()
    # a tag that the page's end leaves open is none; the standard parser would look at the rest again for each
    if torn := _TORN.search(html, html.rfind(">") + 1):
        html = html[: torn.start()]
    for at in range(0, len(html), chunk):
        parser.feed(html[at : at + chunk])
    parser.close()
    parser.flush()
    names, parents = parser.names, parser.parents
    aside = beside(parser)
    lines = [x for x in parser.lines if not aside[x[3]]]
    if not lines:
        return ""
    # what is aside keeps its place among the ratios, with none of its own
    ratio = [0.0 if aside[node] else plain / tags for _, plain, tags, node in parser.lines]
    level = smoothed(ratio)
    mean = sum(level) / len(level)
    least = math.sqrt(sum((x - mean) ** 2 for x in level) / len(level))
    places = [k for k, x in enumerate(parser.lines) if not aside[x[3]]]
    chosen = [k for k, p in enumerate(places) if level[p] > least and ratio[p] > 0] or [k for k, p in enumerate(places) if ratio[p] > 0]
    if not chosen:
        return ""
    plain, count = [0] * len(names), [0] * len(names)
    for k in chosen:
        plain[lines[k][3]] += lines[k][1]
        count[lines[k][3]] += 1
    plain, count = summed(plain, parents), summed(count, parents)
    said = [k for k, n in enumerate(names) if n in ("article", "main") and plain[k] >= MOST * plain[0]]
    article = next((k for k in said[::-1] if names[k] == "article"), max(said, default=None))
    if article is None:
        article = max(k for k, n in enumerate(count) if n == len(chosen))
        while names[article] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "table", "tbody", "tr", "td") or names[article] not in BLOCK and article:
            article = parents[article]
    inside = [False] * len(names)
    inside[article] = True
    inside = inherited(inside, parents)
    first, last = chosen[0], chosen[-1]
    whole = names[article] in ("", "html", "body")
    if whole:
        # no element of its own: from the first to the last selected line, with the headings before
        while first and names[lines[first - 1][3]] in ("h1", "h2", "h3"):
            first -= 1
    kept = [inside[x[3]] and (not whole or first <= k <= last) for k, x in enumerate(lines)]
    if names[article] != "article":
        # runs of links are menus
        start = 0
        for k in range(len(lines) + 1):
            if k == len(lines) or lines[k][1]:
                if k - start >= MENU:
                    kept[start:k] = [False] * (k - start)
                start = k + 1
    return "\n".join(x[0] for x, keep in zip(lines, kept) if keep)


def main_text(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text: str = "text") -> DataFrame:
    """The columns ``keep`` and the main text of each row's whole page.

    A null or empty page and one without an article give ''.  Character references are decoded, white space
    inside a block is one space, and blocks are joined in page order by one line break.  Broken markup is read
    as far as it goes.  Each row is by itself: repeated rows give equal texts, other columns play no part.
    """

    def run(batches):
        for batch in sliced(batches, 128):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array([content(h) for h in texts(batch, html)], pa.string())], names=[*keep, text])

    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(text, T.StringType(), False)])
    return pages.select(*dict.fromkeys([*keep, html])).mapInArrow(run, schema)
