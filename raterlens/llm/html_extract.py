"""Main text of web pages from streamed parser events.

The standard library's parser streams a page's events into lines, one for each
block element, with the tags met in it, its link text and its container. Each
line's text-to-tag ratio is smoothed with a Gaussian over the neighbouring
lines and the ratios are clustered in two by a threshold; lines above it are
content. The content region is the article elements if they hold most of the
content, else the smallest layout container with all of it (all in the main
element, if that holds most); its title and content lines in the containers
around it belong to it. All its blocks are kept in page order, short ones too,
but those of menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments. A word in a class
or id excludes no element that holds the page's article or most of its text.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5       # lines
REGION = 0.7      # share of the content that articles or main elements must hold
WRAPPER, HOLDER = 0.5, 0.25  # share of the text above which a word excludes no element; with an article or h1 inside

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_BREAK = frozenset(["br", "td", "th", "wbr", "img"])
CONTAINERS = frozenset(
    "html body main article section div nav header footer aside form ul ol dl menu table tbody thead tfoot tr "
    "blockquote fieldset details dialog figure head title".split())
# Elements inside a line that are no text of it; they don't end its block.
INLINE_OUT = frozenset(
    "script style noscript template svg iframe select textarea button object canvas audio video".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd pre hr figcaption address summary caption center legend option".split())
LAYOUT = frozenset(["", "html", "body", "main", "article", "section", "div"])
# Elements, roles and words of class or id whose blocks are no article text.
NO_TEXT = frozenset(
    "head title nav header footer aside form dialog menu fieldset".split()) | INLINE_OUT
NO_ROLE = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar tablist toolbar "
    "status".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted "
                     "promotion".split())
NO_WORDS = COMMENT_WORDS | AD_WORDS | frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside rail cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social related recommended recommendations widget widgets pagination pager toolbar search banner "
    "skip copyright".split())
# A tag that runs into the next one.
_UNFINISHED = re.compile(r"<[A-Za-z/][^<>\"']*(?=<)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


HARD, WORD, STRONG_WORD = 1, 2, 3  # excluded whatever it holds, by a word, by one of comments and adverts


def _excluded(tag: str, attrs) -> int:
    if tag in NO_TEXT:
        return HARD
    if tag in ("html", "body", "main"):
        return 0
    got = {k: v or "" for k, v in attrs}
    words = {w.lower() for k in ("class", "id") for w in _NAME.findall(got.get(k, ""))}
    if ("hidden" in got or got.get("aria-hidden", "").lower() == "true" or got.get("role", "").lower() in NO_ROLE
            or _HIDDEN.search(got.get("style", ""))):
        return HARD
    if words & (COMMENT_WORDS | AD_WORDS):
        return STRONG_WORD
    return WORD if tag != "article" and words & NO_WORDS else 0


class _Lines(HTMLParser):
    """Streams events into lines: (text, tags, link characters, container,
    excluded, is a list item, is a title). Containers are numbered; ``parent``, ``kind``,
    ``word`` (how a word marks it) and ``titles`` (h1 in it) describe them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple] = []
        self.parent, self.kind, self.word, self.titles = [-1], [""], [0], [0]
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open: Counter = Counter()  # tags of the stack
        self.hard, self.unclosed = [False], [False]  # of containers: excluded themselves, never closed
        self.inner: list[str] = []  # open inline or paragraph elements that are excluded
        self.hidden: list[tuple[str, int, str]] = []  # open INLINE_OUT elements, the stack's depth, the block's tag
        self.block = ""
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0
        self.item = self.title = False
        self.endless = False  # no comment ends behind the place read

    def parse_comment(self, i, report=1):
        """The end of an unclosed comment is looked for once, not again for
        each comment start behind it."""
        end = -1 if self.endless else super().parse_comment(i, report)
        self.endless = end < 0
        return end

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![", i):  # CDATA and conditional sections: no text
            end = self.rawdata.find(">", i + 3)
            return end + 1 if end >= 0 else -1
        return super().parse_html_declaration(i)

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            self.lines.append((text, self.tags, self.linked, self.stack[-1][1], bool(self.inner), self.item, self.title))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            self.links = 0
            self.inner = []
            self.block = tag
            self.item = tag == "li"
            self.title = tag == "h1"
        self.tags += 1
        if tag in INLINE_BREAK:
            self.text.append(" ")
        if tag == "a":
            self.links = 1
        if tag in VOID:
            return
        out = _excluded(tag, attrs)
        if tag in INLINE_OUT:
            self.hidden.append((tag, len(self.stack), self.block))
        elif tag in CONTAINERS:
            if tag in ("article", "main", "body"):  # these can't stand in an unclosed menu or head
                while self.stack[-1][0] in ("nav", "head", "menu", "ul", "ol", "title") and len(self.stack) > 1:
                    self.open[self.stack.pop()[0]] -= 1
            self.parent.append(self.stack[-1][1])
            self.hard.append(out == HARD)
            self.unclosed.append(True)
            self.kind.append(tag)
            self.word.append(out if out in (WORD, STRONG_WORD) else 0)
            self.titles.append(0)
            self.stack.append((tag, len(self.parent) - 1))
            self.open[tag] += 1
        elif out:
            self.inner.append(tag)
        elif tag == "h1" and not self.hidden:
            self.titles[self.stack[-1][1]] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "a":
            self.links = 0
        if tag in CONTAINERS:
            while self.open[tag]:
                kind, at = self.stack.pop()
                self.open[kind] -= 1
                if kind == tag:
                    self.unclosed[at] = False
                    break
            self.hidden = [h for h in self.hidden if h[1] <= len(self.stack)]
        elif tag in INLINE_OUT:
            for i in range(len(self.hidden) - 1, -1, -1):
                if self.hidden[i][0] == tag:
                    del self.hidden[i:]
                    break
        elif tag in self.inner:
            self.inner.remove(tag)
        if tag in BLOCKS:
            self.item = self.title = False
            if self.hidden and tag == self.block and tag not in CONTAINERS:  # left open in this block
                self.hidden = [h for h in self.hidden if h[2] != tag or h[1] != len(self.stack)]
            self.block = ""

    def handle_data(self, data):
        if self.inner or self.hidden:  # an excluded element inside a block
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())


def _excluding(p: _Lines) -> list[tuple]:
    """Lines, those inside excluded containers marked. An excluded container
    that is never closed hides what stands in it directly, but no layout
    container after that."""
    gone, only = [False], [False]  # excluded; by containers alone that are never closed
    for c in range(1, len(p.parent)):
        up = gone[p.parent[c]] and not (only[p.parent[c]] and p.kind[c] in LAYOUT)
        gone.append(up or p.hard[c])
        only.append(gone[c] and (not up or only[p.parent[c]]) and (not p.hard[c] or p.unclosed[c]))
    return [(t, tags, linked, at, out or gone[at], *kind) for t, tags, linked, at, out, *kind in p.lines]


def _smoothed(ratio: np.ndarray) -> np.ndarray:
    reach = int(np.ceil(2 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    padded = np.concatenate([np.zeros(reach), ratio, np.zeros(reach)])
    weight = np.convolve(np.concatenate([np.zeros(reach), np.ones(len(ratio)), np.zeros(reach)]), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def _threshold(x: np.ndarray) -> float:
    """Border between two clusters of the ratios (iterated means)."""
    lo, hi = float(x.min()), float(x.max())
    for _ in range(50):
        cut = (lo + hi) / 2
        up = x > cut
        if not up.any() or up.all():
            return cut
        new = float(x[~up].mean()), float(x[up].mean())
        if new == (lo, hi):
            return cut
        lo, hi = new
    return (lo + hi) / 2


def _without_marked(p: _Lines) -> list[tuple]:
    """Lines, those of containers that a word excludes marked as excluded. A
    container with the page's main element, most of its text, or much of it
    and its article or h1 is a wrapper: its words exclude nothing. The words
    of comments and adverts need a main element or an h1 for that. Words that
    leave no text but titles exclude nothing either: the ratios decide."""
    p.lines = _excluding(p)
    if not any(p.word):
        return p.lines
    size = len(p.parent)
    mass, titles, mains, articles = np.zeros(size), np.array(p.titles), np.zeros(size), np.zeros(size)
    for t, _, linked, at, out, *_ in p.lines:
        if not out:
            mass[at] += len(t) - linked
    for c in range(size - 1, 0, -1):
        up = p.parent[c]
        mass[up] += mass[c]
        titles[up] += titles[c]
        mains[up] += mains[c] + (p.kind[c] == "main" and mass[c] > 0)
        articles[up] += articles[c] + (p.kind[c] == "article" and mass[c] > 0 and not p.word[c])
    gone = np.zeros(size, bool)
    for c in range(1, size):
        held = mass[c] >= HOLDER * mass[0]
        keep = mains[c] or held and titles[c] or p.word[c] == WORD and (held and articles[c] or mass[c] > WRAPPER * mass[0])
        gone[c] = gone[p.parent[c]] or p.word[c] and not keep
    if not any(len(t) > linked and not out and not title and not gone[at] for t, _, linked, at, out, _, title in p.lines):
        return p.lines
    return [(t, tags, linked, at, out or bool(gone[at]), *kind) for t, tags, linked, at, out, *kind in p.lines]


def _regions(p: _Lines, mass: np.ndarray) -> list[int]:
    """Containers of the content, given the content in each and below."""
    size = len(p.parent)
    for tag in ("article", "main"):
        inside, top = np.zeros(size, bool), []
        for c in range(1, size):  # the outermost of this kind
            inside[c] = p.kind[c] == tag or inside[p.parent[c]]
            if p.kind[c] == tag and not inside[p.parent[c]] and mass[c] > 0:
                top.append(c)
        if top and sum(mass[c] for c in top) >= REGION * mass[0]:
            if tag == "article":
                return top
            return [_smallest(p, mass, c) for c in top]
    return [_smallest(p, mass, 0)]


def _smallest(p: _Lines, mass: np.ndarray, root: int) -> int:
    """The smallest layout container with all content of ``root``."""
    at = root
    for c in range(root + 1, len(mass)):
        if p.parent[c] == at and mass[c] >= mass[root]:
            at = c
    while p.kind[at] not in LAYOUT:
        at = p.parent[at]
    return at


def main_text(html: str | None) -> str:
    """Blocks of the main text, joined by an empty line ('' if there are none)."""
    if not html:
        return ""
    html = _UNFINISHED.sub(r"\g<0>>", html)  # else the parser looks for the end of each from its start
    at = html.rfind(">") + 1  # comment starts behind it are text, as the parser takes them
    p = _Lines()
    p.feed(html[:at] + html[at:].replace("<!--", "&lt;!--"))
    p.close()
    p.flush()
    lines = _without_marked(p)
    if not any(t and not out for t, _, _, _, out, *_ in lines):
        return ""
    ratio = np.array([0.0 if out else max(0, len(t) - linked) / max(1, tags)
                      for t, tags, linked, _, out, *_ in lines])
    smooth = _smoothed(ratio)
    content = smooth >= _threshold(smooth)
    mass = np.array([len(t) - linked if c and not out else 0
                     for (t, _, linked, _, out, *_), c in zip(lines, content)])
    if not mass.sum():  # short or linked text only
        mass = np.array([0 if out else len(t) for t, _, _, _, out, *_ in lines])
    below = np.zeros(len(p.parent))
    for (_, _, _, at, *_), m in zip(lines, mass):
        below[at] += m
    for c in range(len(below) - 1, 0, -1):  # children have larger numbers
        below[p.parent[c]] += below[c]
    inside, around = np.zeros(len(p.parent), bool), np.zeros(len(p.parent), bool)
    for region in _regions(p, below):
        inside[region] = True
        c = p.parent[region]
        while c > 0 and p.kind[c] not in ("body", "html"):
            around[c] = p.kind[c] in LAYOUT
            c = p.parent[c]
    for c in range(1, len(inside)):
        inside[c] |= inside[p.parent[c]]
    # lists of links alone (three items or more) are menus, but for those of an article
    article = np.zeros(len(p.parent), bool)
    for c in range(1, len(article)):
        article[c] = article[p.parent[c]] or p.kind[c] == "article"
    menu: dict[int, list[bool]] = {}
    for t, _, linked, at, _, item, _ in lines:
        if item and t and not article[at]:
            menu.setdefault(at, []).append(linked >= 0.9 * len(t.replace(" ", "")))
    return "\n\n".join(
        t for (t, _, _, at, out, item, title), m in zip(lines, mass)
        if t and not out and (inside[at] or around[at] and (m or title)) and not (item and len(menu.get(at, ())) >= 3 and all(menu[at])))


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    ``pages`` needs page_id, url and html; further columns are ignored.
    Returns a row for every input row: page_id, url, text ('' if none) and
    n_chars (its code points). Character references are decoded, white space
    inside a block becomes one space, blocks are joined by an empty line.

    Null or empty html gives ''. Unclosed elements end where HTML ends them
    or with the page. Null ids and urls and repeated rows pass through; an
    empty table gives no rows. Very long and deeply nested pages take time in
    proportion to their length, and memory of some tens of times it.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
