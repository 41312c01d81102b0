"""Main text of web pages from streaming parser events.

The standard library's parser sends start, end and text events. They are folded into lines, one
for each block, and a tree of the block elements. Each line has a text-to-tag ratio: its
characters outside links over its tags. The ratios are smoothed with a Gaussian along the page
and split by threshold clustering into content and boilerplate. The clusters choose the region of the
page: the element in which content outweighs the other lines most, grown to one around it that holds
most of the content. In the region its own lines stay, and those of the blocks that hold content
lines or lie between such, but for notices of one line at its ends; a heading right before it belongs
to it. Blocks of links without a content line go. Names only overrule: the article around a region
widens it, articles that hold nearly all of it narrow it, and menus, adverts, forms, comments and the
like are taken away. A region of which nothing is left so is chosen again among the other lines.

Scale: map-only, one pass over each page; time and memory are linear in its length, since a line
holds the number of its element and an element that of its parent, and tags that never end are mended before parsing. Nothing is shuffled.

Edge cases: null or empty html gives the empty text; unclosed and truncated markup is closed at
its parent's or the page's end; a page without a content line gives what lines it has outside
boilerplate; repeated rows and further columns pass through, a column with the
name of the result is replaced; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_or_empty, utf8

# HTML's element names by their role, and words of class, id and role attributes
# that mark parts other than the article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br", "td", "th", "label", "input"}
UNSEEN = {"head", "script", "style", "template", "noscript", "iframe", "object", "svg", "canvas", "audio", "video", "title", "map"}
APART = {"nav", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog", "fieldset"}
ARTICLE = {"article", "main"}
LISTS = {"ul", "ol", "dl", "table", "div", "section", "center"}  # what may be a block of links
HEADINGS = {"h1", "h2"}
CONTAINER = {"", "html", "body", "div", "section", "article", "main", "center"}  # what may be a region, or a block of one
APART_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "notifications", "alert", "alerts", "popup", "modal", "overlay", "disclaimer",
    "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "sidebar", "sidebars", "aside", "rail", "menu", "menus", "menubar", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar", "toolbar", "social", "share", "sharing", "related",
    "recommended", "recommendations", "trending", "popular", "widget", "widgets", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies",
    "discussion", "form", "search", "complementary", "contentinfo", "dialog", "alertdialog",
}
HEADER_WORDS = {"header"}
STORY_WORDS = {"article", "post", "entry", "story", "content", "main"}  # a header inside such an element is the article's own
#: An open element that a start tag closes, as HTML lets its end tag be left out.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG = re.compile(r"</?[A-Za-z]")
EDGE = re.compile(r"""=\s*(["'])|["'<>]""")  # where a tag ends, or a quote opens a value
RAW = re.compile(r"<(script|style)\b", re.IGNORECASE)  # elements whose text isn't markup

SIGMA = 1.0
FULL = 80.0  # characters for each tag that make a line content, however long the others are
LINKED = 0.8  # share of characters in links that makes a block of lines a menu
LINES = 3  # lines of a menu, at least
MOST = 0.75  # share of the page's content that its region holds
NOTICE = 0.1  # share of the region's content under which a line in a block of its own may be a notice
HELD = 0.9  # share of a region's content that makes articles in it the region


class Lines(HTMLParser):
    """Folds events into lines and the tree of block elements.

    Lines are (text, tags, characters in links, apart?, element, in an article and not apart within it?).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, unseen, apart, story
        self.n_open: Counter[str] = Counter()
        self.runs: list[Counter[str]] = [Counter()]  # inline elements that are open, since each open block
        self.unseen = self.apart = self.links = self.articles = self.stories = self.apart_before = 0
        self.names, self.parents, self.aparts = [""], [-1], [False]  # of the elements; the first is the page
        self.within = [0]
        self.lines: list[tuple[str, int, int, bool, int, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def end_line(self):
        text = " ".join("".join(self.parts).split())
        if text:
            own = bool(self.articles) and self.apart == self.apart_before
            self.lines.append((text, self.tags, self.linked, bool(self.apart), self.within[-1], own))
            self.tags = self.linked = 0
        self.parts = []

    def handle_starttag(self, name, attrs):
        if self.unseen:
            if name not in VOID:
                self._push(name, {})
            return
        if name in ("body", "html") and self.n_open[name]:
            return
        closes = CLOSED_BY.get(name, {"p"} if name not in INLINE else set())
        while self.open and self.open[-1][0] in closes:
            self._pop()
        if closes == {"p"} and self.names[self.within[-1]] == "p" and not self.runs[-1]["td"] and not self.runs[-1]["th"]:
            while self.names[self.within[-1]] == "p":  # inline elements left open inside a paragraph end with it
                self._pop()
        self.tags += 1
        if name in ("td", "th", "br", "img", "wbr", "input", "option"):
            self.parts.append("" if name == "wbr" else " ")
        if name not in INLINE:
            self.end_line()
        if name not in VOID:
            self._push(name, dict(attrs))

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)
        if name not in VOID and name in ("svg", "script", "iframe", "template"):
            self.handle_endtag(name)

    def _push(self, name, attrs):
        unseen = name in UNSEEN or "hidden" in attrs or bool(re.search(r"display\s*:\s*none", attrs.get("style") or ""))
        names = " ".join(attrs.get(x) or "" for x in ("class", "id", "role")).lower().split() if attrs else []
        words = {w for x in names if not x.startswith(("no-", "has-", "with-", "without-")) for w in re.findall(r"[a-z]+", x)}
        apart = name in APART or bool(words & APART_WORDS) or not self.stories and not words & STORY_WORDS and (name == "header" or bool(words & HEADER_WORDS))
        story = name in ARTICLE or bool(words & STORY_WORDS) and not apart
        if name in ("html", "body"):
            unseen = apart = story = False
        if name in ARTICLE and not self.articles:
            self.apart_before = self.apart
        self.open.append((name, unseen, apart, story))
        self.n_open[name] += 1
        self.unseen += unseen
        self.apart += apart
        self.links += name == "a"
        self.articles += name in ARTICLE
        self.stories += story
        if name in INLINE:
            self.runs[-1][name] += 1
        else:
            self.parents.append(self.within[-1])
            self.within.append(len(self.names))
            self.names.append(name)
            self.aparts.append(apart)
            self.runs.append(Counter())

    def _pop(self):
        name, unseen, apart, story = self.open.pop()
        self.n_open[name] -= 1
        if name in INLINE:
            self.runs[-1][name] -= 1
        else:
            self.end_line()
            self.within.pop()
            self.runs.pop()
        self.unseen -= unseen
        self.apart -= apart
        self.links -= name == "a"
        self.articles -= name in ARTICLE
        self.stories -= story

    def handle_endtag(self, name):
        if not self.unseen:
            self.tags += 1
        if not self.n_open[name]:
            if name == "p" and not self.unseen:
                self.end_line()
            return
        if name in INLINE and not self.runs[-1][name]:  # a stray inline end tag doesn't close blocks
            return
        while self.open[-1][0] != name:
            self._pop()
        self._pop()

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    over = np.convolve(np.ones(len(values)), kernel, "full")[reach:-reach]
    return np.convolve(values, kernel, "full")[reach:-reach] / over


def threshold(values: np.ndarray) -> float:
    """Between the means of the two clusters it makes."""
    at = float(values.mean())
    for _ in range(50):
        low, high = values[values <= at], values[values > at]
        if not len(low) or not len(high) or abs((now := (low.mean() + high.mean()) / 2) - at) < 1e-9:
            break
        at = float(now)
    return at


def mended(html: str) -> str:
    """html in which every tag ends, in one pass over it.

    Markup that the page's end cuts off goes: a tag, a comment, or what an open quote would swallow if
    no tag ends behind it. A quote that is never closed is left out of its tag, as is a < within a tag. So the
    parser never looks for the end of a tag in vain, which takes it a time that grows with the square of the page.
    """
    out, done, at = [], 0, 0
    last = {q: html.rfind(q) for q in "\"'>"}
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            if end < 0:
                return "".join([*out, html[done:at]])
            at = end + 3
            continue
        if not TAG.match(html, at):
            at += 1
            continue
        end, clean, quoted = at + 1, True, []
        while True:
            m = EDGE.search(html, end)
            if m is None or at > last[">"]:
                return "".join([*out, html[done:at]])
            end = m.end()
            if m[0] == ">":
                break
            if m[0] == "<" or m[1] is None:  # a < or a quote that opens no value
                clean = False
                quoted.append((end - 1, end, " "))
            elif last[m[1]] < end:  # a value that never closes
                clean = False
                quoted.append((end - 1, end, ""))
            else:
                end = html.index(m[1], end) + 1
        if not clean:
            out.append(html[done:at])
            done = at
            for a, b, by in quoted:
                out += [html[done:a], by]
                done = b
        if raw := RAW.match(html, at):
            close = re.compile(f"</{raw[1]}", re.IGNORECASE).search(html, end)
            if close is None:
                return "".join([*out, html[done:at]])
            end = close.start()
        at = end
    return "".join([*out, html[done:]])


def regions(high: np.ndarray, size: np.ndarray, element: np.ndarray, parser: Lines) -> np.ndarray:
    """Which lines lie in the region that the clusters choose.

    The region is the element with the largest sum of lines, content for and others against it, by
    their characters; it grows to an element around it that holds most of the content, if content outweighs the rest there too. Within it its own lines
    stay, and blocks with content or between such.
    """
    parents, names = parser.parents, parser.names
    n = len(names)
    score, mass = np.bincount(element, np.where(high, size, -size), n).tolist(), np.bincount(element, np.where(high, size, 0), n).tolist()
    for k in range(n - 1, 0, -1):
        score[parents[k]] += score[k]
        mass[parents[k]] += mass[k]
    fits = [k for k in range(n) if names[k] in CONTAINER]
    root = max(fits, key=lambda k: (score[k], k))
    up = root
    while mass[root] < MOST * mass[0] and parents[up] >= 0:
        up = parents[up]
        if names[up] in CONTAINER and score[up] > 0 and mass[up] > mass[root]:
            root = up
    story, up = -1, root  # names may widen the region to the article around it
    while up >= 0:
        story, up = (up if names[up] in ARTICLE else story), parents[up]
    if story >= 0:
        root = story
    else:  # or narrow it to the articles that hold what it holds
        around = [-1] * n
        for k in range(1, n):
            around[k] = around[parents[k]] if around[parents[k]] >= 0 else k if names[k] in ARTICLE else -1
        told = {k for k in range(n) if around[k] == k and mass[k]}
        if sum(mass[k] for k in told) >= HELD * mass[root]:
            return np.isin(np.array(around)[element], list(told))
    block = [-1] * n  # the container right below root that each element is or lies in, or root; -1 outside
    block[root] = root
    for k in range(root + 1, n):
        up = block[parents[k]]
        block[k] = k if up == root and names[k] in CONTAINER else up
    block = np.array(block)[element]
    if story >= 0:
        return block >= 0
    spots = np.flatnonzero(high & (block >= 0))
    # a block of one short line at either end is a notice rather than part of the text
    lone = (np.bincount(block[block >= 0], minlength=n)[block] == 1) & (block != root) & (size < NOTICE * mass[root])
    while len(spots) > 1 and (lone[spots[0]] or lone[spots[-1]]):
        spots = spots[1:] if lone[spots[0]] else spots[:-1]
    out = (block == root) | np.isin(block, block[spots])
    out[spots[0] : spots[-1]] |= block[spots[0] : spots[-1]] >= 0
    out &= block >= 0
    at = int(np.argmax(out))
    while at and (out[at - 1] or names[element[at - 1]] in HEADINGS):
        at -= 1
        out[at] = True
    return out


def menus(content: np.ndarray, size: np.ndarray, linked: np.ndarray, element: np.ndarray, parser: Lines) -> np.ndarray:
    """Which lines lie in a block of links: three lines or more, mostly links, none of them content."""
    n = len(parser.names)
    sums = [np.bincount(element, x, n).tolist() for x in (content, np.ones(len(size)), size, linked)]
    for k in range(n - 1, 0, -1):
        for x in sums:
            x[parser.parents[k]] += x[k]
    held, lines, chars, in_links = sums
    menu = [False] * n
    for k in range(1, n):
        menu[k] = menu[parser.parents[k]] or parser.names[k] in LISTS and not held[k] and lines[k] >= LINES and in_links[k] >= LINKED * chars[k]
    return np.array(menu)[element]


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(mended(html))
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines])
    tags, linked, apart, element, own = (np.array(x) for x in list(zip(*lines))[1:])
    ratio = np.maximum(size - linked, 0) / np.maximum(tags, 1)
    level = smooth(ratio)
    least = min(threshold(level), FULL)
    # a line that is only lifted by its neighbours may lie in a region, but it doesn't choose one
    high = (level >= least) & (ratio >= least) & (2 * linked <= size)
    free = ~apart
    kept = np.zeros(len(lines), bool)
    if high.any():
        kept = free & regions(high, size, element, parser)
    if not kept.any():  # names say that none of it is the article, or something around the article was left open
        free = free if free.any() else own
        high = free & high if (free & high).any() else free
        if not high.any():
            return ""
        kept = free & regions(high, size, element, parser)
    kept &= ~menus(high & free, size, linked, element, parser)
    return "\n".join(lines[k][0] for k in np.flatnonzero(kept))


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of the column html."""
    small_batches(df.sparkSession)

    @F.arrow_udf(T.StringType())
    def of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.decode("utf-8", "replace")) for x in utf8(column)], pa.string())

    return df.withColumn(out, of(text_or_empty(html)))
