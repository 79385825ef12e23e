"""HTML extraction by tag-path ratios.

A page is cut into blocks at block-level tags; a block's tag path is its open block-level tags from the root,
with their classes. For each path, text length and punctuation are summed and taken per block; the two ratios
are fused, averaged with their smoothed values in page order, and weighed by the share of the path's text that is no link.
Paths whose score reaches a share of the page's mean are content. The element that holds the content then also
gives its other blocks, such as headings and short lists, which have little text of their own; there markup is a
prior that lowers the threshold, and paths of links still fall below it. What the markup itself names as
furniture (navigation, footers, adverts, forms, comments ...) has no part in the ratios.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import tune

#: Standard deviation of the smoothing, in blocks; share of the mean score that a path must reach, and within the element that holds the content.
SMOOTH, SHARE, WITHIN = 1.0, 0.35, 0.05
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: One attribute: a name and, if it has one, its value, which is passed over as a whole; an open quote ends with the tag.
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)))?")
READ = {"class", "id", "role", "style", "hidden", "aria-hidden", "href"}
PUNCTUATION = re.compile("[.,;:!?\u2026\u3002\uff0c\u3001\uff01\uff1f]")
#: Elements of the HTML standard by how they are laid out or what they hold.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr"}
FURNITURE = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg", "object", "canvas", "dialog", "menu", "audio", "video", "map", "datalist", "fieldset"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
#: Words of classes and ids that name what is not the article, anywhere and outside of an article element.
ANYWHERE = r"ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|popup\w*|modal\w*|overlay|menu\w*|nav|nav(?:bar|igation|links?|list|menu)|breadcrumb\w*|sidebar\w*|widget\w*|related\w*|recommend\w*|share\w*|sharing|social\w*|comments?|comment-?list|respond|repl(?:y|ies)|disqus\w*|subscribe\w*|newsletter\w*|sign-?up|login|pagination|pager|skip\w*"
OUTSIDE = r"side|alert\w*|footer\w*|header\w*|masthead|topbar|toolbar|search\w*|tag-?list|copyright|legal|disclaimer"
#: Words that say nothing of what a part holds, and words whose compounds name the same as they do.
NEUTRAL = re.compile(r"box|bar|list|links?|buttons?|btn|icons?|section|block|area|panel|form|container|wrapper|wrap|inner|outer|holder|group|row|col|column|items?|posts?|articles?|entry|story|stories|topics?|page|site|main|inline|in|top|bottom|left|right|first|last|floating|sticky|fixed|unit|slot|js|wp|us|this|on|and|more|tools?|thread|body|content|count|meta|user|follow|email|header|footer|title|message|[0-9]+(?:x[0-9]+)?", re.I)
COMPOUNDS = re.compile(r"comments?|advert\w*|sponsored|disqus\w*", re.I)
NAMES = re.compile(rf"(?:^|[\s_-])(?:{ANYWHERE}|{OUTSIDE})(?:$|[\s_-])", re.I)
INSIDE_WORD, WORD = (re.compile(words, re.I) for words in (ANYWHERE, f"{ANYWHERE}|{OUTSIDE}"))
#: Elements that hold running text: as within an article, each word of a name counts.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "figcaption", "span", "b", "i", "em", "strong", "a"}
#: A class or id that begins so names a part of the article.
PART_OF_ARTICLE = re.compile(r"(?:^|\s)(?:entry|article|post|story)[_-](?:header|title|legal|disclaimer)\S*", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Elements that a class or id name cannot make furniture: a page may be styled as a whole.
WHOLE = {"html", "body", "main", "article"}
HOLDERS = {"article", "main"}
HEADING = re.compile("h[1-6]")


@dataclass
class Element:
    tag: str
    number: int
    path: int
    holder: int | None
    furniture: bool
    link: bool = False


@dataclass
class Block:
    path: int
    element: int
    holder: int | None
    heading: bool
    furniture: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Page:
    """Blocks with text in order; of each block-level element, its parent (-1: none) and how deep it is."""

    blocks: list[Block]
    parent: list[int]
    depth: list[int]


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(raw):
        if (name := name.lower()) in READ:
            out.setdefault(name, double or single or bare)  # the first of a name counts
    return out


def _is_named(names: str, word: re.Pattern[str]) -> bool:
    """Whether one of the names is such a word, or made of such words and of neutral ones alone: `share-buttons`, not `share-price`."""
    for name in names.split():
        parts = [p for p in re.split("[_-]+", name) if p]
        own = [word.fullmatch(p) is not None for p in parts]
        if word.fullmatch(name) or any(own) and (COMPOUNDS.fullmatch(parts[0]) or all(o or NEUTRAL.fullmatch(p) for o, p in zip(own, parts))):
            return True
    return False


def _is_furniture(tag: str, a: dict[str, str], inside_holder: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not inside_holder:
        return True
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    if tag in WHOLE:
        return False
    names = [PART_OF_ARTICLE.sub(" ", a[k]) for k in ("class", "id") if a.get(k)]
    if inside_holder or tag in TEXT:
        return any(_is_named(x, INSIDE_WORD if inside_holder else WORD) for x in names)
    return any(NAMES.search(x) for x in names)


class Reader:
    """Open elements and blocks so far. Inline elements are kept only where they matter: links, and furniture with what is in it."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.laid: list[Element] = []
        self.open: Counter[str] = Counter()
        self.furniture = self.links = 0
        self.paths: dict[tuple[int, str], int] = {}
        self.page = Page([], [], [])
        self.block: Block | None = None

    def add(self, text: str) -> None:
        """Text of the open block, or of a new one."""
        if self.block is None:
            if not text.strip():
                return
            top = self.laid[-1] if self.laid else None
            self.block = Block(top.path if top else -1, top.number if top else -1, top.holder if top else None, bool(top) and HEADING.fullmatch(top.tag) is not None, self.furniture > 0)
            self.page.blocks.append(self.block)
        elif self.block.furniture != (self.furniture > 0):
            # an inline element that is furniture within a block, or the text after it
            if text.strip():
                b = self.block
                self.page.blocks.append(Block(b.path, b.element, b.holder, b.heading, not b.furniture, [text]))
            return
        self.block.parts.append(text)
        if self.links:
            self.block.linked += len(text.strip())

    def push(self, tag: str, a: dict[str, str]) -> None:
        top = self.laid[-1] if self.laid else None
        furniture = _is_furniture(tag, a, top is not None and top.holder is not None)
        if tag in INLINE:
            if not furniture and not self.furniture and not (tag == "a" and "href" in a):
                return
            e = Element(tag, -1, -1, None, furniture, tag == "a" and "href" in a)
        else:
            step = tag + "".join(f".{c}" for c in sorted(a.get("class", "").split())[:3] if not any(x.isdigit() for x in c))
            path = self.paths.setdefault((top.path if top else -1, step), len(self.paths))
            number = len(self.page.parent)
            self.page.parent.append(top.number if top else -1)
            self.page.depth.append(len(self.laid))
            e = Element(tag, number, path, number if tag in HOLDERS else top.holder if top else None, furniture)
            self.laid.append(e)
        self.stack.append(e)
        self.open[tag] += 1
        self.furniture += e.furniture
        self.links += e.link

    def cut(self, k: int) -> None:
        """Ends all elements from the k-th on."""
        for e in self.stack[k:]:
            self.open[e.tag] -= 1
            self.furniture -= e.furniture
            self.links -= e.link
            if e.number >= 0:
                self.laid.pop()
        del self.stack[k:]

    def close(self, tags: set[str], within: set[str]) -> None:
        """Ends open elements of these tags that stand above any of `within`."""
        while any(self.open[t] for t in tags):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag in within:
                    return
                if self.stack[k].tag in tags:
                    self.cut(k)
                    break

    def end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        k = len(self.stack) - 1
        while self.stack[k].tag != tag:
            k -= 1
        if tag in INLINE:  # blocks within it stay open
            if all(e.number < 0 for e in self.stack[k + 1 :]):
                self.cut(k)
            else:
                e = self.stack.pop(k)
                self.open[tag] -= 1
                self.furniture -= e.furniture
                self.links -= e.link
        else:
            self.cut(k)


def read(page: str) -> Page:
    """The page's blocks and elements."""
    r = Reader()
    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            r.add(html.unescape(text))
        if not m:
            break
        at = m.end()
        end, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                r.add(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag == "br":
            r.add(" ")
            continue
        if not end and tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            if stop:
                close_at = page.find(">", stop.start())
                at = close_at + 1 if close_at >= 0 else len(page)
            else:
                at = len(page)
            continue
        if tag not in INLINE:
            r.block = None
        if end:
            r.end(tag)
            continue
        if tag in VOID or raw.endswith("/") and tag in {"path", "circle", "rect", "use"}:
            continue
        if tag in CLOSES_P:
            r.close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            r.close(SIBLINGS[tag], SCOPES[tag])
        if tag == "a":
            r.close({"a"}, set(CLOSES_P))
        if tag == "body":
            r.cut(1 if r.stack and r.stack[0].tag == "html" else 0)
        r.push(tag, _attributes(raw))
    for b in r.page.blocks:
        b.text = " ".join("".join(b.parts).split())
    r.page.blocks = [b for b in r.page.blocks if b.text]
    return r.page


def path_scores(found: list[Block]) -> np.ndarray:
    """The score of each block's tag path: fused ratios and their smoothed values (geometric mean), by the share that is no link."""
    at = np.unique([b.path for b in found], return_inverse=True)[1]
    length = np.array([len(b.text) for b in found], float)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in found], float)
    linked = np.minimum([float(b.linked) for b in found], length)
    n = np.bincount(at)
    fused = np.sqrt(np.bincount(at, length) / n * (1 + np.bincount(at, marks) / n))[at]
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SMOOTH**2))
    ones = np.convolve(np.ones(len(found)), kernel, "full")[3:-3]
    smooth = np.convolve(fused, kernel, "full")[3:-3] / ones
    return (np.sqrt(np.bincount(at, smooth) / n * (np.bincount(at, fused) / n)) * (1 - np.bincount(at, linked) / np.bincount(at, length)))[at]


def content(page: Page) -> list[bool]:
    """Which blocks are the article."""
    found = page.blocks
    inner = [k for k, b in enumerate(found) if not b.furniture]
    if not inner:
        return [False] * len(found)
    own = path_scores([found[k] for k in inner])
    size = np.array([len(found[k].text) for k in inner], float)
    mean = float((own * size).sum() / size.sum())
    score = np.full(len(found), -1.0)
    score[inner] = own
    chosen = score >= SHARE * mean
    # a block in the element that holds the content needs less; a heading and a page of links alone need nothing
    allowed = [s >= 0 and (s >= WITHIN * mean or b.heading) for s, b in zip(score, found)]
    # how much of the chosen text each element holds; children are numbered after their parents
    weight = [0] * len(page.parent)
    for k in np.flatnonzero(chosen):
        if found[k].element >= 0:
            weight[found[k].element] += len(found[k].text)
    for e in range(len(weight) - 1, -1, -1):
        if page.parent[e] >= 0:
            weight[page.parent[e]] += weight[e]
    whole = sum(len(found[k].text) for k in np.flatnonzero(chosen))

    def within(main: int) -> list[bool]:
        inside = [False] * len(page.parent)
        for e, up in enumerate(page.parent):
            inside[e] = e == main or up >= 0 and inside[up]
        return [b.element >= 0 and inside[b.element] for b in found]

    holding = [e for e in {found[k].holder for k in np.flatnonzero(chosen)} if e is not None and weight[e] >= 0.5 * whole]
    if holding:
        here = within(max(holding, key=lambda e: (page.depth[e], -e)))
        return [h and a for h, a in zip(here, allowed)]
    most = [e for e, w in enumerate(weight) if w >= 0.9 * whole]
    here = within(max(most, key=lambda e: (page.depth[e], -e))) if most else [True] * len(found)
    first, last = int(np.flatnonzero(chosen)[0]), int(np.flatnonzero(chosen)[-1])
    while first and found[first - 1].heading and not found[first - 1].furniture:
        first -= 1
    return [bool(c) or first <= k <= last and h and a for k, (c, h, a) in enumerate(zip(chosen, here, allowed))]


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    found = read(page)
    return "\n".join(b.text for b, keep in zip(found.blocks, content(found)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty html gives an empty text, as does one without content. Each page is read for itself, so
    repeated rows agree; null ids and urls are kept. An empty table gives no rows. Other columns are ignored, whatever
    their names. A very long page is read whole, in time proportional to its length, and must fit in a worker's memory.
    Equally heavy elements are settled by depth, then by page order.
    """
    tune(pages.sparkSession)

    @F.pandas_udf("string")
    def text(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in htmls], dtype=object)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
