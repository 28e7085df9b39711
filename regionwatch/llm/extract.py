"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. A block is described by its word count and link density, those of its
neighbours, and where it stands (inside an article, inside a container that is named or marked as page furniture, a
heading). A decision tree is grown by Gini impurity on the small table of labelled blocks below, once a worker, and
says which blocks are content; blocks of a page that has an article but stand outside it never are.

Defined results: a null or empty html has an empty text; repeated rows and null ids or urls pass through; an empty
table gives an empty one; other columns are not looked at. Unclosed elements end with the page, a cut-off tag is
markup, a cut-off character reference is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

FEATURES = ("furniture", "in_article", "heading", "words", "density", "words_before", "density_before", "words_after", "density_after")

#: Labelled blocks: FEATURES in order, then 1 for content.
LABELLED = (
    # articles: paragraphs of any length and headings, whatever stands beside them
    (0, 1, 1, 8, 0.0, 6, 1.0, 60, 0.0, 1), (0, 1, 1, 5, 0.0, 0, 0.0, 40, 0.0, 1), (0, 1, 0, 60, 0.0, 8, 0.0, 45, 0.0, 1),
    (0, 1, 0, 45, 0.05, 60, 0.0, 1, 0.0, 1), (0, 1, 0, 1, 0.0, 45, 0.05, 30, 0.0, 1), (0, 1, 0, 30, 0.1, 1, 0.0, 3, 0.0, 1),
    (0, 1, 0, 3, 0.0, 30, 0.1, 12, 0.9, 1), (0, 1, 0, 2, 1.0, 50, 0.0, 20, 0.0, 1), (0, 1, 0, 25, 0.4, 3, 0.0, 0, 0.0, 1),
    (0, 1, 0, 4, 0.0, 4, 0.0, 5, 1.0, 1), (0, 1, 0, 120, 0.02, 2, 0.0, 8, 0.3, 1), (0, 1, 1, 3, 1.0, 20, 0.0, 80, 0.0, 1),
    (0, 1, 0, 1, 0.0, 9, 0.0, 0, 0.0, 1), (0, 1, 0, 2, 0.0, 5, 0.0, 9, 0.0, 1), (0, 1, 0, 1, 1.0, 3, 0.0, 6, 0.0, 1),
    (0, 1, 0, 3, 0.0, 1, 1.0, 1, 1.0, 1), (0, 1, 0, 6, 0.7, 7, 0.0, 2, 0.0, 1), (0, 1, 0, 12, 1.0, 14, 0.0, 4, 0.0, 1),
    (0, 1, 0, 2, 0.5, 2, 1.0, 0, 0.0, 1), (0, 1, 1, 1, 0.0, 1, 1.0, 3, 0.0, 1), (0, 1, 0, 20, 0.9, 2, 0.0, 2, 0.0, 1),
    (0, 1, 0, 1, 0.0, 0, 0.0, 0, 0.0, 1), (0, 1, 0, 3, 0.4, 12, 1.0, 18, 0.9, 1), (0, 1, 0, 14, 0.35, 1, 0.0, 12, 0.5, 1),
    (0, 1, 0, 8, 1.0, 10, 0.0, 12, 1.0, 1), (0, 1, 0, 15, 0.8, 20, 0.0, 6, 1.0, 1), (0, 1, 0, 5, 0.7, 5, 1.0, 5, 1.0, 1),
    (0, 1, 0, 1, 0.0, 2, 1.0, 1, 1.0, 1), (0, 1, 0, 2, 0.0, 1, 0.0, 1, 1.0, 1), (0, 1, 1, 1, 0.0, 5, 1.0, 4, 1.0, 1),
    (0, 1, 0, 1, 1.0, 0, 0.0, 1, 1.0, 1), (0, 1, 0, 30, 1.0, 8, 1.0, 0, 0.0, 1), (0, 1, 0, 3, 1.0, 1, 1.0, 3, 1.0, 1),
    # furniture, inside an article too: menus, notices, adverts, forms, comments
    (1, 0, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (1, 0, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (1, 0, 0, 9, 0.0, 1, 1.0, 8, 0.0, 0),
    (1, 0, 0, 12, 0.1, 30, 0.0, 0, 0.0, 0), (1, 0, 0, 40, 0.0, 20, 0.0, 35, 0.0, 0), (1, 0, 1, 2, 0.0, 60, 0.0, 40, 0.0, 0),
    (1, 1, 0, 7, 0.0, 50, 0.0, 60, 0.0, 0), (1, 1, 0, 3, 1.0, 40, 0.0, 2, 1.0, 0), (1, 1, 0, 35, 0.0, 2, 1.0, 25, 0.0, 0),
    (1, 1, 1, 2, 0.0, 30, 0.0, 15, 0.0, 0), (1, 0, 0, 80, 0.05, 5, 0.0, 5, 0.0, 0), (1, 0, 0, 18, 0.9, 2, 0.0, 0, 0.0, 0),
    # pages without an article: long blocks of few links, and headings and short blocks beside them
    (0, 0, 0, 55, 0.0, 6, 0.0, 40, 0.0, 1), (0, 0, 0, 40, 0.1, 55, 0.0, 30, 0.0, 1), (0, 0, 0, 22, 0.05, 40, 0.1, 18, 0.0, 1),
    (0, 0, 0, 18, 0.0, 22, 0.05, 2, 1.0, 1), (0, 0, 1, 6, 0.0, 2, 1.0, 55, 0.0, 1), (0, 0, 1, 4, 0.0, 40, 0.0, 50, 0.0, 1),
    (0, 0, 0, 5, 0.0, 40, 0.0, 35, 0.0, 1), (0, 0, 0, 3, 0.0, 60, 0.0, 45, 0.0, 1), (0, 0, 0, 90, 0.2, 3, 1.0, 3, 1.0, 1),
    (0, 0, 0, 14, 0.0, 1, 0.0, 1, 0.0, 1), (0, 0, 0, 16, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 0, 1, 3, 0.0, 1, 1.0, 17, 0.0, 1), (0, 0, 1, 2, 0.0, 0, 0.0, 60, 0.0, 1), (0, 0, 1, 5, 0.0, 12, 0.0, 20, 0.0, 1),
    (0, 0, 0, 2, 0.0, 17, 0.0, 17, 0.0, 1), (0, 0, 0, 2, 0.0, 20, 0.0, 25, 0.0, 1), (0, 0, 0, 3, 0.0, 13, 0.0, 30, 0.0, 1),
    (0, 0, 0, 2, 1.0, 0, 0.0, 1, 1.0, 0), (0, 0, 0, 1, 1.0, 2, 1.0, 3, 1.0, 0), (0, 0, 0, 3, 1.0, 1, 1.0, 55, 0.0, 0),
    (0, 0, 0, 12, 1.0, 40, 0.0, 12, 1.0, 0), (0, 0, 0, 30, 0.8, 12, 1.0, 20, 0.9, 0), (0, 0, 0, 20, 0.6, 50, 0.0, 0, 0.0, 0),
    (0, 0, 0, 3, 0.0, 2, 1.0, 1, 1.0, 0), (0, 0, 0, 5, 0.4, 18, 0.0, 0, 0.0, 0), (0, 0, 1, 3, 0.0, 3, 1.0, 2, 1.0, 0),
    (0, 0, 0, 2, 0.0, 1, 1.0, 2, 1.0, 0), (0, 0, 0, 1, 0.0, 0, 0.0, 1, 1.0, 0), (0, 0, 0, 2, 0.0, 1, 0.0, 3, 1.0, 0),
    (0, 0, 0, 3, 0.0, 4, 1.0, 6, 1.0, 0), (0, 0, 1, 1, 0.0, 5, 1.0, 4, 1.0, 0), (0, 0, 0, 1, 0.0, 6, 0.0, 2, 1.0, 0),
)

#: Elements by what they do to the text.
UNSEEN = frozenset("script style head title template noscript svg math iframe object canvas audio video map".split())
RAW = frozenset("script style title textarea iframe noscript noframes xmp noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br input".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SINGLE = HEADINGS | {"p"}  # ended by the next block
ARTICLE = frozenset(("article", "main"))
FURNITURE = frozenset("nav footer aside form menu dialog button select textarea fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe subscription signup login social share sharing related recommended comment comments disqus "
    "pagination pager widget copyright toolbar".split()
)
PAGE_HEADER = frozenset(("header", "topbar"))
#: Parts of a class that tell a state or a layout ("has-sidebar", "comments-open"), not what the element is.
STATES = frozenset("has with without no is hide show enabled disabled open closed on off free price".split())
#: Parts that name the page's own text; a class of its own for it outweighs the layout in another one.
OWN_TEXT = frozenset("content main article post page entry story site".split())
#: Elements that may stand in a head; any other one ends it, as its end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"'=]++|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD_PARTS = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    words: int
    link_words: int
    furniture: bool
    in_article: bool
    heading: bool


class _Element(NamedTuple):
    name: str
    unseen: bool
    furniture: bool
    in_article: bool
    heading: bool
    in_form: bool = False  # furniture only because a form is around it


def _element(name: str, rest: str, up: _Element) -> _Element:
    furniture, hidden = up.furniture or name in FURNITURE, False
    in_form = up.in_form if up.furniture else name == "form"
    if in_form and name in ARTICLE:  # a form around the whole page
        furniture = in_form = False
    named: list[str] = []
    if name == "header" and not up.in_article:
        furniture = True
    for key, *values in ATTRIBUTE.findall(rest) if rest else ():
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            named += value.split()
        elif key == "role" and value in ROLES:
            furniture = True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    if named and name not in ("html", "body"):
        parts = [set(WORD_PARTS.findall(n)) for n in named]
        parts = [p for p in parts if not p & STATES]
        if any(p & OWN_TEXT and not p & NAMES for p in parts):
            parts = []
        if any(p & NAMES or p & PAGE_HEADER and not up.in_article for p in parts):
            furniture, in_form = True, False
    return _Element(name, up.unseen or hidden or name in UNSEEN, furniture, up.in_article or name in ARTICLE, up.heading or name in HEADINGS, in_form)


def blocks(html: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    stack = [_Element("", False, False, False, False)]
    pieces: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                linked = sum(len(p.split()) for p, in_link in pieces if in_link)
                top = stack[-1]
                words = len(text.split())
                out.append(Block(text, words, min(linked, words), top.furniture, top.in_article, top.heading))
            pieces.clear()

    at, size = 0, len(html)
    while at < size:
        m = MARKUP.search(html, at)
        upto = m.start() if m else size
        if upto > at and not stack[-1].unseen:
            pieces.append((unescape(html[at:upto]), links > 0))
        if m is None:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE:
                flush()
                if any(e.name == name for e in stack):
                    while stack.pop().name != name:
                        pass
            elif any(e.name == name for e in stack):  # an inline element that is marked as furniture
                flush()
                while stack.pop().name != name:
                    pass
            continue
        closed = m["rest"].endswith("/")
        if stack[-1].name == "head" and name not in IN_HEAD:
            stack.pop()
        if name == "br" or name == "wbr" or name == "hr" and not flush():
            if name != "wbr" and not stack[-1].unseen:
                pieces.append((" ", False))
            continue
        if name == "a":
            links += 1
            continue
        element = _element(name, m["rest"], stack[-1])
        if name in INLINE:
            if (element.furniture, element.unseen) != (stack[-1].furniture, stack[-1].unseen) and name not in VOID:
                flush()
                stack.append(element)
        else:
            flush()
            if stack[-1].name in SINGLE:
                stack.pop()
                element = _element(name, m["rest"], stack[-1])
            if name not in VOID and not (closed and name in ("svg", "path")):
                stack.append(element)
        if name in RAW:  # its content is no markup
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = found.start() if found else size
    flush()
    return out


# --- the tree -----------------------------------------------------------------


class Node(NamedTuple):
    feature: int
    cut: float
    low: Node | None
    high: Node | None
    content: bool


def gini(rows: list[tuple]) -> float:
    """Impurity times the number of rows."""
    good = sum(r[-1] for r in rows)
    return 2 * good * (len(rows) - good) / len(rows) if rows else 0.0


def grow(rows: list[tuple], depth: int = 6) -> Node:
    """Splits between neighbouring values until leaves are pure; the first of equal splits counts."""
    content = 2 * sum(r[-1] for r in rows) >= len(rows)
    best = None
    if depth and gini(rows) > 0:
        for k in range(len(FEATURES)):
            values = sorted({r[k] for r in rows})
            for a, b in zip(values, values[1:]):
                cut = (a + b) / 2
                left = gini([r for r in rows if r[k] <= cut]) + gini([r for r in rows if r[k] > cut])
                if best is None or left < best[0] - 1e-9:
                    best = (left, k, cut)
    if best is None:
        return Node(0, 0.0, None, None, content)
    _, k, cut = best
    return Node(k, cut, grow([r for r in rows if r[k] <= cut], depth - 1), grow([r for r in rows if r[k] > cut], depth - 1), content)


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(list(LABELLED))


def described(found: list[Block]) -> list[tuple]:
    """FEATURES of each block."""
    shape = [(0, 0.0), *((b.words, b.link_words / b.words) for b in found), (0, 0.0)]
    return [(int(b.furniture), int(b.in_article), int(b.heading), *shape[i + 1], *shape[i], *shape[i + 2]) for i, b in enumerate(found)]


def is_content(features: tuple) -> bool:
    node = tree()
    while node.low is not None:
        node = node.low if features[node.feature] <= node.cut else node.high
    return node.content


def extract(html: str | None) -> str:
    found = blocks(html) if html else []
    has_article = any(b.in_article and not b.furniture for b in found)
    kept = [b.text for b, f in zip(found, described(found)) if (b.in_article or not has_article) and is_content(f)]
    return "\n\n".join(kept)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [extract(h) for h in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("CAST(page_id AS LONG) AS page_id", "CAST(url AS STRING) AS url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
