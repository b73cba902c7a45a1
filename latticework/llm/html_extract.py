"""Main text of web pages by scoring the tree.

A page is parsed into a tree, and what is never main text (scripts, forms,
navigation, blocks whose class or id names an advert, a sidebar, a notice or
reader comments) is taken out. Every paragraph earns points for its length and
its commas, which go to its parent in full and to further ancestors in falling
parts; a container's points are discounted by its link density. The best
container is kept whole. Around it, on every level up to the body, bare text,
headings and text-like elements are kept too, and containers that have a heading
or a share of the points; inside an article or main element, all of that element
but blocks of links. Pages are parsed one by one, in time and memory in
proportion to the page, however deep it is nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow

RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav aside footer form button select option dialog menu svg math canvas object audio video head input label fieldset".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
TEXTUAL = PARAGRAPHS | frozenset("h1 h2 h3 h4 h5 h6 ul ol dl table figure figcaption hr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Open elements that a start tag ends, and those at which the search stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, {"p", "li", "td", "div", "table"})}
STOPS = frozenset({"table", "td", "th", "button", "body", "html"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_UNLIKELY = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar\w*|side-?bar|widget|menu\w*|nav\w*|navbar|breadcrumbs?|footer|header|masthead|comment\w*|disqus|respond|replies|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommend\w*|pagination|pager|login|signup|search)(?=$|[\s_-]|\d)", re.I)
_ROLES = frozenset("navigation banner complementary contentinfo search form alert dialog menu menubar".split())
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Attributes up to the ``>`` that ends a tag: not one in a quoted value; a quote that is never closed is a plain character.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: Characters of a paragraph below which it earns nothing, points at most for length.
LEAST, MOST = 25, 3.0
#: The part of a paragraph's points that goes to its parent, the next ancestors and all further ones.
SHARES = (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15)
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("chars", "heading", "kids", "linked", "out", "parent", "points", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, out: bool = False):
        self.tag, self.parent, self.out = tag, parent, out
        self.kids: list[Node | str] = []
        self.score, self.points = 0.0, None
        self.chars = self.linked = 0
        self.heading = False


def _chrome(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in _ROLES or name in ("class", "id") and _UNLIKELY.search(value):
            return True
    return False


class _Open:
    """The open elements, outermost first, and the depths at which each tag is open."""

    def __init__(self, root: Node):
        self.line, self.depths, self.blocks = [root], {root.tag: [0]}, [0]

    def push(self, node: Node) -> None:
        if node.tag not in INLINE:
            self.blocks.append(len(self.line))
        self.depths.setdefault(node.tag, []).append(len(self.line))
        self.line.append(node)

    def cut(self, depth: int) -> None:
        """End all elements from ``depth`` on; the root stays."""
        while len(self.line) > max(depth, 1):
            node = self.line.pop()
            self.depths[node.tag].pop()
            if self.blocks[-1] == len(self.line):
                self.blocks.pop()

    def last(self, tags: Iterable[str]) -> int:
        """Depth of the innermost open element of these tags, or -1."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)


def parse(html: str) -> Node:
    root = Node("html", None)
    open_ = _Open(root)
    place, n = 0, len(html)
    while place < n:
        at = open_.line[-1]
        start = html.find("<", place)
        if start < 0:
            start = n
        if start > place:
            at.kids.append(html[place:start])
        if start >= n:
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            place = n if end < 0 else end + 3
            continue
        after = html[start + 1 : start + 2]
        if after in ("!", "?"):
            end = html.find(">", start)
            place = n if end < 0 else end + 1
            continue
        closing = after == "/"
        m = _NAME.match(html, start + 1 + closing)
        if not m:
            at.kids.append("<")
            place = start + 1
            continue
        rest = _REST.match(html, m.end())
        if not rest:
            break
        tag, attributes, place = m[0].lower(), rest[1], rest.end()
        if closing:
            depth = open_.last((tag,))
            # a stray end tag of inline markup doesn't close blocks
            if depth > 0 and (tag not in INLINE or depth > open_.blocks[-1]):
                open_.cut(depth)
            continue
        if tag in ("html", "body"):
            if at is root and tag == "body":
                body = Node("body", root)
                root.kids.append(body)
                open_.push(body)
            continue
        if tag == "head":
            continue
        for ended, stops in ((({"p"}, STOPS),) if tag in CLOSES_P else ()) + ((IMPLIED[tag],) if tag in IMPLIED else ()):
            depth = open_.last(ended)
            if depth > open_.last(stops):
                open_.cut(depth)
        at = open_.line[-1]
        inside = tag == "header" and open_.last(("article", "main")) > 0
        node = Node(tag, at, _chrome(tag, attributes, inside))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, place)
            place = n if not close else html.find(">", close.start()) + 1 or n
            continue
        at.kids.append(node)
        if tag not in VOID and not (tag in INLINE and attributes.endswith("/")):
            open_.push(node)
    return root


def _line(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _nodes(root: Node) -> list[Node]:
    """All kept nodes, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [k for k in reversed(node.kids) if isinstance(k, Node) and not k.out]
    return out


def _own_text(node: Node, link: bool) -> tuple[str, int]:
    """Text of a node and the inline markup in it, blocks left out; how many characters of it are links."""
    out, linked, stack = [], 0, [(k, link) for k in reversed(node.kids)]
    while stack:
        k, link = stack.pop()
        if isinstance(k, str):
            out.append(k)
            linked += len(" ".join(unescape(k).split())) if link else 0
        elif not k.out and k.tag in INLINE:
            out.append(" " if k.tag in ("br", "img") else "")
            stack += [(x, link or k.tag == "a") for x in reversed(k.kids)]
    return " ".join(unescape("".join(out)).split()), linked


def blocks(nodes: list[Node | str]) -> list[str]:
    """Texts of the blocks under ``nodes`` in page order, white space folded."""
    out, run = [], []

    def end() -> None:
        if text := " ".join(unescape("".join(run)).split()):
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = [*reversed(nodes)]
    while stack:
        k = stack.pop()
        if k is None:
            end()
        elif isinstance(k, str):
            run.append(k)
        elif not k.out:
            if k.tag in ("br", "img"):
                run.append(" ")
            elif k.tag in INLINE:
                stack += reversed(k.kids)
            else:
                end()
                stack += [None, *reversed(k.kids)]
    end()
    return out


def _score(nodes: list[Node]) -> None:
    """Characters, link characters and points of all nodes, parents before children in ``nodes``.

    A paragraph's points go to its parent in full, to the next five ancestors in
    the parts of SHARES and to all further ones in the last part, so each node
    hands its parent the points by distance. Inline elements are passed through.
    """
    links: dict[int, bool] = {}
    for node in nodes:
        link = links[id(node)] = node.tag == "a" or node.parent is not None and links[id(node.parent)]
        if node.tag in INLINE:
            continue
        text, linked = _own_text(node, link)
        node.chars, node.linked, node.heading = len(text), min(linked, len(text)), node.tag in HEADINGS and bool(text)
        if len(text) >= LEAST and (node.tag in PARAGRAPHS or node.tag in ("div", "section", "article", "main", "body")):
            points = 1 + sum(map(text.count, ",،、，")) + min(len(text) / 100, MOST)
            first = node if node.tag not in PARAGRAPHS else node.parent
            while first.tag in INLINE and first.parent is not None:
                first = first.parent
            first.points = first.points or [0.0] * len(SHARES)
            first.points[0] += points
    for node in reversed(nodes):
        if node.points:
            node.score = sum(p * s for p, s in zip(node.points, SHARES, strict=True))
        above = node.parent
        if above is None:
            continue
        above.chars += node.chars
        above.linked += node.linked
        above.heading |= node.heading
        if node.points:
            moved = node.points if node.tag in INLINE else [0.0, *node.points[:-2], node.points[-2] + node.points[-1]]
            above.points = [a + b for a, b in zip(above.points, moved, strict=True)] if above.points else moved


def _part(node: Node, kids: list[Node | str]) -> Node:
    out = Node(node.tag, None)
    out.kids = kids
    return out


def best(root: Node) -> list[Node | str]:
    """The best container and what is kept around it, in page order."""
    nodes = _nodes(root)
    _score(nodes)
    density = lambda x: min(1.0, x.linked / x.chars) if x.chars else 0.0
    held = [x for x in nodes if x.tag not in INLINE]
    value = lambda x: x.score * (1 - density(x))
    top = max(held, key=value)
    if value(top) <= 0:
        # no paragraph long enough: the article, else the page
        named = [x for x in held if x.tag in ("article", "main") and x.chars]
        return [max(named, key=lambda x: x.chars) if named else root]
    line = [*_line(top)]
    on = {id(x) for x in line}
    textual = lambda k: k.tag in HEADINGS or k.tag == "p" or k.tag in TEXTUAL and density(k) < 0.5
    homes = [x for x in line if x.tag in ("article", "main")]
    if homes:
        # what the page marks as its content is kept whole, but for blocks of links
        return [k for k in homes[-1].kids if isinstance(k, str) or not k.out and (id(k) in on or k.tag in INLINE or textual(k) or density(k) < 0.5)]

    def kept(k: Node | str) -> bool:
        if isinstance(k, str):
            return True
        if k.out or k.tag == "a":
            return False
        return k.tag in INLINE or textual(k) or value(k) >= SIBLING_SHARE * value(top) or k.heading and density(k) < 0.5

    found = top
    for above in line[1:]:
        found = _part(above, [found if id(k) in on else k for k in above.kids if not isinstance(k, str) and id(k) in on or kept(k)])
    return [found]


def main_text(html: str | None) -> str:
    """Main text of one page: its blocks joined by line ends; empty if there is none."""
    return "\n".join(blocks(best(parse(html)))) if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace ``html`` of all of ``pages`` by text, and add n_chars (code points).

    Null and empty pages have an empty text. Equal rows get equal texts; other
    columns are passed through, but for those named text or n_chars.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(main_text)

    narrow(pages.sparkSession)
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    found = pages.select(*[F.col(f"`{c}`") for c in names], run(F.coalesce(F.col(html), F.lit(""))).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
