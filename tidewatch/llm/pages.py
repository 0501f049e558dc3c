"""The main text of a web page by scoring its tree.

Each paragraph passes points for its length and commas to its ancestors; a container's points are discounted by the
share of its text that is in links. The best container is kept with those siblings that read like it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import own_name, ship, text_of

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp")
LEFT_OUT = frozenset(
    "head nav header footer aside form button select option datalist dialog menu svg math canvas object audio video map"
    .split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd dt figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An opening tag of the first kind ends an open element of the second.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
SCOPES = frozenset("table td th ul ol dl body html article section div".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog".split())
# Elements that no word in class or id drops, and those of them that hold an article.
WHOLE = frozenset("html body article main".split())
ARTICLES = frozenset("article main".split())
# Words in class and id of what is not the article, unless the element holds the page's article or nearly all its points.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos"
    " promotion cookie cookies consent gdpr newsletter subscribe subscription signup login paywall".split()
)
# Of these the words for what readers say.
COMMENTS = frozenset("comment comments commentlist disqus respond response responses reply replies".split())
# Words that mark it too, unless the element holds most of the page's points.
SELDOM = frozenset(
    "nav navbar navigation menu menus header masthead footer sidebar side aside banner breadcrumb breadcrumbs notice"
    " notices popup modal overlay share sharing social related recommended recommendations widget widgets toolbar"
    " pagination pager skip toc tags meta byline".split()
)
# Words before or after one of those that make it a remark on the page instead.
UNLESS_BEFORE = frozenset("has with no without".split())
UNLESS_AFTER = frozenset("open closed enabled disabled allowed count".split())

# A paragraph gives a point, one per comma and one per so many code points, up to a bound.
CHARS_PER_POINT, MOST_LENGTH_POINTS = 100, 3
# A sibling is kept with this share of the best container's points, or as a long paragraph with few links.
SIBLING_SHARE, SIBLING_CHARS, SIBLING_LINKS = 0.2, 80, 0.25
# A class that seldom holds the article is overruled by this share of all points, one that never should by the next, one
# of comments by the last: a thread may well be longer than the article.
MOST, NEARLY_ALL, ALL = 0.5, 0.75, 0.95
# On a page without article element, one of these that is mostly links by this share is a menu.
MENU_LINKS, MENUS = 0.5, frozenset("ul ol dl table div section".split())
TAG_POINTS = {"article": 10, "main": 10, "div": 5, "section": 3, "td": 3, "pre": 3, "blockquote": 3} | dict.fromkeys(
    ("ul", "ol", "dl", "li", "dd", "dt", "address"), -3) | dict.fromkeys(HEADINGS, -5)

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|</?[a-z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Node:
    __slots__ = ("tag", "parent", "items", "never", "marked", "comments", "seldom", "points", "own", "chars", "linked")

    def __init__(self, tag: str, parent: _Node | None, attrs: str = ""):
        self.tag, self.parent, self.items = tag, parent, []
        self.points = self.own = 0.0
        self.chars = self.linked = 0
        self.never, self.marked, self.comments, self.seldom = tag in LEFT_OUT, False, False, False
        if attrs and not attrs.isspace():
            self._read(attrs)

    def _read(self, attrs: str) -> None:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        if ("hidden" in found or found.get("aria-hidden", "").lower() == "true"
                or found.get("role", "").lower() in LEFT_OUT_ROLES
                or "display:none" in found.get("style", "").replace(" ", "").lower()):
            self.never = True
        words = [w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")]
        said = {w for b, w, a in zip(["", *words], words, [*words[1:], ""], strict=False)
                if b not in UNLESS_BEFORE and a not in UNLESS_AFTER}
        self.comments = not COMMENTS.isdisjoint(said)
        self.marked = self.comments or not NEVER.isdisjoint(said)
        self.seldom = self.tag not in WHOLE and not self.marked and not SELDOM.isdisjoint(said)


def _tree(page: str) -> _Node:
    root = _Node("", None)
    here, at = root, 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            here.items.append(entities.unescape(page[at:m.start()]))
        at = m.end()
        if (name := m["name"]) is None:
            continue
        name = name.lower()
        if m["close"]:
            node = here
            while node is not root and node.tag != name:
                if node.tag in ("td", "th", "table") and name in INLINE:
                    break
                node = node.parent
            if node is not root and node.tag == name:
                here = node.parent
            continue
        if name in ("html", "body") and any(x.tag == name for x in _up(here)):
            continue
        if name == "body":
            here = next((x for x in _up(here) if x.tag == "html"), root)
        ended = ENDS.get(name) or (("p",) if name not in INLINE and name not in VOID else ())
        if ended:
            node = here
            while node is not root and node.tag not in ended and (node.tag not in SCOPES or name == "tr" and node.tag in ("td", "th")):
                node = node.parent
            if node.tag in ended:
                here = node.parent
                if name == "tr" and node.tag in ("td", "th"):
                    while here.tag in ("tr",):
                        here = here.parent
        node = _Node(name, here, m["attrs"] or "")
        here.items.append(node)
        if name not in VOID and not (m["attrs"] or "").endswith("/"):
            here = node
        elif name not in VOID and name not in ("svg", "path"):
            here = node
    if at < len(page):
        here.items.append(entities.unescape(page[at:]))
    return root


def _up(node: _Node | None) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.parent


def _in_order(root: _Node) -> list[_Node]:
    """All nodes but the left-out ones, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.never:
            out.append(node)
            todo += [x for x in reversed(node.items) if isinstance(x, _Node)]
    return out


def _score(nodes: list[_Node]) -> None:
    """Points of every container, and characters in and outside of links."""
    for node in nodes:
        node.points = node.own = 0.0
        node.chars = node.linked = 0
    for node in reversed(nodes):
        node.chars += sum(len(x.strip()) for x in node.items if isinstance(x, str))
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for node in nodes:
        direct = [x for x in node.items if isinstance(x, str)]
        if node.tag not in PARAGRAPHS and not (node.tag not in INLINE and node.tag not in HEADINGS and any(map(str.strip, direct))):
            continue
        if node.tag in PARAGRAPHS:
            text, chars = _inner(node), node.chars - node.linked
        else:
            text = " ".join(direct)
            chars = len(text.strip())
        if not chars:
            continue
        commas = sum(map(text.count, (",", "，", "、", "،")))
        points = (1 + commas + min(chars / CHARS_PER_POINT, MOST_LENGTH_POINTS)) * (1 - node.linked / max(1, node.chars))
        node.own = points
        share, up = 1.0, node.parent if node.tag in PARAGRAPHS else node
        for level in range(4):
            if up is None:
                break
            up.points += points * share
            share, up = (0.5, 0.17, 0.11, 0)[level], up.parent


def _inner(node: _Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.never and (x is node or x.tag not in PARAGRAPHS):
            todo += reversed(x.items)
    return "".join(out)


def _value(node: _Node) -> float:
    return (node.points + TAG_POINTS.get(node.tag, 0)) * (1 - node.linked / max(1, node.chars)) if node.points else 0.0


def _blocks(nodes: list[_Node]) -> Iterator[str]:
    """The text of each block in page order, white space made one space."""
    line: list[str] = []
    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None or isinstance(x, _Node) and (x.tag in ("br", "hr")):
            if words := "".join(line).split():
                yield " ".join(words)
            line = []
        elif isinstance(x, str):
            line.append(x)
        elif not x.never:
            inline = x.tag in INLINE
            todo += (*(() if inline else (None,)), *reversed(x.items), *(() if inline else (None,)))
    if words := "".join(line).split():
        yield " ".join(words)


def _held(nodes: list[_Node], values: list[float]) -> dict[int, float]:
    """By ``id`` of each node the sum of its own value and those of all it holds."""
    held = {id(n): x for n, x in zip(nodes, values, strict=True)}
    for n in reversed(nodes):
        if n.parent is not None:
            held[id(n.parent)] += held[id(n)]
    return held


def _is_article(n: _Node) -> bool:
    return n.tag in ARTICLES and not n.marked


def _may_go(n: _Node) -> bool:
    """An article element goes as well where it is marked, such as a single comment."""
    return n.marked and (n.tag not in WHOLE or n.tag == "article")


def _drop_marked(nodes: list[_Node]) -> None:
    """Leave out what a word of ``NEVER`` or ``COMMENTS`` marks, but not a wrapper of the article.

    That is an element that holds articles while there is none beside it, or one with nearly all points and no article
    beside it that it lacks. Articles that are marked themselves don't count, nor does an element that holds this one.
    """
    points = _held(nodes, [n.own for n in nodes])
    articles = _held(nodes, [float(_is_article(n)) for n in nodes])
    around: dict[int, int] = {}
    for n in nodes:
        around[id(n)] = around[id(n.parent)] + _is_article(n.parent) if n.parent is not None else 0
    for n in nodes:
        if _may_go(n):
            inside = articles[id(n)]
            beside = articles[id(nodes[0])] - inside - around[id(n)]
            nearly_all = points[id(n)] > (ALL if n.comments else NEARLY_ALL) * points[id(nodes[0])]
            n.never = not (inside and not beside or nearly_all and (inside or not beside))


def _links(n: _Node) -> float:
    return n.linked / max(1, n.chars)


def main_text(page: str) -> str:
    """The article of a page: the best container with its siblings, blocks joined by one space."""
    root = _tree(page)
    nodes = _in_order(root)
    _score(nodes)
    total = sum(n.own for n in nodes)
    if any(map(_may_go, nodes)):
        _drop_marked(nodes)
        nodes = _in_order(root)
        _score(nodes)
        total = sum(n.own for n in nodes)
    if any(n.seldom for n in nodes):
        held = _held(nodes, [n.own for n in nodes])
        for n in nodes:
            n.never |= n.seldom and held[id(n)] <= MOST * total
        nodes = _in_order(root)
        _score(nodes)
    best = max(nodes, key=_value, default=root)
    if not best.points:
        best = next((n for tag in ("article", "main", "body", "") for n in nodes if n.tag == tag), root)
        return " ".join(_blocks([best]))
    article = next((n for n in _up(best) if n.tag in ARTICLES), None)
    if article is None:
        if _links(best) < MENU_LINKS:
            held = {id(n) for n in _up(best)}
            for n in nodes:
                n.never |= n.tag in MENUS and id(n) not in held and n.chars > 0 and _links(n) >= MENU_LINKS
        return " ".join(_blocks(_beside(best)))
    keep, least = [], max(10.0, SIBLING_SHARE * _value(article))
    for x in article.parent.items if article.parent is not None else [article]:
        if not isinstance(x, _Node) or x.never:
            continue
        links = _links(x)
        if (x is article or x.tag in HEADINGS or _value(x) >= least and links < SIBLING_LINKS
                or x.tag in PARAGRAPHS and x.chars >= SIBLING_CHARS and links < SIBLING_LINKS):
            keep.append(x)
    return " ".join(_blocks(keep))


def _beside(best: _Node) -> list:
    """The best container and all beside it that is not mostly links, on a page that doesn't say where its article is.

    Text and blocks of any length stay: nothing tells a short last paragraph from the rest. A wrapper that holds one
    block only is no level of its own.
    """
    while best.parent is not None and best.parent.chars == best.chars:
        best = best.parent
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    return [x for x in best.parent.items
            if isinstance(x, str) or x is best or not x.never and (x.tag in HEADINGS or _links(x) < MENU_LINKS)]


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with a column ``text``: the article of the whole page.

    Kept is the best container with its siblings, without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, markup and comments; empty where a page has no text. NULL and empty pages give the empty text.
    Broken markup is read as far as it goes. Pages are independent, so repeated rows, ties of ids and an empty table
    need no rule; of containers with equal points the first wins. A column of the name ``text`` is replaced, all others
    pass untouched.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    return pages.withColumn(text, texts(text_of(html)))


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page: its main text and the text's length in code points."""
    text = own_name(pages.select("page_id", "url", "html"), "text")
    return extract(pages.select("page_id", "url", "html"), text=text).select(
        "page_id", "url", text, F.length(text).cast("long").alias("n_chars"))
