"""Main text of web pages by composite text density.

A page is parsed into a tree (optional end tags implied, stray ones ignored).
Every node has C characters, T tags, LC characters and LT tags inside links; its
composite text density is

    C / T * log(C / LC * T / LT, base ln(C / (C - LC) * LC + LCbody / Cbody * C + e))

with zeros counted as one. The density sum of a node is the sum of its
children's densities. The node with the highest sum is taken, and the threshold
is the least density on its path to the body. The text is that of the article
(or main element) around the node if there is one, else of the smallest
container around it and of everything beside its path to the body that is at or
above the threshold or not mostly links, so that an article of several sections
stays whole.

Subtrees that markup names as something else than the article are cut before
anything is counted: elements that never hold it (TAGS), hidden ones, and, as
far as they do not hold the article (`_cut`), page parts (PARTS) and those whose
class, id or role has one of NAMES as a whole token. An element of running text, a
paragraph of class "share", say, is cut for one of SURE alone, or if it is mostly links.

Defined results: a null or empty page, or one without text, gives an empty text;
white space within a block becomes one space, and blocks are joined, in page
order, by one; a page is read whole, whatever its length or depth; one row per
input row, also for repeated or null ids; a null url stays null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import session

TAGS = frozenset("head script style noscript template button select option textarea input iframe object embed svg canvas audio video map".split())
PARTS = frozenset("nav header footer aside form dialog menu".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu menubar navbar nav navigation breadcrumb breadcrumbs sidebar aside "
    "footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations trending comment comments commentlist disqus respond replies pagination pager toolbar widget skip hidden search complementary contentinfo".split()
)
#: Of these, the ones that say enough about a paragraph or a word; the others may describe the text in it.
SURE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent newsletter subscribe subscription pagination pager breadcrumb breadcrumbs skip hidden".split())
#: Elements that hold running text and no parts of a page.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meta q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CONTAINERS = frozenset("html body article main section div td center".split())
#: An element's start closes these, up to the nearest of its second list.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "body": ({"head"}, set()),
}
_PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("html body table td th button object article section div main aside header footer nav li".split())
_IN_HEAD = frozenset("title meta link base script style noscript template head html".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<!?(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)(?=>)|[^>]*)(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


class Tree:
    """Nodes in page order as parallel lists; children come after their parent. items: of each node, its children and texts in order; cut: never read; doubted: cut unless it holds the article; linked: cut if mostly links."""

    def __init__(self, page: str):
        self.tag, self.parent, self.cut, self.doubted = ["html"], [-1], [False], [False]
        self.items: list[list] = [[]]
        self.linked: list[int] = []
        self._open = [0]
        at = 0
        while at < len(page):
            m = _TOKEN.search(page, at)
            if m is None:
                self._text(page[at:])
                break
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            name = m[2] and m[2].lower()
            if not name or m[0].startswith("<!"):
                continue
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                body = page[at : close.start()] if close else page[at:]
                if name in ("title", "textarea"):
                    self._text(body)
                at = close.start() if close else len(page)

    def _text(self, s: str) -> None:
        if len(self._open) > 1 and self.tag[self._open[-1]] == "head" and s.strip():
            self._open.pop()
        self.items[self._open[-1]].append(s)

    def _pop_to(self, names, scope) -> None:
        """Close up to and with the nearest open element of these names, unless one of scope stands before it."""
        for k in range(len(self._open) - 1, 0, -1):
            t = self.tag[self._open[k]]
            if t in names:
                del self._open[k:]
                return
            if t in scope:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name == "html":
            return
        if name not in _IN_HEAD and self.tag[self._open[-1]] == "head":
            self._open.pop()
        if name in CLOSES:
            self._pop_to(*CLOSES[name])
        if name in _PARAGRAPH_ENDS:
            self._pop_to({"p"}, _SCOPE)
        cut, doubted = name in TAGS, name in PARTS
        if not cut and attributes and name not in ("body", "article", "main"):
            cut = bool(_HIDDEN.search(attributes))
            tokens = {w for x in _NAMED.findall(attributes) for w in x.strip("\"'").lower().split()}
            if name in TEXTUAL or name in INLINE:
                doubted = not tokens.isdisjoint(SURE)
                if not doubted and not tokens.isdisjoint(NAMES):
                    self.linked.append(len(self.tag))
            else:
                doubted = doubted or not tokens.isdisjoint(NAMES)
        i, up = len(self.tag), self._open[-1]
        self.tag.append(name)
        self.parent.append(up)
        self.cut.append(cut or self.cut[up])
        self.doubted.append(doubted)
        self.items.append([])
        self.items[up].append(i)
        if name not in VOID:
            self._open.append(i)

    def _end(self, name: str) -> None:
        if name in INLINE:
            self._pop_to({name}, _SCOPE)
        elif name == "p":
            self._pop_to({"p"}, _SCOPE)
        elif name not in ("html", "body"):
            self._pop_to({name}, ())


def _cut(t: Tree) -> None:
    """Cut the doubted nodes that do not hold the article.

    One is kept if it has most of the body's characters outside links, unless an article or main with text stands apart
    from it; and if it holds an article or main with text and none stands outside doubted nodes.
    """
    if not any(t.doubted) and not t.linked:
        return
    n = len(t.tag)
    text, linked, named = [0] * n, [0] * n, [False] * n
    for i in range(n - 1, -1, -1):
        if t.cut[i]:
            continue
        text[i] += sum(len(x.strip()) for x in t.items[i] if x.__class__ is str)
        if t.tag[i] == "a":
            linked[i] = text[i]
        if i:
            up = t.parent[i]
            text[up] += text[i]
            linked[up] += linked[i]
            named[up] = named[up] or named[i] or (t.tag[i] in ("article", "main") and text[i] > 0)
    for i in t.linked:
        t.cut[i] = t.cut[i] or 2 * linked[i] > text[i]
    inside, under = [False] * n, [False] * n  # in an article or main; in or at a doubted node
    under[0] = t.doubted[0]
    apart = False
    for i in range(1, n):
        up = t.parent[i]
        inside[i] = inside[up] or t.tag[up] in ("article", "main")
        under[i] = under[up] or t.doubted[i]
        apart = apart or (t.tag[i] in ("article", "main") and text[i] > 0 and not under[i])
    whole = text[0] - linked[0]
    for i in range(1, n):
        most = 2 * (text[i] - linked[i]) > whole and (inside[i] or not apart)
        t.cut[i] = t.cut[i] or t.cut[t.parent[i]] or (t.doubted[i] and not most and not (named[i] and not apart))


def densities(t: Tree) -> tuple[list[int], list[int], list[float], list[float], int]:
    """Of each node the characters, those in links, the composite text density and the sum of its children's; and the body's place, -1 without text."""
    n = len(t.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if t.cut[i]:
            continue
        chars[i] += sum(len(x.strip()) for x in t.items[i] if x.__class__ is str)
        if t.tag[i] == "a":
            link_chars[i], link_tags[i] = chars[i], tags[i] + 1
        if i:
            up = t.parent[i]
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i]
    density, total = [0.0] * n, [0.0] * n
    body = next((i for i in range(n) if t.tag[i] == "body"), 0)
    if not chars[body]:
        body = 0
    if not chars[body]:
        return chars, link_chars, density, total, -1
    share = link_chars[body] / chars[body]
    for i in range(n - 1, -1, -1):
        c = chars[i]
        if c:
            lc, lt, tg = max(1, link_chars[i]), max(1, link_tags[i]), max(1, tags[i])
            base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + share * c + math.e)
            density[i] = c / tg * math.log(max(1.0, c / lc * tg / lt)) / (math.log(base) if base > 1.0000001 else 1.0)
            if i:
                total[t.parent[i]] += density[i]
    return chars, link_chars, density, total, body


def extract(page: str | None) -> str:
    if not page:
        return ""
    t = Tree(page)
    _cut(t)
    n = len(t.tag)
    chars, link_chars, density, total, body = densities(t)
    if body < 0:
        return ""
    best = max(range(n), key=lambda i: (total[i], -i)) if any(total) else body
    path, i = [best], best
    while i != body and t.parent[i] >= 0:
        i = t.parent[i]
        path.append(i)
    threshold = min(density[i] for i in path)
    named = [i for i in path if t.tag[i] == "article"] or [i for i in path if t.tag[i] == "main"]
    if named:
        roots = [named[-1]]
    else:
        at = next(k for k, i in enumerate(path) if t.tag[i] in CONTAINERS or t.parent[i] < 0)
        on = set(path)
        for i in path[at + 1 :] if at + 1 < len(path) else path[at:]:
            for x in t.items[i]:
                if x.__class__ is not str and x not in on and density[x] < threshold and 3 * link_chars[x] > chars[x]:
                    t.cut[x] = True
        roots = [path[-1]]
    return _join(t, [t.items[r] for r in roots])


def _join(t: Tree, lists: list[list]) -> str:
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        if now:
            if words := "".join(now).split():
                blocks.append(" ".join(words))
            now.clear()

    for items in lists:
        stack: list = [iter(items)]
        ends: list[bool] = []
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
                if ends and ends.pop():
                    close()
            elif x.__class__ is str:
                now.append(unescape(x))
            elif not t.cut[x]:
                block = t.tag[x] not in INLINE
                if block:
                    close()
                stack.append(iter(t.items[x]))
                ends.append(block)
        close()
    return " ".join(blocks)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars. No shuffle."""
    session(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ts.pieces(batches, "html"):
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
