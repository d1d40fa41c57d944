"""Main text of web pages by composite text density.

1. For every node of the DOM with C characters, LC of them in links, T tags and
   LT link tags below it, the density is
       C / T * log_b((C / LC) * (T / LT)),  b = ln(C / (C - LC) * LC + LCb / Cb * C + e)
   (zero counts as 1; Cb, LCb: of the body). Elements that never hold article
   text (menus, page headers and footers, forms, scripts, styles, hidden ones)
   take no part in the counts.
2. Names in class, id or role that mark a block as sidebar, advert, notice or
   comments are evidence, weighed by text: a block marked by a name that says
   nothing else is left out unless the page has hardly a sentence elsewhere, and no
   article element with text; one whose name has other words too, unless it holds more unlinked text than all
   that isn't marked. So marks never empty a page that has paragraphs.
3. The subtree with the largest sum of its children's densities is the core. The
   smallest density on its path to the body is the threshold. Beside the path,
   body included, every block that reaches it belongs to the article, and so do
   those that hold half the core's unlinked characters a tag, paragraphs and
   headings that aren't mostly links.
4. Inside, lists that are links alone are menus, unless they are in an article
   element or under a heading.

Defined results: a null or empty page, and one without text, gives an empty
text. Unclosed and misnested tags are closed as their parents close; text
outside the body counts as in it. Repeated pages get a row each. Time is linear
in the page and in its depth, so very long and very deep pages are no exception.
Columns other than the three named ones are not read.
"""

from __future__ import annotations

import heapq
import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input iframe object embed svg canvas audio video map dialog menu noembed noframes".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An opening tag closes an open element of these kinds, if none of the walls is between.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id or role that mark a block as no article text.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer masthead topbar toolbar share sharing social comment comments discussion disqus respond reply replies related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget complementary contentinfo skip toc".split()
)
ARTICLE = frozenset(("article", "main"))
#: Marks that are plain words too: they count only among marks and parts.
WEAK = frozenset("side social search share related notice notices promotion subscription skip login signup consent".split())
PARTS = frozenset("a bar block box button buttons content container follow form group icon icons inner item items left link links list main media page post posts primary right row section secondary stories top bottom title wrap wrapper area header results".split())
#: A mark after one of these says what a page has or lacks.
STATES = frozenset("no not non without has have with hide".split())
#: A block of fewer unlinked characters is no article.
SENTENCE = 80
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
PARAGRAPHS = frozenset(("p", "blockquote", "pre", "figure", "dl", "ol", "ul", "table")) | HEADINGS
LISTS = frozenset(("ul", "ol", "div", "section", "table"))

_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*)>|[!?/][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=\"'>/][^\s=>/]*+)\s*+(?:=\s*+(\"[^\"]*+\"?|'[^']*+'?|[^\s>]++))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marked_by(value: str) -> int:
    """0: no name of a class or id is a mark; 1: one is, among other words; 2: one
    says nothing else."""
    found = 0
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        only = all(x in MARKS or x in PARTS for x in words)
        for k, w in enumerate(words):
            if w in MARKS and not STATES.intersection(words[:k]) and (w not in WEAK or only and "by" not in words):
                found = max(found, 1 + only)
    return found


def _attributes(attrs: str) -> dict:
    """Names and values; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        found.setdefault(name.lower(), value.strip("\"'"))
    return found


def _marked(tag: str, attrs: str) -> tuple[bool, int]:
    """If an element is hidden; else how it is marked."""
    if tag in ("html", "body", "article", "main"):
        return False, 0
    named = _attributes(attrs)
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" and tag not in ("p", "span"):
        return True, 0
    return False, _marked_by(" ".join(named.get(k, "") for k in ("class", "id", "role")))


class Dom:
    """Nodes in page order (a parent before its children) and the text events."""

    def __init__(self, page: str):
        self.tag, self.parent, self.drop = ["#"], [0], [False]
        self.marks: dict[int, int] = {}
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) at the edge of a block
        self.stack = [0]
        self.places: dict[str, list[int]] = {}  # name -> places on the stack of its open elements
        pos = 0
        last = page.rfind(">")  # no search for the end of a tag that has none; a comment may be open to the end
        end_of_tags = len(page) if page.rfind("<!") > last else last + 1
        while m := _TAG.search(page, pos, end_of_tags):
            if m.start() > pos:
                self.text(self.stack[-1], page[pos : m.start()])
            pos = m.end()
            name = (m[3] or "").lower()
            if not name:
                continue
            if m[2]:
                self.close(name)
                continue
            node = self.open(name, m[4])
            if name in VOID or m[4].endswith("/") and name in ("svg", "path"):
                self.pop()
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, pos)
                if not self.drop[node]:
                    self.text(node, page[pos : end.start() if end else len(page)])
                pos = end.end() if end else len(page)
                self.pop()
        if pos < len(page):
            self.text(self.stack[-1], page[pos:])

    def text(self, node: int, raw: str) -> None:
        if not self.drop[node]:
            self.events.append((node, entities.unescape(raw) if "&" in raw else raw))

    def edge(self, node: int) -> None:
        if self.tag[node] not in INLINE:
            self.events.append((node, None))

    def top(self, names) -> int:
        """The highest place on the stack of an open element of these names; 0: none."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def pop(self) -> int:
        node = self.stack.pop()
        self.places[self.tag[node]].pop()
        return node

    def pop_from(self, place: int) -> None:
        while len(self.stack) > place:
            self.edge(self.pop())

    def open(self, name: str, attrs: str) -> int:
        if name in CLOSES_P:
            self.pop_to(("p",), ("button", "table", "td", "th", "object", "caption"))
        if name in CLOSED_BY:
            self.pop_to(*CLOSED_BY[name])
        above = self.stack[-1]
        dropped = self.drop[above] or name in DROPPED or name == "header" and not self.top(ARTICLE)
        mark = 0
        if attrs and not dropped:
            dropped, mark = _marked(name, attrs)
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(above)
        self.drop.append(dropped)
        if mark:
            self.marks[node] = mark
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(node)
        self.edge(node)
        return node

    def pop_to(self, names, walls) -> None:
        place = self.top(names)
        if place and place > self.top(walls):
            self.pop_from(place)

    def close(self, name: str) -> None:
        place = self.top((name,))
        if not place:
            if name in ("br", "p"):
                self.edge(self.open(name, ""))
                self.pop()
        elif name not in INLINE or place > self.top(("td", "th", "table", "article", "body")):
            self.pop_from(place)


class Counts:
    """Characters, tags and what of them is in links, below each node that isn't left out."""

    def __init__(self, dom: Dom):
        self.dom, n = dom, len(dom.tag)
        tag, parent = dom.tag, dom.parent
        self.link = [False] * n
        for i in range(1, n):
            self.link[i] = tag[i] == "a" or self.link[parent[i]]
        self.own = [0] * n  # characters right in the node
        for node, text in dom.events:
            if text is not None:
                self.own[node] += len(" ".join(text.split()))
        self.weigh_marks()
        drop = self.drop
        self.chars = [0 if drop[i] else c for i, c in enumerate(self.own)]
        self.link_chars = [c if self.link[i] else 0 for i, c in enumerate(self.chars)]
        self.tags, self.link_tags = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            if not drop[i]:
                p = parent[i]
                self.chars[p] += self.chars[i]
                self.link_chars[p] += self.link_chars[i]
                self.tags[p] += self.tags[i] + 1
                self.link_tags[p] += self.link_tags[i] + (tag[i] == "a")
        self.body = next((i for i in range(n) if tag[i] == "body"), 0)

    def weigh_marks(self) -> None:
        """drop: what is left out, marked blocks that don't hold the article among it."""
        dom, n = self.dom, len(self.dom.tag)
        tag, parent, marks = dom.tag, dom.parent, dom.marks
        self.drop = list(dom.drop)
        if not marks:
            return
        under, heading = [0] * n, [False] * n  # the nearest mark, the node's own included
        inside: dict[int, int] = {0: 0}  # unlinked text, headings apart, whose nearest mark it is
        total, held = dict.fromkeys(marks, 0), {}  # that of all below; the marks right below
        within, article = [False] * n, False  # in an article element; one that no mark covers has text
        for i in range(1, n):
            heading[i] = heading[parent[i]] or tag[i] in HEADINGS
            under[i] = i if i in marks else under[parent[i]]
            within[i] = within[parent[i]] or tag[i] in ARTICLE
            article = article or within[i] and not under[i] and self.own[i] > 0 and not dom.drop[i]
            if self.own[i] and not (self.link[i] or heading[i] or dom.drop[i]):
                inside[under[i]] = inside.get(under[i], 0) + self.own[i]
        inside[0] += self.own[0]
        for i in sorted(marks, reverse=True):
            total[i] += inside.get(i, 0)
            above = under[parent[i]]
            held.setdefault(above, []).append(i)
            if above:
                total[above] += total[i]
        free, plain = inside[0], set()  # text that no mark covers; marks that don't count
        queue = [(-total[i], i) for i in held.get(0, ())]
        heapq.heapify(queue)
        while queue and -queue[0][0] >= SENTENCE:
            size, i = heapq.heappop(queue)
            if free < SENTENCE and not article or marks[i] == 1 and -size > free:
                plain.add(i)
                free += inside.get(i, 0)
                for k in held.get(i, ()):
                    heapq.heappush(queue, (-total[k], k))
        for i in range(1, n):
            self.drop[i] = self.drop[i] or self.drop[parent[i]] or i in marks and i not in plain

    def densities(self) -> list[float]:
        share = self.link_chars[self.body] / max(1, self.chars[self.body])
        out = []
        for c, lc, t, lt, dropped in zip(self.chars, self.link_chars, self.tags, self.link_tags, self.drop, strict=True):
            t = max(1, t)
            if not c or dropped:
                out.append(0.0)
                continue
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            inner = math.log(max(c / max(1, lc) * t / max(1, lt), 1.0))
            out.append(c / t * inner / (math.log(base) if base > 1.0 + 1e-9 else 1.0))
        return out


def chosen(counts: Counts) -> list[bool]:
    """The nodes whose text is the article's."""
    dom, drop, chars, dens = counts.dom, counts.drop, counts.chars, counts.densities()
    tag, parent, n = dom.tag, dom.parent, len(dom.tag)
    sums = [0.0] * n
    for i in range(1, n):
        sums[parent[i]] += dens[i]
    inside = [i for i in range(n) if not drop[i] and chars[i] and tag[i] not in INLINE]
    core = max(inside, key=lambda i: (sums[i] or dens[i], -i))
    path = [core]
    while path[-1]:
        path.append(parent[path[-1]])
    threshold = min((dens[i] for i in path if tag[i] not in ("html", "#")), default=0.0)
    own_text = [chars[i] - counts.link_chars[i] for i in range(n)]
    per_tag = lambda i: own_text[i] / max(1, counts.tags[i])
    on_path = set(path)

    def beside(i: int) -> bool:
        """A block next to the path that belongs to the article."""
        if drop[i] or not chars[i] or 2 * counts.link_chars[i] > chars[i]:
            return False
        return tag[i] in INLINE or tag[i] in PARAGRAPHS or dens[i] >= threshold or 2 * per_tag(i) >= per_tag(core)

    keep, heading, article = [False] * n, [False] * n, [False] * n  # heading: the block before is one
    before: dict[int, str] = {}
    for i in range(n):
        if i:
            article[i] = article[parent[i]] or tag[i] in ARTICLE
            heading[i] = before.get(parent[i]) in HEADINGS
            if tag[i] not in INLINE:
                before[parent[i]] = tag[i]
        if i in on_path:
            keep[i] = True
        elif parent[i] in on_path and parent[i] != core:
            keep[i] = beside(i)
        else:
            menu = tag[i] in LISTS and counts.link_tags[i] > 1 and own_text[i] == 0 and chars[i] > 0 and not (article[i] or heading[i])
            keep[i] = keep[parent[i]] and not drop[i] and not menu
    return keep


def extract(page: str | None) -> str:
    if not page:
        return ""
    counts = Counts(Dom(page))
    if not counts.chars[0]:
        return ""
    keep = chosen(counts)
    return " ".join("".join(" " if text is None else text for node, text in counts.dom.events if keep[node]).split())


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a row needs only itself."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return picked.mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
