"""Main text against a plain form of the density, wrappers, layouts and whole pages."""

from __future__ import annotations

import html
import math
import re
import time
from html.parser import HTMLParser

import pytest
from tessera.llm import html_text

SENTENCES = [f"Sentence {i} of the article, which tells what happened then and there." for i in range(8)]
BODY, TEXT = "".join(f"<p>{s}</p>" for s in SENTENCES), " ".join(SENTENCES)
REMARKS = "<p>A remark of a reader that goes on for a while, and for longer than the article.</p>" * 20


class Tree(HTMLParser):
    """A plain tree of a page whose elements are all closed."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = {"tag": "#", "kids": [], "text": [], "up": None}
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.at = {"tag": tag, "kids": [], "text": [], "up": self.at}
        self.at["up"]["kids"].append(self.at)

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["text"].append(data)


def brute_densities(page):
    """The density of every node in page order, each from a walk of its own."""
    root = Tree(page).root

    def walk(node, link=False):
        link = link or node["tag"] == "a"
        yield node, link
        for k in node["kids"]:
            yield from walk(k, link)

    everything = list(walk(root))

    def measures(node, link):
        below = list(walk(node, link))
        length = lambda x: sum(len(" ".join(t.split())) for t in x["text"])
        c, lc = sum(length(x) for x, _ in below), sum(length(x) for x, in_link in below if in_link)
        tags = [x["tag"] for x, _ in below][1:]
        return c, lc, len(tags), tags.count("a")

    of = {id(x): measures(x, node_link) for x, node_link in everything}
    body = next(x for x, _ in everything if x["tag"] == "body")
    cb, lcb = of[id(body)][:2]
    out = []
    for x, _ in everything:
        c, lc, t, lt = of[id(x)]
        one = lambda v: max(v, 1)
        base = math.log(c / one(c - lc) * lc + lcb / cb * c + math.e) if c else 1
        out.append(c / one(t) * math.log(max(1, c / one(lc) * one(t) / one(lt)), base) if c and base > 1 else c / one(t) * math.log(max(1, c / one(lc) * one(t) / one(lt))) if c else 0)
    return out


@pytest.mark.parametrize(
    "inner",
    [
        f"<div>{BODY}</div><div><a>Home</a><a>News</a></div>",
        f"<div><h1>Head</h1><div>{BODY}<p>See <a>this</a> and <b>that</b>.</p></div></div><ul><li><a>one</a></li><li>two</li></ul>",
        "<p>short</p>",
        "<div><div><div><p>deep <i>text</i> here</p></div></div></div><p></p>",
    ],
)
def test_density(inner):
    page = f"<html><body>{inner}</body></html>"
    got = html_text.Counts(html_text.Dom(page)).densities()
    assert got == pytest.approx(brute_densities(page))


WRAPPERS = (
    'class="widget Blog"|class="widget-content"|class="menu-closed"|class="nav-open page"|class="modal-open"|class="ads-enabled"|class="advert-free"|class="sponsored-post"|class="newsletter-issue"|'
    'class="sidebar-left"|class="sidebar-enabled"|class="layout-sidebar-left"|class="row sidebar-right-layout"|class="topbar-fixed"|class="toc-page"|class="overlay-container"|class="banner-story"|'
    'class="alert-fatigue"|class="cookie-recipe"|class="pager-item"|id="comment-on-policy"|id="ad-hoc-networks"|class="sidebar"|class="ad"'
).split("|")


@pytest.mark.parametrize("attrs", WRAPPERS)
def test_a_mark_never_empties_a_page(attrs):
    for before, head in (("", ""), ("<h1>Head</h1>", "Head "), ('<nav><a href=x>Home</a></nav><div class="ad">Buy now</div>', "")):
        assert html_text.extract(f"<html><body>{before}<div {attrs}>{BODY}</div><footer>x</footer></body></html>") == head + TEXT


LAYOUTS = [
    (f"<h1>Hd</h1><p>A lead.</p><div>{BODY}</div><p>The last one.</p>", f"Hd A lead. {TEXT} The last one."),
    (f"<div>{BODY}</div><div>{BODY}</div>", f"{TEXT} {TEXT}"),
    (f"<article>{BODY}</article><article>{BODY}</article>", f"{TEXT} {TEXT}"),
    (f"<div><h1>Hd</h1><div>{BODY}</div></div>", f"Hd {TEXT}"),
    (f"<article>{BODY}<h2>References</h2><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></article>", f"{TEXT} References One Two"),
    (f"<div>{BODY}<h2>References</h2><ol><li><a href=a>One</a></li><li><a href=b>Two</a></li></ol></div>", f"{TEXT} References One Two"),
    (f'<div>{BODY}</div><section class="discussion">{REMARKS}</section>', TEXT),
    (f'<article>{BODY}</article><div class="comments">{REMARKS}</div>', TEXT),
    (f'<div class="ad">{REMARKS}</div><article><p>A short one.</p></article>', "A short one."),
    (f"<div>{BODY}</div><div><a href=1>Home</a> <a href=2>About us</a></div>", TEXT),
    (f"<ul><li><a href=1>Home</a></li><li><a href=1>News</a></li></ul><div>{BODY}<ul><li><a href=1>Next</a></li><li><a href=1>Previous</a></li></ul></div>", TEXT),
]


@pytest.mark.parametrize(("inner", "want"), LAYOUTS)
def test_layouts(inner, want):
    assert html_text.extract(f"<html><body>{inner}</body></html>") == want


def test_deep_pages_take_linear_time():
    def took(depth):
        began = time.process_time()
        for start in ("<div>", "<p><button>" + "<div>", "<li>", '<div class="sidebar">', "<b>"):
            html_text.extract(start * depth + "x")
            html_text.extract(start * depth + "x" + "</i></p></section>" * depth)
        return time.process_time() - began

    took(500)
    assert took(16_000) < 10 * took(4_000) + 0.5


def brute_page(page):
    """The pages of the fixture hold their article in one element; the rest of the page is menus, adverts and the like."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"<(script|style|footer|nav|aside)\b.*?</\1>|<!--.*?-->|<div class=\"ad\">.*?</div>", " ", inner, flags=re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(b|a)\b[^>]*>", "", inner))).split())


def test_whole_query(spark):
    sf = "/root/testdata/sf0.01"
    got = html_text.op7_html_text(spark, sf).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], brute_page(pages[r["page_id"]]["html"]), len(r["text"]))


def test_rows(spark):
    rows = [(1, "u", f"<div>{BODY}</div>"), (1, "u", f"<div>{BODY}</div>"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_text.main_text(pages).collect()) == [(0, ""), (1, TEXT), (1, TEXT), (2, "")]
    assert html_text.main_text(pages.limit(0)).count() == 0
