"""Main text of pages: against a plain parser on the given layout, on held-out labelled pages, and on pages written by hand."""

import os
from html.parser import HTMLParser

import numpy as np
import pytest

from lectern.llm import extract

PAGES = "page_id long, url string, html string, text string, n_chars int, n_blocks string"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tree():
    return extract.trained()


def kept(tree, page):
    found = extract.blocks(page)
    return [b[0] for b, k in zip(found, tree.predict(extract.features(found))) if k]


def test_blocks():
    page = (
        '<html><head><title>T</title><style>p{a:"<p>"}</style></head><body><!-- <p>no</p> --><p>one <b>t</b>wo&nbsp;&amp;\n three &lt;p&gt; <a href="x>y">li nk</a><br>four<p>five'
        "<script>var t=\"</p>\";</script> a < b <ul><li>six<li><a href=q>seven</a></ul><table><tr><td>8<td>9</table><h2>ten</h2> tail&amp <button>Go</button><textarea><p>x</textarea> end <p class='cut"
    )
    found = extract.blocks(page)
    assert [b[0] for b in found] == ["one two & three <p> li nk four", "five a < b", "six", "seven", "8", "9", "ten", "tail& end"]
    assert found[0][1] == 8 and found[0][2] == pytest.approx(4 / 23) and found[3][2] == 1
    assert [b[4] for b in found] == [False] * 6 + [True, False] and [b[5] for b in found] == [False, False, True, True, *[False] * 4]
    assert extract.blocks("") == [] and extract.blocks("<p>") == [] and extract.blocks("just text")[0][0] == "just text"


def test_blocks_of_odd_markup():
    assert [b[0] for b in extract.blocks("</div></p>a<b>b</i>c<p>d</p></b>e")] == ["abc", "d", "e"]
    assert [b[0] for b in extract.blocks("<p title='it''s'>x</p><p class=don't>y</p><![CDATA[z]]><?php a ?>")] == ["x", "y"]
    assert [b[0] for b in extract.blocks("a<script>b")] == ["a"] and [b[0] for b in extract.blocks("a<!-- b")] == ["a"]
    deep = extract.blocks("<div><b>" * 20_000 + "deep" + "</i>" * 20_000)
    assert [b[0] for b in deep] == ["deep"]
    assert extract.blocks("<a href=1>one <a href=2>two</a> three")[0][2] == pytest.approx(6 / 11)


def test_tree_finds_a_conjunction():
    r = np.random.default_rng(0)
    x = r.random((400, 3)).astype(np.float32)
    y = (x[:, 0] > 0.4) & (x[:, 2] <= 0.7)
    t = extract.Tree().fit(x, y)
    assert (t.predict(x) == y).mean() > 0.99
    assert extract.Tree().fit(x, np.ones(400, bool)).predict(x).all()


def test_held_out_pages(tree):
    right = total = 0
    for page, labels in extract.labelled(200, seed=1234):
        found = extract.blocks(page)
        assert len(found) == len(labels)
        right += int((tree.predict(extract.features(found)) == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.99


A, B, C = "A first paragraph of some words, with a stop at its end.", "Short one.", "Another paragraph follows here, and it says a little more than the others do, for a while."
HANDMADE = {
    "elements": (f"<nav><a href=1>Home</a></nav><header><h1>Site</h1></header><main><article><h1>Title</h1><p>{A}</p><aside>Buy this</aside><p>{B}</p><ul><li>item</ul></article></main><footer>(c) me</footer>", ["Title", A, B, "item"]),
    "classes": (f'<div class="topMenu"><a>x</a> <a>y</a></div><div id="cookieConsent">We use cookies on this site to make it work for you.</div><div class="entry-content"><h2>Title</h2><p>{A}<div class="share-buttons">Share this</div><p>{B}</div><div class="sidebar-left"><h3>More</h3><p>{C}</p></div>', ["Title", A, B]),
    "comments in the article": (f'<article><p>{A}</p><section id="comments"><h3>2 comments</h3><article class="comment"><div class="content"><p>{C}</p></div></article></section></article>', [A]),
    "article unnamed": (f'<div class="nav"><li><a href=1>one</a><li><a href=2>two</a></div><div><h1>Title of it</h1><p>{C}</p><p>{A}</p><p>{C}</p></div><div id="footer">All rights reserved by us.</div>', ["Title of it", C, A, C]),
    "nothing named": (f"<ul><li><a href=1>one</a><li><a href=2>two</a></ul><h1>Title of it</h1><p>{C}</p><p>{A} {C}</p><p>{C} {A}</p><div><a>About</a> | <a>Imprint</a></div>", ["Title of it", C, f"{A} {C}", f"{C} {A}"]),
    "links inside": (f'<article><p>{A}</p><p><a href="x">Only a link.</a></p><p>{B}</p></article>', [A, "Only a link.", B]),
    "form around": (f'<form id="aspnetForm"><div class="menu"><a>x</a></div><main><p>{A}</p><label>Name</label><p>{B}</p></main><label>Search <input></label></form>', [A, "Name", B]),
    "unnamed beside a named one": (f"<div>{A}</div><article><p>{C}</p></article><div>{B}</div>", [C]),
    "cut off": (f"<nav><a>x</a></nav><article><p>{A}</p><p>{B} and then", [A, f"{B} and then"]),
    "header of the article": (f"<header><p>Site</p></header><article><header><h1>Title</h1></header><p>{A}</p></article>", ["Title", A]),
    "no article": ("<nav><a>x</a></nav><footer>me</footer>", []),
}


@pytest.mark.parametrize("name", HANDMADE)
def test_pages_by_hand(tree, name):
    page, want = HANDMADE[name]
    assert kept(tree, f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}") == want


class Article(HTMLParser):
    """The blocks of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.found = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.found.append("")
        elif tag == "br":
            self.found[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.found.append("")

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {}
    for row in pages.collect():
        parser = Article()
        parser.feed(row.html)
        parser.close()
        want[row.page_id] = "\n".join(x for x in (" ".join(b.split()) for b in parser.found) if x)
    got = extract.main_text(pages).collect()
    assert {x.page_id: x.text for x in got} == want and all(x.n_chars == len(x.text) for x in got)


def test_odd_rows(spark):
    long = "<article>" + f"<p>{A}</p>" * 30_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", f"<article><p>{A}"), (3, "u", long), (3, "u", long), (4, "u", "\0 <p>")]
    got = extract.main_text(spark.createDataFrame([(*x, "t", 1, "b") for x in rows], PAGES)).collect()
    assert sorted((repr(x.page_id), repr(x.url), x.n_chars, x.n_kept) for x in got) == sorted([("1", "'u'", 0, 0), ("2", "None", 0, 0), ("None", "'u'", len(A), 1), *[("3", "'u'", 30_000 * (len(A) + 1) - 1, 30_000)] * 2, ("4", "'u'", 0, 0)])
    assert extract.main_text(spark.createDataFrame([], PAGES)).count() == 0
