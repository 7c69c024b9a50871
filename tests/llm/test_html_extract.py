import html
import itertools
import re

import numpy as np
import pytest

from rasterloom.llm import html_extract as H


@pytest.fixture(scope="module")
def model():
    return H.default_model()


def text(model, page):
    return model.texts([H.parse(page)])[0]


def test_messages_equal_enumeration(model):
    """Marginals and pair marginals of small trees, against the sum over all labellings."""
    for page in ("<article><h1>Title</h1><p>Some text here.</p></article>", "<nav><a>x</a></nav><div class=content><p>Hello you.<p>b</div>"):
        f = H.Forest.of([H.parse(page)])
        n = len(f.parent)
        unary, pair = f.unary @ model.unary, np.tensordot(f.edge, model.edge, 1)
        total, one, two = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(unary[i] * y[i] for i in range(n)) + sum(pair[i, y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
            total += w
            for i in range(n):
                one[i] += w * y[i]
                if f.parent[i] >= 0:
                    two[i, y[f.parent[i]], y[i]] += w
        marginal, joint = model.messages(f)
        assert np.allclose(marginal, one / total)
        inner = f.parent >= 0
        assert np.allclose(joint[inner], two[inner] / total)


def accuracy(model, pages):
    trees = [H.parse(p) for p in pages]
    f = H.Forest.of(trees)
    marginal, _ = model.messages(f)
    gold = np.concatenate([np.array(t.gold)[t.leaves] for t in trees])
    return ((np.concatenate([marginal[x] for x in f.leaves]) > 0.5) == gold).mean()


def test_held_out_pages(model):
    assert accuracy(model, H.labelled_pages(200, seed=1234)) > 0.99


def test_edges_decide(model):
    """A node's evidence is its own, so without the edges' potentials much is lost, whether they are taken away or never were."""
    pages = H.labelled_pages(150, seed=77)
    whole = accuracy(model, pages)
    bare = H.Model(model.unary, np.zeros_like(model.edge))
    alone = H.train(H.labelled_pages(150), steps=100, edges=False)
    assert not alone.edge.any() and whole > 0.99
    assert accuracy(bare, pages) < whole - 0.1 and accuracy(alone, pages) < whole - 0.1
    same = "<p>The very same words stand in both parts.</p>"
    assert text(model, f"<div class=sidebar><div>{same}</div></div><article><h1>A title</h1>{same}</article>") == "A title\nThe very same words stand in both parts."


#: Layouts that the generator doesn't write, with what is to come out.
LAYOUTS = {
    "<div id=page><div id=masthead><div><p>My site of many things</p></div></div><div class=wrap><div class=post-content><h2>On rivers</h2><p>Rivers run to the sea, and some take their time.</p><blockquote>A quoted line.</blockquote></div><div class=sidebar><h3>More</h3><ul><li><a href=/a>Another page</a></ul></div></div><div id=footer><p>All rights reserved.</p></div></div>": "On rivers\nRivers run to the sea, and some take their time.\nA quoted line.",
    "<main><section class=story><h1>Maps</h1><p>A map shows what is where.</p><div class=advertisement><div><p>Buy maps here, they are cheap today and only today.</p></div></div><p>It leaves out the rest.</p></section><section class=comments><ol><li><div><p>I like maps very much, thank you for this article.</p></div></li></ol></section></main>": "Maps\nA map shows what is where.\nIt leaves out the rest.",
    "<nav class=breadcrumbs><ol><li><a href=/>Home</a></li></ol></nav><article class=entry><header><p>By someone who knows</p><h1>Clouds</h1></header><ul><li>Some are white.</li><li>Some are grey.</li></ul><table><tr><td>height</td><td>2 km</td></tr></table></article><aside><section><h2>Popular</h2><p>What others read today on this site.</p></section></aside>": "By someone who knows\nClouds\nSome are white.\nSome are grey.\nheight\n2 km",
    "<div class=cookie-notice><div><div><p>This site keeps small files on your machine to know you again.</p></div></div></div><div role=main class=article-body><p>First words of the text, which goes on for a while.</p><p>Short.</p><p>Last words of the text, and then it stops.</p></div><form><fieldset><legend>Write to us</legend><p>We read all letters that reach us.</p></fieldset></form>": "First words of the text, which goes on for a while.\nShort.\nLast words of the text, and then it stops.",
}


@pytest.mark.parametrize("page", LAYOUTS)
def test_other_layouts(model, page):
    assert text(model, f"<html><body>{page}</body></html>") == LAYOUTS[page]


def test_a_mark_counts_wherever_it_stands():
    leaf = lambda t: H.parse(t).unary[-1][H.UNARY.index("mark")]
    assert leaf("words " * 300 + "© someone") == 1.0 and leaf("words " * 300) == 0.0


def test_parts_of_a_page(model):
    page = """<!doctype html><html><head><title>T</title><style>x</style></head><body><div id="cookie-banner">We use cookies to improve.</div>
    <header class="site"><h1>Site name</h1><nav><a href=a>A</a></nav></header><main><article><header><h1>Title here</h1></header>
    <p>Hello <i>big</i>
      world &lt;tag&gt; &amp;amp; x&nbsp;y.</p><script>var a = "<p>no</p>";</script><!-- <p>no</p> --><p>Second <b>one.<aside>Related: foo bar</aside><p>Third &eacute;</article>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>First! This is a great article and I love it very much.</p></div></section></main>
    <aside class="sidebar"><ul><li><a>x</a></ul></aside><form><label>Name</label><input><button>Send</button></form><footer>(c) 2020</footer></body></html>"""
    assert text(model, page) == "Title here\nHello big world <tag> &amp; x y.\nSecond one.\nThird é"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "</p></div>", "<!--", "<script>alert(1)", "&", "<a href='", "<p>" * 3000, "<div>" * 3000 + "x", "</b>" * 2000, "<table><tr><td>a<td>b<tr><td>c"])
def test_broken_pages(model, page):
    assert isinstance(text(model, page), str)


def test_stray_quotes_do_not_swallow_the_page(model):
    assert text(model, '<nav><a href="/"x">a</a><a href="/b"">b</a></nav><article><h1>A title</h1><p>Some words stand here.</p></article>') == "A title\nSome words stand here."


def test_edges(spark, empty, model):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<article><p>Words in an article.</p></article>", 1), (3, "u", "<article><p>" + "long words. " * 50000 + "</p></article>", 1), (3, "u", "<article><p>Words in an article.</p></article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in H.main_text(df, model).collect()]
    assert got[:2] == [(1, "", 0), (2, "", 0)] and got[2] == (None, "Words in an article.", 20) and got[4][1] == got[2][1]
    assert got[3][1] == ("long words. " * 50000).strip() and got[3][2] == 599999
    assert H.main_text(df.where("false"), model).collect() == []


def test_query(spark, sf):
    """The test pages have one layout, which a few patterns can read."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in H.op2_html_extract(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
