import html
import re
from itertools import product

import numpy as np
import pytest

from reckon.llm import dom
from reckon.llm import html_extract as H

PAGES = "page_id long, url string, html string"


def test_sum_product_like_all_labellings():
    """Marginals and the logarithm of the sum, against the sum over all labellings of small trees."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        for _ in range(8):
            parent = np.array([-1] + [int(rng.integers(-1, k)) for k in range(1, n)])
            depth = np.zeros(n, np.int64)
            for k in range(n):
                depth[k] = 0 if parent[k] < 0 else depth[parent[k]] + 1
            unary, edges, edge = rng.normal(0, 2, n), rng.normal(0, 2, (2, 2, 2)), rng.integers(0, 2, n)
            marginal, pairs, log_sum = H.sum_product(unary, edges, parent, edge, H.levels_of(depth))
            weight = {y: np.exp(sum(u * v for u, v in zip(unary, y)) + sum(edges[edge[k], y[parent[k]], y[k]] for k in range(n) if parent[k] >= 0)) for y in product((0, 1), repeat=n)}
            total = sum(weight.values())
            assert np.isclose(log_sum, np.log(total))
            for k in range(n):
                assert np.isclose(marginal[k], sum(w for y, w in weight.items() if y[k]) / total)
                if parent[k] >= 0:
                    for a, b in product((0, 1), repeat=2):
                        assert np.isclose(pairs[k, a, b], sum(w for y, w in weight.items() if y[parent[k]] == a and y[k] == b) / total)


def blocks(source):
    p = dom.read(source)
    out = []
    for text, new in zip(p.texts, p.breaks):
        if new or not out:
            out.append("")
        out[-1] += text
    return [" ".join(b.split()) for b in out]


@pytest.mark.parametrize("source, want", [
    ("<p>a<b>b</b> c<p>d", ["ab c", "d"]),
    ("a<br>b<div>c</div>d", ["a b", "c", "d"]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<p>x &amp; y &lt;b&gt; &am &ampz &#65;&nbsp;q", ["x & y <b> &am &z A q"]),
    ("a<!-- x > y -->b<!-->c<script>var t='</p>';</script>d<style>p{}</style>e<title>t</title>", ["abcde"]),
    ("1 < 2 and <3 <p title='a>b'>c", ["1 < 2 and <3", "c"]),
    ("<p class=\"x>a</p><p>b", ["a", "b"]),
    ("a<p>b</p", ["a", "b"]),
    ("<b><p>a</b>b</p></i></div>c", ["ab", "c"]),
    ("<p>a <i>b</i> <i>c</i></p>", ["a b c"]),
    ("<SCRIPT>x</SCRIPT ><P>A</P>\x00", ["A", "\x00"]),
    ("", []),
    ("<textarea>x</textarea><noscript>y</noscript>z", ["y", "z"]),
    ("<div>a<span class=ad>b</span>c</div>", ["abc"]),
])
def test_read(source, want):
    assert blocks(source) == want


def test_marks_and_groups():
    p = dom.read('<div class="mainMenu side-bar" hidden><a role="navigation" data-main="1">x</a></div>')
    menu, side = (1 << list(dom.GROUPS).index(g) for g in ("menu", "side"))
    assert p.groups[1] & menu and p.groups[1] & side and p.groups[1] & dom.HIDDEN
    assert p.groups[2] & menu and p.marks[2] == 1


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_held_out_pages(model):
    """Pages of seeds that training hasn't seen: texts right, and most pages wholly right."""
    pages = [dom.read(p) for p in H.labelled_pages(300, seed=77)]
    f, start = H.forest(pages)
    y = H.labels_of(pages, f.parent, f.levels) > 0
    got = H.sum_product(f.features @ model.weights, model.edges, f.parent, f.edge, f.levels)[0] >= 0.5
    text = f.edge == 1
    assert (got == y)[text].mean() > 0.985
    assert np.mean([(got == y)[a:b][text[a:b]].all() for a, b in zip(start, start[1:])]) > 0.88
    assert not (got & ~got[f.parent] & (f.parent >= 0)).any()  # what is main lies in what is main


HAND = [
    ("<body><h1>Main page</h1><p>Hello there, this is text.<p>Another paragraph of text follows.<hr><address>me@example.com</address></body>", "Main page Hello there, this is text. Another paragraph of text follows."),
    ("<html><body><div><ul><li><a href=a>a</a><li><a href=b>b</a></ul></div><div><p>Only a division, without any class. It has some text.</p><p>Two paragraphs, in fact.</p></div><div>&copy; 2020 <a href=x>Contact</a></div></body></html>", "Only a division, without any class. It has some text. Two paragraphs, in fact."),
    ("<body><nav>x</nav><div class='notice'>Down tonight for maintenance.</div><article><h1>T</h1><p>short.</p><aside class='ad'>An advert that is longer than the article is. And more.</aside><figure><img><figcaption>Caption.</figcaption></figure></article><div class='comments'><article class='comment'><p>A reader says a lot of things here, more than the article.</p></article></div><footer>© me and all my friends, in many places.</footer></body>", "T short. Caption."),
    ("<body><div class='cookie-banner' role='dialog'><p>We use cookies. By continuing you accept that.</p><button>Accept</button></div><header><h1>Daily News</h1><nav><a>Home</a> <a>World</a></nav></header><div class='container'><div class='main'><h1>Headline</h1><p>Text one is here. It has sentences, too.</p><div class='advertisement'><p>Buy the best shoes today! Only now.</p></div><p>Text two &amp; more.</p></div><aside class='sidebar'><h3>Popular</h3><p>Some teaser text that is fairly long.</p></aside></div><form class='newsletter'><p>Sign up today.</p><button>Go</button></form><footer><p>Copyright. All rights reserved.</p></footer></body>", "Headline Text one is here. It has sentences, too. Text two & more."),
]


@pytest.mark.parametrize("source, want", HAND)
def test_pages_by_hand(model, source, want):
    assert H.main_texts([source], model) == [want]


def plain(source):
    """The article of a page of the driver's layout."""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", source, re.S)[1])).split())


def test_query(spark):
    d = "/root/testdata/sf0.01"
    want = {r.page_id: (r.url, plain(r.html), len(plain(r.html))) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = H.query(spark, d)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got.collect()} == want


def test_odd_rows_and_clashing_names(spark, model):
    long_ = "<article><h1>T</h1>" + "<p>word, and word again.</p>" * 40_000 + "</article>"
    deep = "<div>" * 3000 + "<p>Deep text is here, in the middle. It goes on.</p>" + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no markup at all, just a text. It has two sentences."), (4, "u", long_), (5, "u", deep), (5, "u", deep), (None, "u", HAND[0][0]), (6, "u", "<nav>a</nav>"), (7, "u", "<" * 50_000), (8, "u", '<a "' * 20_000)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], PAGES + ", text string, n_chars int")
    got = H.extract(df, model)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    found = sorted(((r.page_id or 0, r.text) for r in got.collect()))
    assert [f[0] for f in found] == [0, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    by = dict(found)
    assert by[0] == HAND[0][1] and by[1] == by[2] == by[6] == "" and by[4] == "T " + " ".join(["word, and word again."] * 40_000) and found[5] == found[6]
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_empty(spark, model):
    assert H.extract(spark.createDataFrame([], PAGES), model).collect() == []
