"""Main text of pages by a tree-structured graphical model.

Every page becomes a tree of its blocks (:mod:`reckon.llm.dom`). A node is *main* if any text of the article lies in it, so a
main node has main ancestors only. Each node has a weight of its own, from its tag, the words in its class, id and role, and
the text, links and punctuation below it; each edge from parent to child has a potential for the four combinations of their
labels. The tree has no cycles, so two passes of sum-product messages, leaves to root and root to leaves, give exact marginals;
a text run is kept if its marginal is one half or more. Nodes of many pages are worked on together, depth by depth.

The weights are learnt on labelled pages: HTML in which the attribute ``data-main`` says for an element and what is in it
whether it belongs to the article (1) or not (0; the default). The gradient of the likelihood needs the same two passes. No
table has labels, so the query learns on ``PAGES`` pages that :func:`labelled_pages` makes by rule: common layouts in random
combinations (article, main, plain divisions, tables, text straight in the body; menus, headers, footers, side bars, adverts,
notices, forms, comments, related links, share bars) with invented words of several scripts. Other labelled pages can be
given to :func:`learn`. The model is a few hundred numbers; scoring is one pass over all pages without any exchange.

Defined results: a null or empty page, or one without main text, has the empty text. Character references are decoded once,
as HTML says (a missing semicolon is accepted where HTML does); white space is what Unicode calls so, line breaks count as
such; blocks are joined by one blank. Scripts, styles, titles, templates, frames and text fields never have text. Very long
and very deep pages are read whole; a page that is cut off is read as far as it goes. Repeated rows each get their row,
empty tables work. Columns are picked by name; ``text`` and ``n_chars`` replace columns of these names, all others stay.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.llm import common as C
from reckon.llm import dom

#: Labelled pages that the query learns on, passes over them, and the penalty of large weights.
PAGES, ROUNDS, STEP, PENALTY = 600, 200, 0.25, 0.05
#: The potential of a main node below one that is not: by what main means there is none.
NEVER = -40.0
#: Html that is worked on at once.
SLICE_CHARS = 1 << 21
TAG_KINDS = (
    "#page html body", "article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl menu dir", "li dt dd", "table tbody thead tfoot tr", "td th caption", "nav", "header", "footer", "aside", "form fieldset legend",
    "button select label output option optgroup datalist search", "blockquote pre", "figure figcaption", "address", "noscript", "#text", "details summary dialog",
)
KIND_OF = {t: k for k, tags in enumerate(TAG_KINDS) for t in tags.split()}
MARKS = re.compile(r"[.,;:!?。，、؟।]")
ENDS = re.compile(r"[.!?。؟।]['\")\]»”’]*\s*$")
#: What each node's text is measured by: limits of plain (unlinked) characters, of linked shares and of shares of the page.
PLAIN, LINKED, SHARE = (1, 25, 80, 200, 1000), (0.2, 0.5, 0.9), (0.02, 0.1, 0.3)
N_FEATURES = len(TAG_KINDS) + 1 + len(dom.GROUPS) + 1 + len(PLAIN) + len(LINKED) + len(SHARE) + 4 + 1


@dataclass
class Forest:
    """Trees side by side: ``parent`` (-1 for roots), nodes of each depth from the roots down, a row of features each, and
    which potential its edge to the parent has."""

    parent: np.ndarray
    levels: list[np.ndarray]
    features: np.ndarray
    edge: np.ndarray


def levels_of(depth: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth, from the roots down."""
    return np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def below(values: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Sums over whole subtrees."""
    out = values.astype(float)
    for at in levels[:0:-1]:
        np.add.at(out, parent[at], out[at])
    return out


def forest(pages: list[dom.Page]) -> tuple[Forest, np.ndarray]:
    """The trees of pages with their features, and where each page's nodes begin."""
    sizes = np.array([len(p.tags) for p in pages], np.int64)
    start = np.concatenate(([0], np.cumsum(sizes)))
    parent = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + s) for p, s in zip(pages, start)]) if len(pages) else np.zeros(0, np.int64)
    n, levels = len(parent), levels_of(np.array([d for p in pages for d in p.depths], np.int64))
    tags = [t for p in pages for t in p.tags]
    kind = np.array([KIND_OF.get(t, len(TAG_KINDS)) for t in tags], np.int64)
    groups = np.array([g for p in pages for g in p.groups], np.int64)
    own = np.zeros((n, 6))  # characters, linked ones, marks, runs that end like a sentence, runs, paragraphs
    own[:, 5] = np.array([t == "p" for t in tags], float) if n else 0
    for p, s in zip(pages, start):
        runs: dict[int, str] = {}
        for node, text, linked in zip(p.piece_nodes, p.texts, p.linked):
            size = len(text) - text.count(" ")
            own[s + node, 0] += size
            own[s + node, 1] += size * linked
            runs[node] = text if node not in runs else runs[node] + text
        for node, text in runs.items():
            own[s + node, 2:5] = len(MARKS.findall(text)), ENDS.search(text) is not None, 1
    whole = below(own, parent, levels)
    size, linked, marks, ended, runs, paragraphs = whole.T
    page_of = np.repeat(start[:-1], sizes)
    share = size / np.maximum(size[page_of], 1) if n else size
    plain, part = size - linked, linked / np.maximum(size, 1)
    bits = [(groups >> k) & 1 for k in range(len(dom.GROUPS) + 1)]
    rows = [*np.eye(len(TAG_KINDS) + 1)[kind].T, *bits, *[plain >= x for x in PLAIN], *[part >= x for x in LINKED], *[share >= x for x in SHARE], marks * 40 >= np.maximum(size, 1), ended * 2 >= np.maximum(runs, 1), paragraphs >= 2, size == 0, np.ones(n)]
    return Forest(parent, levels, np.array(rows, float).T.reshape(n, N_FEATURES), (kind == KIND_OF["#text"]).astype(np.int64)), start


@dataclass
class Model:
    """Weights of features, and potentials by kind of edge, parent's label and child's label."""

    weights: np.ndarray
    edges: np.ndarray


def sum_product(unary: np.ndarray, edges: np.ndarray, parent: np.ndarray, edge: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of label 1, of the four combinations at each edge (rows of roots are zero), and the logarithm of the sum over
    all labellings. ``unary``: the weight of label 1 against label 0."""
    n = len(unary)
    inside, message, base = unary.copy(), np.zeros(n), 0.0  # inside: log odds of a node by what is below it
    for at in levels[:0:-1]:
        e, s = edges[edge[at]], inside[at]
        zero, one = np.logaddexp(e[:, 0, 0], e[:, 0, 1] + s), np.logaddexp(e[:, 1, 0], e[:, 1, 1] + s)
        message[at] = one - zero
        base += zero.sum()
        np.add.at(inside, parent[at], message[at])
    if levels:
        base += np.logaddexp(0, inside[levels[0]]).sum()
    belief, pairs = inside.copy(), np.zeros((n, 2, 2))
    for at in levels[1:]:
        e, s, rest = edges[edge[at]], inside[at], belief[parent[at]] - message[at]  # rest: the parent without this child
        joint = np.stack([np.stack([e[:, 0, 0], e[:, 0, 1] + s], 1), np.stack([e[:, 1, 0] + rest, e[:, 1, 1] + rest + s], 1)], 1)
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        pairs[at] = joint / joint.sum((1, 2), keepdims=True)
        belief[at] = s + np.logaddexp(e[:, 0, 1], e[:, 1, 1] + rest) - np.logaddexp(e[:, 0, 0], e[:, 1, 0] + rest)
    return 1 / (1 + np.exp(-np.clip(belief, -700, 700))), pairs, base


def labels_of(pages: list[dom.Page], parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Labels of the nodes of labelled pages: text by the nearest mark above it, other nodes by the text in them."""
    marks = [m for p in pages for m in p.marks]
    mark = np.array([-1 if m is None else m for m in marks])
    for at in levels[1:]:
        mark[at] = np.where(mark[at] < 0, mark[parent[at]], mark[at])
    text = np.array([t == "#text" for p in pages for t in p.tags])
    return (below((text & (mark == 1)).astype(float), parent, levels) > 0).astype(float)


def learn(pages: list[str], rounds: int = ROUNDS) -> Model:
    """A model from labelled pages, by ascent of the penalised likelihood."""
    trees = [dom.read(p) for p in pages]
    f, _ = forest(trees)
    y = labels_of(trees, f.parent, f.levels)
    kinds, kind = np.unique(f.features, axis=0, return_inverse=True)  # many nodes look alike
    inner = f.parent >= 0
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (f.edge[inner], y[f.parent[inner]].astype(int), y[inner].astype(int)), 1)
    model = Model(np.zeros(N_FEATURES), np.zeros((2, 2, 2)))
    model.edges[:, 0, 1] = NEVER
    first, second = np.zeros(N_FEATURES + 8), np.zeros(N_FEATURES + 8)
    for k in range(1, rounds + 1):
        p, pairs, _ = sum_product((kinds @ model.weights)[kind], model.edges, f.parent, f.edge, f.levels)
        expected = np.array([pairs[inner & (f.edge == e)].sum(0) for e in (0, 1)])
        slope = np.concatenate((np.bincount(kind, y - p) @ kinds - PENALTY * model.weights, (seen - expected - PENALTY * model.edges).ravel())) / max(1, len(pages))
        slope[N_FEATURES + 1 :: 4] = 0  # a structural zero isn't learnt
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        step = STEP * first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        model.weights += step[:N_FEATURES]
        model.edges += step[N_FEATURES:].reshape(2, 2, 2)
    return model


def main_texts(sources: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    pages = [dom.read(s) for s in sources]
    f, start = forest(pages)
    keep = sum_product(f.features @ model.weights, model.edges, f.parent, f.edge, f.levels)[0] >= 0.5
    out = []
    for p, s in zip(pages, start):
        blocks: list[list[str]] = []
        broken = True
        for node, text, breaks in zip(p.piece_nodes, p.texts, p.breaks):
            broken |= breaks
            if keep[s + node]:
                if broken:
                    blocks.append([])
                    broken = False
                blocks[-1].append(text)
        out.append(" ".join(t for b in blocks if (t := " ".join("".join(b).split()))))
    return out


def extract(df: DataFrame, model: Model, html_column: str = "html") -> DataFrame:
    """The rows of ``df`` with text and n_chars (code points)."""
    text, size = C.unused(df.columns, "__text", "__size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = [s or "" for s in batch[html_column].to_pylist()]
            lengths = np.concatenate(([0], np.cumsum([len(s) for s in sources])))
            texts: list[str] = []
            for i, j in C.slices(lengths, SLICE_CHARS):
                texts += main_texts(sources[i:j], model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, text, size])

    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType()), T.StructField(size, T.LongType())])
    out = df.mapInArrow(run, schema)
    return out.select(*[F.col(f"`{c}`") for c in C.others(df, "text", "n_chars")], F.col(text).alias("text"), F.col(size).alias("n_chars"))


# ---- labelled pages --------------------------------------------------------------------------------------------------

SYLLABLES = (
    "ba ten ri so lu mi ka ver tion ing er an de la", "der ein ung sch ver ich lich keit bau gen", "что ко ри ме ста ни во лен ская про", "νο τη σα με ρα λο κα πε", "ção la que dos re men te ñar ío és",
    "日 本 の 文 字 で 書 い た 長",
)


class Maker:
    """Pages made by rule: the same seed makes the same page."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts = self.r.choice(SYLLABLES).split()

    def word(self) -> str:
        return "".join(self.r.choice(self.parts) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        odd = self.r.random() < 0.1  # texts full of signs
        return " ".join((self.words(1, 8) + self.r.choice(["", ", " + self.words(2, 8)]) + self.r.choice([" &amp;&amp; *** %%%", " #"]) * odd + self.r.choice("...?!")).capitalize() for _ in range(self.r.randint(low, high)))

    def some(self, *made, odds: float = 0.5) -> str:
        return "".join(m() for m in made if self.r.random() < odds)

    def name(self, *names: str) -> str:
        n = self.r.choice(names)
        n = n + self.r.choice(["", "", "-" + self.word()[:4], str(self.r.randint(1, 9))]) if n.isascii() else n
        return self.r.choice([f' class="{n}"', f' id="{n}"', f" class='{self.r.choice(['col', 'box', 'block', 'row'])} {n}'"])

    def tag(self, tags: str, names: tuple[str, ...] = (), plain: float = 0.2) -> tuple[str, str]:
        tag = self.r.choice(tags.split())
        named = tag not in ("nav", "footer", "aside", "header", "form", "article", "main", "noscript") or self.r.random() > 0.5
        return f"<{tag}{self.name(*names) if names and (named or self.r.random() > plain) else ''}>", f"</{tag}>"

    def wrap(self, inside: str, tags: str, *names: str) -> str:
        a, z = self.tag(tags, names)
        return f"{a}{inside}{z}"

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def links(self, low: int, high: int, n: int = 6) -> str:
        made = [self.link(low, high) for _ in range(self.r.randint(2, n))]
        return self.r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>", "<ul>" + "".join(f"<li>{x}" for x in made) + "</ul>", " | ".join(made), "".join(f"<div>{x}</div>" for x in made)])

    # what is no article
    def menu(self) -> str:
        return self.wrap(self.links(1, 3), "nav nav div ul", "nav", "menu", "navbar", "main-menu", "navigation", "breadcrumbs", "topnav")

    def head(self) -> str:
        return self.wrap(f"<{(h := self.r.choice(['h1', 'h2', 'div', 'p']))}>{self.r.choice([self.link, lambda: self.words(1, 6)])()}</{h}>" + self.some(lambda: f"<p>{self.sentences(1, 1)}</p>", self.menu, self.search), "header header div", "header", "masthead", "site-header", "banner", "topbar")

    def foot(self) -> str:
        inside = self.some(lambda: "&copy; " + self.words(1, 4) + " &middot; " + self.sentences(1, 2), lambda: f"<p>{self.sentences(1, 4)}</p>", lambda: self.links(1, 3), self.menu, odds=0.6)
        return self.wrap(inside or f"&copy; {self.words(2, 5)}", "footer footer div", "footer", "site-footer", "colophon", "copyright", "bottom")

    def side(self) -> str:
        inside = self.some(lambda: f"<h3>{self.words(1, 4)}</h3>" + self.links(2, 7), lambda: f"<p>{self.sentences(1, 5)}</p>", self.advert, lambda: f"<div class='widget'><h4>{self.words(1, 3)}</h4><p>{self.sentences(1, 3)}</p></div>", odds=0.6)
        return self.wrap(inside or self.links(2, 6), "aside aside div", "sidebar", "side", "widget-area", "right-rail", "secondary sidebar")

    def advert(self) -> str:
        return self.wrap(self.r.choice([lambda: self.sentences(1, 3), lambda: f"<p>{self.sentences(1, 4)}</p>", lambda: self.link(2, 6), lambda: f"<p>{self.words(2, 6)}</p>{self.link()}"])(), "div div div aside ins section", "ad", "ads", "advert", "advertisement", "ad-box", "adsbygoogle", "sponsored", "banner-ad", "promo")

    def notice(self) -> str:
        role = self.r.choice(["", ' role="alert"', ' role="dialog"', ' style="display:none"', " hidden"])
        if self.r.random() < 0.25:
            return f"<noscript>{self.sentences(1, 2)}</noscript>"
        a, z = self.tag("div section aside", ("cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "paywall", "notification"))
        return f"{a[:-1]}{role}><p>{self.sentences(1, 4)}</p>{self.some(self.button)}{z}"

    def address(self) -> str:
        return f"<address>{self.words(1, 6)}</address>"

    def button(self) -> str:
        return f"<button>{self.words(1, 3)}</button>"

    def search(self) -> str:
        return f'<form action="/s"{self.r.choice(["", " class=search"])}><label>{self.words(1, 3)}</label><input type="text"> {self.button()}</form>'

    def form(self) -> str:
        return self.wrap(f"<p>{self.sentences(1, 2)}</p><label>{self.words(1, 3)}</label><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><textarea>{self.words(1, 9)}</textarea>{self.button()}", "form form form div", "newsletter", "subscribe", "login", "contact-form", "signup")

    def comments(self) -> str:
        say = lambda: self.r.choice([f"<p>{self.sentences(1, 6)}</p>", f"<p><b>{self.word()}</b>: {self.sentences(1, 4)}</p>", f"<span class='author'>{self.word()}</span> <div class='body'>{self.sentences(1, 6)}</div>"])
        made = ""
        for _ in range(self.r.randint(1, 6)):
            tag = self.r.choice(["div", "article", "section", "li"])
            made += f"<{tag}{self.r.choice(['', self.name('comment', 'comment-body', 'reply')])}>{say()}</{tag}>"
        return self.wrap(f"<h{(h := self.r.randint(2, 4))}>{self.words(1, 3)}</h{h}>{made}{self.some(self.form)}", "section section div div aside ol", "comments", "comment-list", "comments-area", "discussion", "user-comments", "replies", "respond")

    def related(self) -> str:
        return self.wrap(f"<h3>{self.words(1, 4)}</h3>" + self.r.choice([lambda: self.links(3, 9), lambda: "".join(f"<div><h4>{self.link(3, 8)}</h4><p>{self.sentences(1, 1)}</p></div>" for _ in range(self.r.randint(2, 4)))])(), "div section aside", "related", "related-posts", "recommended", "more-stories", "popular", "teasers")

    def share(self) -> str:
        return self.wrap(self.r.choice([lambda: self.links(1, 2, 5), lambda: self.words(1, 3) + self.button() * 3])(), "div ul", "share", "social", "share-buttons", "social-links", "toolbar")

    # what is
    def byline(self) -> str:
        return self.wrap(self.words(1, 3) + " " + self.link(), "div p span", "byline", "meta", "entry-meta", "post-info", "date").replace(">", ' data-main="0">', 1)

    def paragraph(self) -> str:
        text = self.sentences(1, self.r.choice([1, 1, 2, 4, 12]))
        if self.r.random() < 0.3:
            text += f" {self.link(1, 4)} {self.sentences(1, 2)}"
        return self.r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>", f"<p>{text} <em>{self.words(1, 3)}</em>, {self.words(1, 4)}.</p>"])

    def extra(self) -> str:
        return self.r.choice([
            lambda: f"<h{(h := self.r.randint(2, 4))}>{self.words(1, 6)}</h{h}>" + self.paragraph(), lambda: "<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>",
            lambda: "<ol>" + "".join(f"<li>{self.words(1, 6)}" for _ in range(self.r.randint(2, 6))) + "</ol>", lambda: f"<blockquote>{self.paragraph()}</blockquote>", lambda: f"<figure><img src='x'><figcaption>{self.sentences(1, 1)}</figcaption></figure>",
            lambda: "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 2)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 5))) + "</table>", lambda: f"<pre>{self.words(5, 30)}</pre>",
            lambda: f"<section>{self.paragraph()}{self.paragraph()}</section>",
        ])()

    def foreign(self) -> str:
        """What stands in an article and is none of it."""
        return self.r.choice([self.advert, self.advert, self.share, self.related, self.form, self.notice, self.side])().replace(">", ' data-main="0">', 1)

    def article(self, mixed: bool = True) -> str:
        many = self.r.choice([1, 1, 1, 2, 4, 9])
        made = [self.paragraph() for _ in range(many)] + [self.extra() for _ in range(self.r.choice([0, 0, 1, 2]))] + [self.foreign() for _ in range(self.r.choice([0, 0, 1, 2]) * mixed)]
        self.r.shuffle(made)
        title = self.r.choice([f"<h1>{self.words(2, 9)}</h1>", f"<h1>{self.words(2, 9)}</h1>", f"<h2>{self.words(2, 9)}</h2>", "", f"<header><h1>{self.words(2, 9)}</h1>{self.byline()}</header>", f"<h1>{self.words(2, 9)}</h1>{self.byline()}"])
        return title + (made[0] if many < 2 and not title else "") + "".join(made if many > 1 or title else made[1:])

    def holder(self, inside: str) -> str:
        """The article in an element of its own, or in several."""
        text = self.r.random() < 0.1
        tag, names = self.r.choice([
            ("article", ()), ("article", ()), ("article", ("post", "entry", "story")), ("main", ()), ("main", ("content",)), ("div", ("content", "article", "post-content", "entry-content", "story-body", "main-content", "main", "post", "articleBody")), ("div", ("content", "article", "post-body", "entry")),
            ("section", ("content", "article")), ("td", ("content",)), ("div", ()),
        ])
        a = f"<{tag}{self.name(*names) if names else ''} data-main=\"1\">"
        if text:
            inside = "<br><br>".join(self.sentences(1, 6) for _ in range(self.r.randint(2, 5)))
        made = f"{a}{inside}</{tag}>"
        if tag == "td":
            return f"<table><tr><td>{self.links(1, 3)}</td>{made}<td>{self.advert()}</td></tr></table>"
        for _ in range(self.r.choice([0, 0, 1, 2])):
            made = self.wrap(self.some(self.menu, self.advert, odds=0.15) + made + self.some(self.comments, self.related, self.share, odds=0.2), "div div main section", "wrapper", "container", "page", "main", "col-8")
        return made

    def page(self) -> str:
        if self.r.random() < 0.25:  # a small article among landmarks that can have more text
            few = f"<{(h := self.r.choice(['h1', 'h2']))}>{self.words(1, 8)}</{h}>" + "".join(f"<p>{self.sentences(1, 1)}</p>" for _ in range(self.r.choice([1, 1, 2])))
            tag = self.r.choice(["article", "article", "main", "div class=content", "div"])
            before = self.some(lambda: f"<header>{self.sentences(1, 2)}</header>", lambda: f"<nav>{self.words(1, 6)}</nav>", self.menu, self.advert, self.notice)
            after = self.some(lambda: f"<aside><p>{self.sentences(1, 4)}</p></aside>", self.comments, self.advert, lambda: f"<form><p>{self.sentences(1, 2)}</p></form>", odds=0.3) + self.some(lambda: f"<footer>{self.sentences(1, 4)}</footer>", self.foot, odds=0.6)
            return f'<html><body>{before}<{tag} data-main="1">{few}</{tag.split()[0]}>{after}</body></html>'
        if self.r.random() < 0.12:  # no holder: the article's blocks lie in the body
            main = re.sub(r"<(p|h1|h2|ul|ol|div|blockquote|figure|table|pre|section|header)(?=[ >])(?![^>]*data-main)", r'<\1 data-main="1"', self.article(False))
        else:
            main = self.holder(self.article())
        before = self.some(self.head, self.menu, self.notice, self.advert, self.search, self.share, odds=0.35)
        after = self.some(self.comments, self.related, self.side, self.advert, self.form, self.notice, self.share, odds=0.3) + self.some(self.address, odds=0.1) + self.some(self.foot, self.notice, odds=0.6)
        body = before + self.some(self.side, odds=0.15) + main + after
        ids = self.some(lambda: "<!-- ad 1 -->", lambda: "<script>var t='</p>';</script>", lambda: "<style>p{margin:0}</style>", odds=0.4)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title>{ids}</head><body>{body}" + self.r.choice(["</body></html>", "</body></html>", ""])


def labelled_pages(n: int, seed: int = 0) -> list[str]:
    return [Maker(seed * 1_000_003 + k).page() for k in range(n)]


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the query."""
    return learn(labelled_pages(PAGES))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every row of ``pages``."""
    return extract(C.table(spark, sf_dir, "pages").select("page_id", "url", "html"), trained()).select("page_id", "url", "text", "n_chars")
