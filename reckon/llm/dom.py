"""Pages as trees of blocks: a tolerant reader of HTML that keeps what text extraction needs.

A page becomes *nodes* in page order (block elements, controls, inline elements whose names tell something, and the text runs
of a node that has nodes below it) and *pieces* of text, each with its node and whether a block begins before it. End tags may
be missing, extra or crossed; attribute values may be unquoted; what is cut off at the end is read as far as it goes.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

#: Fixed values of HTML: elements without an end tag, elements whose inside is no markup, and elements that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav noscript ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Inline elements that are nodes of their own: controls of forms.
CONTROLS = frozenset("button select label output datalist meter progress object audio video".split())
#: Which open elements a start tag ends, and the elements that this doesn't reach across.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: An end tag doesn't reach across these.
WALLS = frozenset("table td th caption html body".split())
KEEPS_P = frozenset("button td th caption object".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
OTHER = re.compile(r"<[!?/]")
NAMED = re.compile(r"""(?:^|\s)(class|id|role|aria-label|itemprop|hidden|aria-hidden|style|data-main)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words in class, id and role by what they stand for.
GROUPS = {
    "content": "article articlebody articletext content contents entry main maincontent post posts postbody story text prose blogpost body copy bodytext newstext document",
    "menu": "nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs crumbs tabs toc sitemap topnav pagination pager paging prevnext skip skiplink hamburger",
    "head": "header head masthead banner topbar top logo branding brand hero sitehead siteheader titlebar tagline",
    "foot": "footer foot bottom copyright colophon legal imprint impressum disclaimer contentinfo sitefooter credits",
    "side": "sidebar side aside rail complementary widget widgets related recommended recommendations popular trending teaser teasers archive archives tagcloud blogroll sidecol infobox more promo promos",
    "advert": "ad ads advert adverts advertisement advertising adsense adsbygoogle adbox adunit adslot adcontainer sponsor sponsored sponsors affiliate dfp outbrain taboola werbung anzeige publicidad publicite banners",
    "notice": "cookie cookies consent gdpr notice notices notification alert alertdialog dialog popup overlay modal toast paywall interstitial warning message messages announcement",
    "form": "form search searchbox login signin signup register subscribe subscription newsletter contact contactform feedback survey poll optin captcha",
    "comment": "comment comments commentlist respond reply replies discussion disqus review reviews guestbook thread threads usercomment reader responses",
    "share": "share sharing social socials follow facebook twitter like likes rating tools toolbar actions buttons print email",
    "meta": "meta byline author date time timestamp tags category categories posted info",
}
GROUP_OF = {w: k for k, words in enumerate(GROUPS.values()) for w in words.split()}
CONTENT = 1
HIDDEN = 1 << len(GROUPS)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """Nodes: tag, groups (bits of GROUPS, HIDDEN), parent (-1: none), depth, label where the page is labelled. Pieces: node,
    text, whether inside a link, and whether a block begins before it."""

    tags: list[str] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    marks: list[int | None] = field(default_factory=list)
    piece_nodes: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)
    breaks: list[bool] = field(default_factory=list)

    def node(self, tag: str, groups: int, parent: int, mark: int | None) -> int:
        self.tags.append(tag)
        self.groups.append(groups)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.marks.append(mark)
        return len(self.tags) - 1


@lru_cache(maxsize=20_000)
def meaning(attributes: str) -> tuple[int, int | None]:
    """Bits of the groups that an element's names belong to, and its mark in a labelled page."""
    bits, mark = 0, None
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "data-main":
            mark = int(value == "1")
        elif name == "style":
            bits |= HIDDEN if UNSEEN.search(value) else 0
        elif name == "hidden" or name == "aria-hidden":
            bits |= HIDDEN if name == "hidden" or value.lower() == "true" else 0
        else:
            words = [w.lower() for w in PART.findall(value)]
            for w in {*words, *map("".join, zip(words, words[1:]))}:
                for form in (w, w.removesuffix("s")):
                    if (k := GROUP_OF.get(form)) is not None:
                        bits |= 1 << k
                        break
    return bits, mark


def read(source: str) -> Page:
    """The tree of a page. Linear in its length, but for elements that lie very deep."""
    page = Page()
    root = page.node("#page", 0, -1, None)
    stack: list[tuple[str, int, bool]] = [("#page", root, False)]  # tag, its node or the nearest one above, whether that is its own
    run: dict[int, int] = {}  # the text run of a node that is open for more text
    pending, links, at, size, tags, lowered = True, 0, 0, len(source), TAG, None

    def text(raw: str) -> None:
        nonlocal pending
        if not raw:
            return
        node = stack[-1][1]
        if node not in run:
            if not raw.strip():
                if page.texts and not pending:
                    page.texts[-1] += " "
                return
            run[node] = page.node("#text", 0, node, None)
        page.piece_nodes.append(run[node])
        page.texts.append(html.unescape(raw) if "&" in raw else raw)
        page.linked.append(links > 0)
        page.breaks.append(pending)
        pending = False

    def close(k: int) -> None:
        nonlocal pending, links
        for tag, node, own in stack[k:]:
            links -= tag == "a"
            if own:
                run.pop(node, None)
                if tag in BLOCKS or "-" in tag:
                    pending = True
                    run.pop(page.parents[node], None)
        del stack[k:]

    while at < size:
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        m = tags.match(source, start)
        if m is None:
            if OTHER.match(source, start):
                text(source[at:start])
                if source.startswith("<!--", start):
                    end = 1 if source.startswith((">", "->"), start + 4) else source.find("-->", start + 4)
                    at = start + 4 + source[start + 4 : start + 6].index(">") + 1 if end == 1 else end + 3 if end >= 0 else size
                else:
                    end = source.find(">", start)
                    at = end + 1 if end >= 0 else size
                continue
            if start + 1 < size and source[start + 1].isascii() and source[start + 1].isalpha():
                if tags is TAG:  # a quote that is never closed: from here on a tag ends at the first >
                    tags = LOOSE
                    continue
                text(source[at:start])  # cut off within a tag
                break
            text(source[at : start + 1])  # a plain less-than sign
            at = start + 1
            continue
        text(source[at:start])
        at, tag, attributes = m.end(), m[2].lower(), m[3]
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag not in BLOCKS and "-" not in tag and any(t in BLOCKS or "-" in t for t, _, _ in stack[k + 1 :]):
                        links -= tag == "a"  # crossed with a block, which stays open
                        del stack[k]
                    elif tag not in ("body", "html"):
                        close(k)
                    break
                if stack[k][0] in WALLS and tag not in WALLS and tag not in BLOCKS:
                    break
            else:
                if tag == "p" or tag == "br":
                    pending = True
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/") or tag not in ("svg", "iframe"):
                lowered = source.lower() if lowered is None and len(source.lower()) == size else lowered
                end = lowered.find(f"</{tag}", at) if lowered is not None else (x.start() if (x := re.compile(f"</{tag}", re.I).search(source, at)) else -1)
                end = source.find(">", end) if end >= 0 else -1
                at = end + 1 if end >= 0 else size
            continue
        if tag in VOID:
            if tag == "br":
                text("\n")
            elif tag == "hr":
                pending = True
                run.pop(stack[-1][1], None)
            continue
        if tag in BLOCKS or tag in ENDS:
            ended, beyond = ENDS.get(tag, (None, ()))
            if ended:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ended:
                        close(k)
                        if tag != "tr":
                            break
                    elif stack[k][0] in beyond:
                        break
            if tag not in ("html", "body"):
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in KEEPS_P or stack[k][2] and stack[k][0] in BLOCKS and stack[k][0] != "p":
                        break
        bits, mark = meaning(attributes) if attributes else (0, None)
        block = tag in BLOCKS or "-" in tag
        own = block or tag in CONTROLS or mark is not None or bool(bits & ~CONTENT)
        node = stack[-1][1]
        if own:
            if block:
                run.pop(node, None)
                pending = True
            node = page.node(tag, bits, node, mark)
        links += tag == "a"
        stack.append((tag, node, own))
    return page
