"""Main text of web pages: boosted trees judge DOM nodes, decoding keeps the tree consistent.

A page is read into a tree of its block elements.  Every node gets features (share of the
page's text in its subtree, link density, words of its attributes, tag group, depth, place
among its siblings, and the same of its ancestors); a gradient-boosted forest, trained here
on pages made for it, gives the odds that the node belongs to the article.  Decoding takes
the best labelling in which a node inside a rejected node is rejected as well.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without an end tag, without text of their own to show,
# those that run inside a line, and those that end an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
SCOPE = frozenset("ul ol dl table body article section div nav main aside header footer select".split())

BELOW = 0.3  # weight of the text below a node against the text directly in it

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(?:/?[a-zA-Z][^<]*|/?)\Z", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

GROUPS = {  # tag -> feature
    "article": "t_article", "main": "t_main", "section": "t_section", "div": "t_div", "p": "t_p", "nav": "t_nav",
    "header": "t_header", "footer": "t_footer", "aside": "t_aside", "form": "t_form", "fieldset": "t_form", "button": "t_form",
    "select": "t_form", "textarea": "t_form", "dialog": "t_notice", "ul": "t_list", "ol": "t_list", "dl": "t_list", "li": "t_item",
    "dt": "t_item", "dd": "t_item", "h1": "t_heading", "h2": "t_heading", "h3": "t_heading", "h4": "t_heading", "h5": "t_heading",
    "h6": "t_heading", "blockquote": "t_quote", "pre": "t_quote", "figure": "t_figure", "figcaption": "t_figure", "table": "t_table",
    "body": "t_body",
}
TOKENS = {  # words of class, id, role, itemprop and aria-label -> feature
    "good": "article articlebody body content entry main post story text page single prose".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip sitemap links".split(),
    "head": "header masthead banner topbar logo branding branding".split(),
    "foot": "footer foot copyright legal colophon".split(),
    "side": "sidebar aside side widget rail related recommended recommend popular trending more teaser secondary complementary".split(),
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promoted promotion adsense outbrain taboola".split(),
    "notice": "cookie cookies consent notice modal popup overlay gdpr alert banner dialog privacy disclaimer".split(),
    "form": "form newsletter subscribe signup login search contact survey".split(),
    "talk": "comment comments reply replies disqus discussion respond feedback reactions reader".split(),
    "share": "share sharing social follow tools toolbar meta tags tag byline author".split(),
}
_TOKEN_OF = {w: name for name, words in TOKENS.items() for w in words}
_KINDS = sorted(set(GROUPS.values()))
_NAMES = list(TOKENS)
OWN = [*_KINDS, *(f"k_{k}" for k in _NAMES)]
NUMBERS = ["share", "log_chars", "link_density", "own_density", "words", "depth", "index", "from_end", "siblings", "children",
           "p_share", "sentences", "place"]
FEATURES = [*OWN, *NUMBERS, *(f"up_{n}" for n in OWN), "up_best_share", "parent_links"]
_KIND_BIT = {tag: 1 << _KINDS.index(kind) for tag, kind in GROUPS.items()}
_TOKEN_BIT = {t: 1 << (len(_KINDS) + i) for i, t in enumerate(_NAMES)}
_MOST = np.array([400, 1000, 30, 30, 60, 60, 1, 60], np.float32)  # of own words .. sentences


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset
    index: int = 0
    children: list[int] = field(default_factory=list)
    chars: int = 0
    own: int = 0
    linked: int = 0
    sentences: int = 0
    in_p: int = 0
    begin: int = 0


def _tokens(attributes: str) -> frozenset:
    if "=" not in attributes:
        return frozenset()
    found = set()
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        found.update(_TOKEN_OF[w] for w in _WORD.findall((a or b or c).lower()) if w in _TOKEN_OF)
    return frozenset(found)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The page's block nodes, and its pieces of text in order as (node, text); a node number
    with a None text marks where a block begins or ends.

    Unclosed and misplaced tags are read as browsers do for the cases that matter here: a
    block ends an open paragraph, an item ends the item before it, an end tag without its
    start is skipped, everything left open ends with the page.  A tag that the page breaks off
    in is dropped.
    """
    nodes = [Node("body", -1, 0, frozenset())]
    texts: list = []
    stack, links, at, chars = [0], 0, 0, 0

    def put(raw: str):
        nonlocal chars
        if not raw:
            return
        raw = html.unescape(raw) if "&" in raw else raw
        n = nodes[stack[-1]]
        size = len(raw) - raw.count(" ") - raw.count("\n")
        if size:
            n.own += size
            n.sentences += raw.count(". ") + raw.count(".") // 2
            n.linked += size if links else 0
            chars += size
        texts.append((stack[-1], raw))

    def close(depth: int):
        while len(stack) > depth:
            texts.append((stack.pop(), None))

    hidden = None
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if hidden is None:
            put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if hidden is not None:
            if end and tag == hidden or tag == "body":  # a head without its end tag
                hidden = None
            continue
        if not end and tag in HIDDEN:
            if tag in RAW:  # what is inside is no markup
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            elif not m[3].endswith("/"):
                hidden = tag
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if end else 1
            if tag in ("br", "img") and not end:
                texts.append((stack[-1], " "))
            continue
        if tag in ("html", "body"):
            continue
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == tag:
                    close(i)
                    links = 0
                    break
            continue
        links = 0 if tag in CLOSES_P else links
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == "p":
                    close(i)
                    break
                if nodes[stack[i]].tag in SCOPE:
                    break
        if tag in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag in SAME[tag]:
                    close(i)
                    break
                if nodes[stack[i]].tag in SCOPE:
                    break
        if tag in VOID:
            texts.append((stack[-1], None))
            continue
        up = stack[-1]
        nodes.append(Node(tag, up, nodes[up].depth + 1, _tokens(m[3]), len(nodes[up].children), begin=chars))
        nodes[up].children.append(len(nodes) - 1)
        texts.append((up, None))
        stack.append(len(nodes) - 1)
        if m[3].endswith("/") and tag not in CLOSES_P:
            close(len(stack) - 1)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            put(page[at : stop.start()] if stop else page[at:])
            at = stop.end() if stop else len(page)
            close(len(stack) - 1)
    if hidden is None:
        put(page[at:])
    close(0)
    _separate(nodes, texts)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        n.chars += n.own
        if n.tag == "p":
            n.in_p = n.chars
        if n.parent >= 0:
            up = nodes[n.parent]
            up.chars += n.chars
            up.linked += n.linked
            up.sentences += n.sentences
            up.in_p += n.in_p
    return nodes, texts


def _separate(nodes: list[Node], texts: list) -> None:
    """Text directly in a node that also has block children becomes a leaf of its own."""
    leaf = {}
    for i in range(len(nodes)):
        n = nodes[i]
        if n.own and (n.children or i == 0):
            leaf[i] = len(nodes)
            nodes.append(Node("#text", i, n.depth + 1, frozenset(), len(n.children), own=n.own, linked=n.linked,
                              sentences=n.sentences, begin=n.begin))
            n.children.append(leaf[i])
            n.own = n.linked = n.sentences = 0
    for k, (node, text) in enumerate(texts):
        if text is not None and node in leaf:
            texts[k] = (leaf[node], text)


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node.  Tag groups and attribute words are bits of a number, so what the
    ancestors have is one OR per node; the bits become columns at the end."""
    total = max(1, nodes[0].chars)
    own, above, best, numbers = [], [], [], []
    for i, n in enumerate(nodes):
        bits = _KIND_BIT.get(n.tag, 0)
        for t in n.tokens:
            bits |= _TOKEN_BIT[t]
        own.append(bits)
        up = max(n.parent, 0)
        parent = nodes[up]
        above.append(above[up] | own[up] if i else 0)
        best.append(0.0 if not i else best[up] or max(nodes[c].chars for c in parent.children) / total)
        c = max(1, n.chars)
        numbers.append((n.chars / total, n.chars, n.linked / c, n.own / c, n.own, n.depth, n.index, len(parent.children) - n.index,
                        len(parent.children), len(n.children), n.in_p / c, n.sentences, n.begin / total, best[-1], parent.linked / max(1, parent.chars)))
    num = np.array(numbers, np.float32)
    num[:, 1] = np.log1p(num[:, 1])
    num[:, 4:12] = np.minimum(num[:, 4:12], _MOST)
    place = np.arange(len(OWN))
    flags = [(np.array(b, np.int64)[:, None] >> place & 1).astype(np.float32) for b in (own, above)]
    return np.concatenate([flags[0], num[:, :13], flags[1], num[:, 13:]], axis=1)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the best sum of weighted odds in which no node below a rejected
    one is kept.

    A node weighs with the text directly in it and, less, with all text below it, so one long
    paragraph outweighs many empty wrappers and a rejected comment list takes its paragraphs
    along.
    """
    best = np.array([1.0 + n.own + BELOW * n.chars for n in nodes]) * odds
    for i in range(len(nodes) - 1, 0, -1):  # children follow their parents
        best[nodes[i].parent] += max(best[i], 0.0)
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and best[i] > 0
    return keep & np.array([i == 0 or n.own > 0 or bool(n.children) for i, n in enumerate(nodes)])


def blocks(texts: list, keep: np.ndarray) -> str:
    out, held = [], []
    for node, text in [*texts, (0, None)]:
        if text is None:
            line = " ".join("".join(held).split())
            if line:
                out.append(line)
            held = []
        elif keep[node]:
            held.append(text)
    return "\n".join(out)


def extract_batch(pages: list[str | None], forest) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    odds = forest.odds(np.concatenate([features(n) for n, _ in parsed])) if parsed else []
    out, at = [], 0
    for nodes, texts in parsed:
        out.append(blocks(texts, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", forest=None) -> DataFrame:
    """(page_id, url, text, n_chars) per input row, from the whole page.

    A null or empty page, and one without an article, gives an empty text.  Repeated rows give
    equal rows; other columns are not read; an empty table gives an empty result.  The forest
    is fitted on a bounded number of pages made for it and travels with the task (some 50 kB).
    """
    if forest is None:
        from basketry.llm.html_training import trained

        forest = trained()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}

    def work(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found = extract_batch(part.column(2).to_pylist(), forest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id), F.col(url), F.col(page)).mapInArrow(
        work, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars bigint")
