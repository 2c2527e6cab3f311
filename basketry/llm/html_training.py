"""The forest of the page extractor and the pages it is trained on.

The given pages carry no marks of their article, so the labelled nodes come from pages made
here: seeded layouts with menus, headers, footers, sidebars, notices, adverts, forms and
comments around and inside an article, well-formed or not.  ``PAGES`` bounds the sample.
"""

from __future__ import annotations

import functools
import random
from dataclasses import dataclass

import numpy as np

from basketry.llm import html_extract as dom

PAGES = 600
SEED = 8
TREES = 70
DEPTH = 4
RATE = 0.25
BINS = 24
MARK = "⁣"  # invisible sign in front of every article block of a made page


@dataclass
class Forest:
    """Complete binary trees: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray  # trees x (2**depth - 1)
    limit: np.ndarray
    value: np.ndarray  # trees x 2**depth
    start: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds that a node belongs to the article."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.limit, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(v) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Forest:
    """Gradient boosting of logistic loss over binned features, grown level by level."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    mean = float((weight * y).sum() / weight.sum())
    forest = Forest(np.zeros((trees, 2**DEPTH - 1), np.int64), np.full((trees, 2**DEPTH - 1), np.inf, np.float32),
                    np.zeros((trees, 2**DEPTH)), float(np.log(mean / (1 - mean))))
    score = np.full(len(x), forest.start)
    for k in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            _split(forest, k, first, binned, edges, at - first, 2**level, slope, curve)
            goes = x[np.arange(len(x)), forest.feature[k][at]] > forest.limit[k][at]
            at = 2 * at + 1 + goes
        leaf = at - (2**DEPTH - 1)
        g, h = np.bincount(leaf, slope, 2**DEPTH), np.bincount(leaf, curve, 2**DEPTH)
        forest.value[k] = RATE * g / (h + 1.0)
        score += forest.value[k][leaf]
    return forest


def _split(forest, k, first, binned, edges, node, count, slope, curve):
    best = np.full(count, 1e-6)
    for f, e in enumerate(edges):
        if not len(e):
            continue
        cell = node * (len(e) + 1) + binned[:, f]
        g = np.bincount(cell, slope, count * (len(e) + 1)).reshape(count, -1).cumsum(axis=1)
        h = np.bincount(cell, curve, count * (len(e) + 1)).reshape(count, -1).cumsum(axis=1)
        gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
        cut = gain.argmax(axis=1)
        top = gain[np.arange(count), cut]
        for n in np.flatnonzero(top > best):
            best[n] = top[n]
            forest.feature[k][first + n], forest.limit[k][first + n] = f, e[cut[n]]


class Writer:
    """Makes one page; ``article`` text is marked."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.loose = self.r.random() < 0.35  # leaves out end tags
        self.named = self.r.random() < 0.85  # uses telling tags and class names
        letters = "etaoinshrdlucmfwypvbgk"
        self.lexicon = ["".join(self.r.choices(letters, k=self.r.randint(1, 11))) for _ in range(300)]

    def words(self, lo: int, hi: int) -> str:
        found = self.r.choices(self.lexicon, k=self.r.randint(lo, hi))
        for i in range(len(found)):
            roll = self.r.random()
            if roll < 0.08:
                found[i] += "."
            elif roll < 0.14:
                found[i] += ","
            elif roll < 0.15:
                found[i] = f"<{(t := self.r.choice(['b', 'em', 'i', 'strong', 'span']))}>{found[i]}</{t}>"
        return " ".join(found) + self.r.choice([".", "", "!", "."])

    def name(self, *names: str) -> str:
        if not self.named and self.r.random() < 0.7:
            return self.r.choice(["", f' class="{self.r.choice(self.lexicon)}"'])
        pick = self.r.choice(names)
        pick = self.r.choice([pick, f"{pick}-{self.r.choice(['box', 'wrap', 'inner', 'area', 'block', '1'])}", f"site-{pick}", pick.title()])
        return f' {self.r.choice(["class", "class", "id"])}="{pick}"'

    def box(self, tags: list[str], names: list[str], inside: str, telling: float = 0.5) -> str:
        tag = self.r.choice(tags) if self.named and self.r.random() < telling else "div"
        return f"<{tag}{self.name(*names)}>{inside}</{tag}>"

    def p(self, text: str, tag: str = "p") -> str:
        return f"<{tag}>{text}" + ("" if self.loose and tag in ("p", "li") and self.r.random() < 0.5 else f"</{tag}>")

    def link_list(self, lo: int, hi: int) -> str:
        links = [f'<a href="/{self.r.choice(self.lexicon)}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(lo, hi))]
        shape = self.r.random()
        if shape < 0.65:
            t = self.r.choice(["ul", "ul", "ol"])
            return f"<{t}>" + "".join(self.p(a, "li") for a in links) + f"</{t}>"
        return self.r.choice([" | ", " ", "<br>", " &middot; "]).join(links)

    def menu(self) -> str:
        return self.box(["nav", "nav", "menu"], ["nav", "menu", "navbar", "breadcrumb", "navigation"], self.link_list(2, 9), 0.7)

    def form(self) -> str:
        inside = f'{self.words(1, 8)} <input name="q"><button>{self.words(1, 2)}</button>'
        if self.r.random() < 0.3:
            inside += "<select>" + "".join(f"<option>{self.words(1, 2)}</option>" for _ in range(3)) + "</select><textarea>x</textarea>"
        return f"<form{self.name('search', 'newsletter', 'subscribe', 'login', 'contact')}>{inside}</form>"

    def notice(self) -> str:
        return self.box(["dialog", "section", "aside"], ["cookie", "notice", "consent", "banner", "modal", "alert", "gdpr"],
                        self.p(self.words(5, 35)) + self.r.choice(["", "<button>ok</button>", self.link_list(1, 2)]), 0.3)

    def advert(self) -> str:
        return self.box(["aside", "section"], ["ad", "ads", "advert", "sponsored", "promo", "advertisement"],
                        self.r.choice([self.words(2, 25), self.p(self.words(2, 25)), self.link_list(1, 3)]), 0.25)

    def side(self) -> str:
        parts = [f"<h{self.r.randint(2, 4)}>{self.words(1, 4)}</h3>" + self.r.choice([self.link_list(2, 8), self.p(self.words(4, 40)), self.form(), self.advert()])
                 for _ in range(self.r.randint(1, 4))]
        return self.box(["aside", "aside", "section"], ["sidebar", "side", "related", "widget", "popular", "recommended", "rail"], "".join(parts), 0.7)

    def comments(self) -> str:
        one = lambda: self.r.choice(["", f"<div>{self.words(1, 3)}</div>"]) + self.p(self.words(3, 70))
        n = self.r.randint(1, 8)
        if self.r.random() < 0.5:
            inside = "<ol>" + "".join(self.p(one(), "li") for _ in range(n)) + "</ol>"
        else:
            tag = self.r.choice(["div", "article", "section"])
            inside = "".join(f"<{tag}{self.name('comment', 'reply')}>{one()}</{tag}>" for _ in range(n))
        head = f"<h3>{self.words(1, 3)}</h3>" if self.r.random() < 0.6 else ""
        named, self.named = self.named, True  # without any name they could not be told from the text
        out = self.box(["section", "div"], ["comments", "comment", "discussion", "replies", "disqus", "respond"],
                       head + inside + (self.form() if self.r.random() < 0.4 else ""), 0.5)
        self.named = named
        return out

    def share(self) -> str:
        return self.box(["div", "ul"], ["share", "social", "tools", "tags"], self.link_list(2, 5), 0.2)

    def article(self) -> str:
        r = self.r
        say = lambda lo, hi: MARK + self.words(lo, hi)
        head = f"<h1>{say(2, 12)}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        parts = [head]
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            roll = r.random()
            if roll < 0.70:
                parts.append(self.p(say(1, 120) if r.random() < 0.8 else say(1, 6)))
            elif roll < 0.76:
                parts.append(f"<h{(h := r.randint(2, 4))}>{say(1, 8)}</h{h}>")
            elif roll < 0.82:
                t = r.choice(["ul", "ol"])
                parts.append(f"<{t}>" + "".join(self.p(say(2, 30), "li") for _ in range(r.randint(1, 6))) + f"</{t}>")
            elif roll < 0.86:
                parts.append(f"<blockquote>{self.p(say(4, 50)) if r.random() < 0.5 else say(4, 50)}</blockquote>")
            elif roll < 0.88:
                parts.append(f"<pre>{say(4, 40)}</pre>")
            elif roll < 0.91:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{say(1, 6)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 5))) + "</table>")
            elif roll < 0.93:
                parts.append(f'<figure><img src="x"><figcaption>{say(2, 20)}</figcaption></figure>')
            elif roll < 0.95:
                parts.append(f"<div>{say(10, 80)}</div>")
            else:
                parts.append(r.choice([self.advert, self.share, self.form, self.side, self.notice])())
        if self.loose and r.random() < 0.5:
            parts[-1] = f"<p><b>{say(3, 30)}<br>" + parts[-1]
        if r.random() < 0.2:
            parts.append(self.r.choice([self.share, self.side, self.comments])())
        inside = "".join(parts)
        roll = r.random()
        if roll < 0.5:
            return f"<article{r.choice(['', self.name('post', 'entry', 'story')])}>{inside}</article>"
        names = self.name("content", "post", "entry", "story", "article", "article-body", "post-content", "main", "text", "body")
        if roll < 0.62:
            return f"<section{names}>{inside}</section>"
        return f"<div{names}>{inside}</div>"

    def page(self) -> str:
        r = self.r
        has = r.random() < 0.94
        above = [self.box(["header"], ["header", "masthead", "top", "banner", "logo"],
                          "".join(r.sample([self.menu(), self.form(), f'<a href="/">{self.words(1, 4)}</a>', self.p(self.words(1, 8))], r.randint(1, 3))), 0.6)
                 if r.random() < 0.6 else "", self.menu() if r.random() < 0.7 else "", self.notice() if r.random() < 0.35 else "",
                 self.advert() if r.random() < 0.4 else ""]
        r.shuffle(above)
        middle = [self.article()] if has else []
        if r.random() < 0.4:
            middle.insert(r.choice([0, len(middle)]), self.side())
        if r.random() < 0.35:
            middle.append(self.comments())
        if r.random() < 0.3:
            middle.append(self.advert())
        body = "".join(middle)
        if r.random() < 0.3:
            body = f"<main{r.choice(['', self.name('main', 'content')])}>{body}</main>"
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            body = f"<div{self.name('wrap', 'container', 'page', 'site', 'layout', 'row', 'col')}>{body}</div>"
        below = [self.box(["footer"], ["footer", "foot", "copyright", "legal", "colophon"],
                          "".join(r.sample([self.link_list(2, 8), "&copy; " + self.words(2, 14), self.p(self.words(3, 25)), self.form()], r.randint(1, 2))), 0.7)
                 if r.random() < 0.9 else "", self.notice() if r.random() < 0.15 else "", self.advert() if r.random() < 0.1 else ""]
        page = f"<html><head><title>{self.words(2, 8)}</title></head><body>{''.join(above)}{body}{''.join(below)}</body></html>"
        return page[: -r.randint(1, 40)] if r.random() < 0.2 else page


def labelled(page: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and weight of every node; a node is part of the article if marked text is in it."""
    nodes, texts = dom.parse(page)
    y = np.zeros(len(nodes))
    for node, text in texts:
        if text and MARK in text:
            y[node] = 1
    for i in range(len(nodes) - 1, 0, -1):
        y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
    return dom.features(nodes), y, np.array([1.0 + np.log1p(n.chars) for n in nodes])


def truth(page: str) -> str:
    """The text that a perfect extractor returns for a made page."""
    nodes, texts = dom.parse(page)
    marked = {node for node, text in texts if text and MARK in text}
    return dom.blocks(texts, np.array([i in marked for i in range(len(nodes))])).replace(MARK, "")


@functools.lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED) -> Forest:
    parts = [labelled(Writer(seed * 1_000_003 + i).page()) for i in range(pages)]
    return fit(*(np.concatenate(c) for c in zip(*parts)))
