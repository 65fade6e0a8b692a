"""Main text of web pages by boosted trees over DOM nodes.

Every element is described by its tag, attribute words, depth, subtree density and
siblings; gradient-boosted trees give each a log-odds of being main text.  Decoding is
hierarchical: from the leaves up, each subtree is either dropped whole or entered, whichever
has the larger sum of log-likelihoods, so no element is kept below a dropped ancestor.

Pages come without labels, so the trees are trained on pages written by
:func:`sample_pages`, whose labels are known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import CHUNK_BYTES, chunks
from lodestar.llm.dom import INLINE, RAW, Node, blocks, elements, parse

PAGES, SEED = 1000, 31
ROUNDS, DEPTH, RATE, BINS = 100, 5, 0.2, 32

# Element groups and words of class, id and role attributes that tell.
GROUPS = [["article", "main"], ["nav", "menu"], ["header"], ["footer"], ["aside"], ["form", "button", "input", "label", "fieldset"], ["p"], ["h1", "h2", "h3", "h4", "h5", "h6"], ["ul", "ol", "dl"], ["li", "dt", "dd"], ["a"], ["div", "section"], ["table", "tr", "td", "th", "tbody"], ["blockquote", "pre", "code"], ["b", "i", "em", "strong", "span"], ["dialog"], ["figure", "figcaption", "img"], ["body", "html", "#root"], ["head"]]
GOOD_WORDS = re.compile(r"article|content|post|story|entry|main|body|text|prose")
BAD_WORDS = {
    "menu": re.compile(r"nav|menu|breadcrumb|pager|pagination|toc|skip"),
    "edge": re.compile(r"header|footer|masthead|banner|copyright|colophon|topbar|legal"),
    "side": re.compile(r"side|aside|widget|related|recommend|popular|trending|more-"),
    "ad": re.compile(r"(?:^|[^a-z])ads?(?:[^a-z]|$)|advert|sponsor|promo|outbrain|taboola"),
    "notice": re.compile(r"cookie|consent|notice|gdpr|popup|modal|overlay|alert|subscribe|newsletter|signup|dialog"),
    "comment": re.compile(r"comment|discussion|disqus|repl(?:y|ies)|respond|reader"),
    "form": re.compile(r"form|search|login|input"),
    "share": re.compile(r"share|social|follow|tweet|meta|byline|author|tags?(?:[^a-z]|$)"),
}
_GOOD = 1 << len(BAD_WORDS)
_KIND = {t: k for k, g in enumerate(GROUPS) for t in g}


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each element of one or more pages, their roots first: tag groups of itself and its ancestors, attribute words, depth, subtree and sibling statistics."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    up = [i if x.parent is None else place[id(x.parent)] for i, x in enumerate(nodes)]
    own = [0 if x.tag in RAW else sum([len(c.strip()) for c in x.children if isinstance(c, str)]) for x in nodes]
    text, count = own.copy(), [1] * n
    links = [o if x.tag == "a" else 0 for o, x in zip(own, nodes, strict=True)]
    paragraphs = [int(x.tag == "p") for x in nodes]
    for i in range(n - 1, -1, -1):
        j = up[i]
        if j != i:
            text[j] += text[i]
            links[j] += links[i]
            count[j] += count[i]
            paragraphs[j] += paragraphs[i]
    kind = [_KIND.get(x.tag, len(GROUPS)) for x in nodes]
    # one bit for each special tag group and attribute word, of the element and of it and its ancestors
    mine = [_bits(x.words()) if x.attributes else 0 for x in nodes]
    above = [0] * n
    order, siblings, root = [0] * n, [0] * n, list(range(n))
    for i in range(n):
        j = up[i]
        above[i] = (above[j] if j != i else 0) | mine[i] | (1 << kind[i] + 16 if kind[i] < 6 else 0)
        if j != i:
            order[i] = siblings[j]
            siblings[j] += 1
            root[i] = root[j]
    up_, own_, text_, links_, count_, paragraphs_, siblings_, order_ = (np.array(c, float) if k else np.array(c) for k, c in enumerate((up, own, text, links, count, paragraphs, siblings, order)))
    whole, around = np.maximum(text_[np.array(root)], 1), np.maximum(siblings_[up_], 1)
    cols = [np.array(kind) == k for k in range(len(GROUPS) + 1)]
    cols += [np.array(mine) >> k & 1 for k in range(len(BAD_WORDS) + 1)]
    cols += [np.array(above) >> k & 1 for k in [*range(len(BAD_WORDS) + 1), *range(16, 22)]]
    told = [_told(x.words()) if x.attributes else (0, 0.0) for x in nodes]
    most = [t[1] for t in told]
    for i in range(n):
        most[i] = max(most[i], most[up[i]])
    cols += [[t[0] for t in told], [t[1] for t in told], most]
    cols += [[x.depth for x in nodes], np.log1p(own_), np.log1p(text_), text_ / whole, links_ / np.maximum(text_, 1), text_ / count_, np.log1p(paragraphs_), paragraphs_ / count_, siblings_[up_], order_ / around, text_ / np.maximum(text_[up_], 1), [x.hidden() for x in nodes]]
    return np.column_stack([np.asarray(c, float) for c in cols])


@lru_cache(maxsize=65536)
def _bits(words: str) -> int:
    """Which of the telling words are among the attribute words."""
    return sum(1 << k for k, r in enumerate([*BAD_WORDS.values(), GOOD_WORDS]) if r.search(words)) if words else 0


@lru_cache(maxsize=65536)
def _told(words: str) -> tuple[int, float]:
    """How many words the attribute words are made of, and the share of those that name what isn't main text: 1 for ``ad``, less for ``an-ad-of-old``."""
    parts = re.findall(r"[^\W\d_]+", words)
    return len(parts), sum(_bits(w) & ~_GOOD > 0 for w in parts) / max(len(parts), 1)


@dataclass
class Trees:
    """Boosted regression trees as arrays; feature -1 marks leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss with histogram splits."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    width = max(len(e) for e in edges) + 1
    cell = binned + width * np.arange(x.shape[1])
    usable = np.arange(width - 1) < np.array([len(e) for e in edges])[:, None]
    base = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    score, size = np.full(len(y), base), 2 ** (DEPTH + 1) - 1
    trees = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for k in range(size):
            mine = np.flatnonzero(node == k)
            if not len(mine):
                continue
            gs, hs = g[mine].sum(), h[mine].sum()
            value[k] = RATE * gs / (hs + 1)
            if k >= 2**DEPTH - 1 or len(mine) < 10:
                continue
            cells = cell[mine].reshape(-1)
            gl, hl = (np.cumsum(np.bincount(cells, np.repeat(w[mine], x.shape[1]), width * x.shape[1]).reshape(-1, width), axis=1)[:, :-1] for w in (g, h))
            gain = np.where(usable, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), -np.inf)
            f, t = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[f, t] > 1e-3:
                feature[k], cut[k] = f, edges[f][t]
                node[mine] = 2 * k + 1 + (x[mine, f] > cut[k])
        score += value[node]
        trees.append((feature, cut, value))
    return Trees(base, *(np.array(a) for a in zip(*trees, strict=True)))


def decode(nodes: list[Node], odds: np.ndarray) -> set[int]:
    """ids of the elements to keep; none of them has a dropped ancestor.

    A kept element adds the log-likelihood of main text, an element of a dropped subtree
    that of the rest, each weighed by the length of its own text (and a little for itself).
    """
    place = {id(x): i for i, x in enumerate(nodes)}
    weight = np.array([0.05 + sum(len(c.strip()) for c in x.children if isinstance(c, str)) ** 0.5 for x in nodes])
    yes, no = -np.logaddexp(0, -odds) * weight, -np.logaddexp(0, odds) * weight
    best, drop = yes.copy(), no.copy()
    best, drop = best.tolist(), drop.tolist()
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].parent is not None:
            j = place[id(nodes[i].parent)]
            best[j] += max(best[i], drop[i])
            drop[j] += drop[i]
    kept: set[int] = set()
    for i, x in enumerate(nodes):
        if x.parent is None or (id(x.parent) in kept and (best[i] >= drop[i] or x.tag in INLINE and x.tag not in ("button", "input", "label"))):
            kept.add(id(x))
    return kept


_SYLLABLES = "ka lo mi ter sen dar vol ni pra tu es ing ar ob lin que rel ost ban dy".split()


def sample_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[Node, list[bool]]]:
    """Pages of many layouts with invented text; the mark of each element says if it is main text."""
    rng = np.random.default_rng(seed)
    style = " "

    def some(*options):
        return options[rng.integers(len(options))]

    def word():
        return "".join(rng.choice(_SYLLABLES, rng.integers(1, 4)))

    def text(low, high):
        words = [word() for _ in range(rng.integers(low, high))]
        return style.join(words) + some(".", ".", "")

    def links(k):
        return "".join(f'<li><a href="/{word()}">{text(1, 4)[:-1]}</a></li>' for _ in range(k))

    def paragraph():
        inner = text(2, 90)
        if rng.random() < 0.25:
            inner = some(f"<b>{inner}<br>", f"<b>{text(1, 5)}</b> {inner}", f'{inner} <a href="/x">{text(1, 3)}</a> {text(2, 9)}', f"<em>{inner}</em>", f"{inner}<br>{text(3, 20)}")
        return f"<p>{inner}" + ("</p>" if rng.random() < 0.85 else "")

    def junk():
        kind = rng.integers(12)
        if kind == 0:
            return f"<nav><ul>{links(rng.integers(3, 12))}</ul></nav>"
        if kind == 1:
            return f'<div class="{some("menu", "navbar", "nav-links", "breadcrumbs", "site-menu")}"><ul>{links(rng.integers(2, 9))}</ul></div>'
        if kind == 2:
            return some(f'<div class="{some("ad", "ads", "advert", "ad-slot", "sponsored", "promo")}">{text(3, 25)}</div>', f'<div id="ad-{rng.integers(9)}"><p>{text(3, 25)}</p></div>', f'<section class="advertisement"><a href="/buy">{text(3, 12)}</a></section>')
        if kind == 3:
            return f'<aside class="{some("sidebar", "related", "widget", "")}"><h3>{text(1, 4)}</h3><p>{text(5, 40)}</p><ul>{links(rng.integers(1, 6))}</ul></aside>'
        if kind == 4:
            return f'<div class="{some("sidebar", "side-bar", "related-posts", "widget", "popular")}"><h4>{text(1, 4)}</h4>' + "".join(f"<p>{text(4, 30)}</p>" for _ in range(rng.integers(1, 4))) + "</div>"
        if kind == 5:
            return f'<div class="{some("cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "popup")}" {some("", "role=dialog")}><p>{text(6, 40)}</p><button>{text(1, 3)}</button></div>'
        if kind == 6:
            return f'<form action="/s"><label>{text(1, 5)}</label><input name="q"><p>{text(2, 12)}</p><button>{text(1, 2)}</button></form>'
        if kind == 7:
            tag = some("section", "div", "ol")
            return f'<{tag} class="{some("comments", "comment-list", "discussion", "reader-comments", "responses")}" {some("", "id=comments")}>' + "".join(f'<div class="{some("comment", "reply", "c")}"><b>{word()}</b><p>{text(4, 60)}</p></div>' for _ in range(rng.integers(1, 6))) + f"</{tag}>"
        if kind == 8:
            return f'<div class="{some("newsletter", "subscribe", "signup", "login-form")}"><p>{text(4, 25)}</p><input></div>'
        if kind == 9:
            return f'<div class="{some("share", "social", "share-buttons")}">{links(3)}</div>'
        if kind == 10:
            return f'<header class="{some("site-header", "masthead", "top", "")}"><a href="/">{text(1, 4)}</a><p>{text(2, 10)}</p></header>'
        return some(f"<footer><p>&copy; {text(3, 30)}</p></footer>", f"<footer>&copy; {word()} &middot; {text(3, 30)}</footer>", f'<div class="{some("footer", "site-footer", "copyright")}">&copy; {text(3, 25)}</div>')

    def odd_name():
        """A name inside main text that holds a word of what usually isn't: a text about menus, not a menu."""
        word_ = some("menu", "nav", "toc", "header", "footer", "banner", "legal", "side", "related", "popular", "ad", "promo", "sponsor", "cookie", "notice", "alert", "comment", "reader", "reply", "search", "form", "share", "author", "meta", "social")
        return some(f"{some('text', 'content', 'story', 'body', 'post', 'article', 'entry')}-{word_}", f"{word_}-{some('on', 'of', 'about', 'in', 'and')}-{word()}", f"{word()}-{word_}", f"{word_}s-{word()}-{word()}")

    def block():
        r = rng.random()
        return paragraph() if r < 0.86 else f"<h2>{text(1, 6)}</h2>" if r < 0.9 else f"<ul><li>{text(2, 15)}</li><li>{text(2, 15)}</li></ul>" if r < 0.93 else f"<blockquote>{text(5, 30)}</blockquote>" if r < 0.96 else f"<pre>{text(3, 12)}</pre>" if r < 0.98 else f"<table><tr><td>{text(1, 6)}</td><td>{text(1, 6)}</td></tr></table>"

    def within(tag, attributes, body):
        return f"<{tag}{attributes}>{body}</{tag}>"

    def inner(depth=0):
        """A part of main text in elements of its own."""
        kind = rng.integers(10)
        body = "".join(block() if depth or rng.random() < 0.8 else inner(depth + 1) for _ in range(rng.integers(1, 4)))
        if kind == 0:
            return f"<section><h3>{text(1, 6)}</h3>{body}</section>"
        if kind == 1:
            return some(f"<div>{body}</div>", f"<div><div>{body}</div></div>", f"<div>{text(2, 40)}</div>")
        if kind == 2:
            return within(some("section", "div"), f' {some("class", "id")}="{some(word(), "part-1", "chapter", "lead", "intro", "summary", "columns")}"', body)
        if kind == 3:
            return f"<details{some('', ' open')}><summary>{text(1, 6)}</summary>{body}</details>"
        if kind == 4:
            return "<dl>" + "".join(f"<dt>{text(1, 3)}</dt><dd>{text(1, 25)}</dd>" for _ in range(rng.integers(1, 5))) + "</dl>"
        if kind == 5:
            return f"<figure>{some('<img src=x>', '<img src=x alt=y>', '')}<figcaption>{text(1, 14)}</figcaption></figure>"
        if kind == 6:
            return within(some("div", "section"), f' {some("class", "id")}="{odd_name()}"', body)
        if kind == 7:
            return within(some("p", "p", "p", "h2", "h3", "blockquote"), f' {some("class", "id")}="{odd_name()}"', text(3, 60))
        if kind == 8:
            return within(some("ul", "ol"), some("", f' class="{odd_name()}"'), "".join(f"<li>{some('', '<p>')}{text(1, 18)}</li>" for _ in range(rng.integers(1, 6))))
        return f"<div><p>{text(3, 40)}</p><p><a href='/{word()}'>{text(1, 4)}</a> {text(2, 20)}</p></div>"

    out = []
    for _ in range(n):
        style = some(" ", " ", ". ", " | ", "### ", ", ")
        tag, attributes = some(("article", ""), ("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="post-body"'), ("section", ' class="article-text"'), ("div", ' class="entry"'), ("article", ' class="post"'), ("div", ""))
        layered = some(0, 0, 0.15, 0.4, 0.8)
        parts = [f"<h1>{text(2, 9)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(int(rng.choice([1, 2, 3, 5, 8, 12, 18]))):
            parts.append(inner() if rng.random() < layered else block())
            if rng.random() < 0.08:
                parts.append(f"<!--junk-->{junk()}<!--end-->")
        body = f"<!--main--><{tag}{attributes}>{''.join(parts)}</{tag}><!--rest-->"
        before, after = "".join(junk() for _ in range(rng.integers(0, 4))), "".join(junk() for _ in range(rng.integers(0, 5)))
        body = before + body + after
        for _ in range(rng.integers(0, 3)):
            body = f'<div class="{some("wrap", "container", "page", "row", "layout")}">{body}</div>'
        page = f"<html><head><title>x</title><style>p</style></head><body>{body}</body></html>"
        marks, state = {}, "rest"
        main_page = re.sub(r"<!--(main|rest|junk|end)-->", lambda m: f"<mark-{m[1]}/>", page)
        root = parse(main_page)
        nodes, label = [], []

        def walk(node, state):
            here = []
            for c in node.children:
                if isinstance(c, Node) and c.tag.startswith("mark-"):
                    state = {"main": "main", "rest": "rest", "junk": "junk", "end": "main"}[c.tag[5:].rstrip("/")]
                else:
                    here.append(c)
                    if isinstance(c, Node):
                        marks[id(c)] = state
                        state = walk(c, state)
            node.children = here
            return state

        walk(root, state)
        nodes = elements(root)
        label = [marks.get(id(x), "rest") == "main" for x in nodes]
        inside = {id(x) for x, y in zip(nodes, label, strict=True) if y}
        for i in range(len(nodes) - 1, 0, -1):  # what holds main text is entered
            if id(nodes[i]) in inside and nodes[i].parent is not None:
                inside.add(id(nodes[i].parent))
        out.append((root, [id(x) in inside for x in nodes]))
    return out


@lru_cache(maxsize=1)
def trained() -> Trees:
    xs, ys = [], []
    for root, label in sample_pages():
        xs.append(features(elements(root)))
        ys.append(np.array(label, float))
    return boost(np.concatenate(xs), np.concatenate(ys))


def main_texts(pages: list[str], trees: Trees) -> list[str]:
    """The blocks of main text of each page, joined by line feeds."""
    roots = [parse(p) for p in pages]
    nodes = [elements(r) for r in roots]
    flat = [x for page in nodes for x in page]
    kept = decode(flat, trees(features(flat))) if flat else set()
    return ["\n".join(blocks(r, lambda x: id(x) in kept)) for r in roots]


def extracted(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html, ...).

    Null, blank and text-free pages give an empty text.  Pages of any length are read whole,
    long ones one at a time, in linear time; what a page holds in noscript and template elements
    is shown to no reader and left out; an element that is as likely kept as dropped is
    kept.  Repeated rows are read each for itself, null ids and urls stay null, other columns
    are ignored; an empty table gives an empty result.
    """
    model = trees or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "html", CHUNK_BYTES // 2):
            texts = main_texts([h or "" for h in b.column("html").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")
