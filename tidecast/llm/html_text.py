"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each element gets features: the text, link and tag density of its subtree, its
depth, its place and likeness among its siblings, its tag and the tokens of its
class, id and role. Boosted trees give the chance that its subtree holds main
text. Decoding is hierarchical: keeping a node takes keeping all above it, and of
all such choices the likeliest is taken, so that no kept node lies in a dropped one.

The trees are fitted here, on pages that `training_pages` makes from a seed with
known main text, in many layouts; no page of the input is needed for that.

Defined results: null, empty and text-free pages give an empty text. Malformed
markup is read leniently: unclosed elements end with their parent, a quote that is
never closed counts as a plain sign, and what follows the page's last > is text. The end of
a head is optional: text in it, but for its title, counts as text. svg, noscript and template
are dropped with all they hold and end with their parent at the latest; script, style, title,
textarea and iframe, and comments, run to the end of the page if they are never closed, as
HTML has it. None of these parts a block in two. Elements may lie at any depth. Time follows a
page's length, whatever its markup. A node as likely kept as dropped is kept. <br> is
white space in its block. Repeated rows repeat their result; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.common import slices, table

# HTML element names by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe title textarea".split())
HIDDEN = frozenset("noscript template svg".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
TAGS = "article main section div p nav header footer aside form ul ol li a button h1 h2 h3 h4 table tr td span b strong em blockquote pre code figure figcaption select label body".split()
TOKENS = "nav menu header head footer foot side sidebar aside ad ads advert banner promo sponsor cookie notice consent gdpr popup modal comment comments reply disqus form search login subscribe newsletter share social related recommend widget breadcrumb crumbs pagination pager tag tags meta copyright legal main article content post entry body story text page title wrap container column navigation contentinfo complementary".split()
_TAG_AT, _TOKEN_AT = {t: i for i, t in enumerate(TAGS)}, {t: i for i, t in enumerate(TOKENS)}

_OPENING = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_IN_TAG = re.compile(r">|=[ \t\r\n\f]*+([\"'])")
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def markup(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag in order, with '' for the name of comments
    and declarations. send(position) goes on from there, past the content of a raw element.
    Every character is looked at a bounded number of times: a quote that is never closed, or
    a tag that is never ended, is met once and known from then on."""
    at, last = 0, source.rfind(">")
    unclosed: set[str] = set()
    plain = False  # quotes no longer count
    while (m := _OPENING.search(source, at)) is not None:
        start = m.start()
        if m[1]:
            end = source.find("-->", m.end() - 2)
            at = len(source) if end < 0 else end + 3
            closing, name, attributes = False, "", ""
        elif start > last:
            return
        elif m[3] is None:
            at = source.find(">", start) + 1
            closing, name, attributes = False, "", ""
        else:
            # a run of name characters may hold what looks like further tags
            end, seek = -1, m.end()
            while not plain and (x := _IN_TAG.search(source, seek)) is not None:
                if x[1] is None:
                    end = x.start()
                    break
                seek = x.end()
                if x[1] not in unclosed:
                    close = source.find(x[1], seek)
                    if close < 0:
                        unclosed.add(x[1])
                    else:
                        seek = close + 1
            if end < 0:
                plain = True
                end = source.find(">", m.end())
                if end < 0:
                    return
            at, closing, name, attributes = end + 1, bool(m[2]), m[3].lower(), source[m.end() : end]
        skip = yield start, at, closing, name, attributes
        if skip is not None:
            at = skip
            yield start, at, False, "", ""


class Page:
    """Elements of a page in order (0: the root) and its text segments (node, block, text)."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.attributes, self.depth = ["body"], [-1], [""], [0]
        self.segments: list[tuple[int, int, str]] = []
        # open elements: their nodes, with no node in what is hidden, and their names
        stack, names, open_, block, at = [0], ["body"], Counter(), 0, 0

        def close(k: int) -> None:
            open_.subtract(names[k:])
            del stack[k:], names[k:]

        found = markup(source)
        for start, end, closing, name, attributes in found:
            if start > at and stack[-1] >= 0:
                self.segments.append((stack[-1], block, source[at:start]))
            at = end
            if not name:
                continue
            if name not in INLINE and name not in RAW and name not in HIDDEN and stack[-1] >= 0:
                block += 1
            if closing:
                if open_[name] > 0:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if names[k] == name))
                continue
            if name in ("html", "head", "body"):
                continue
            if name in RAW:
                if not attributes.rstrip().endswith("/"):
                    stop = re.compile(rf"</{name}\s*+>", re.I).search(source, at)
                    at = stop.end() if stop else len(source)
                    found.send(at)
                continue
            if name == "br" and stack[-1] >= 0:
                self.segments.append((stack[-1], block, " "))
            if name in VOID:
                continue
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1) if open_["p"] > 0 else ():
                    if names[k] == "p":
                        close(k)
                        break
                    if names[k] not in INLINE:
                        break
            elif name in SAME and any(open_[x] > 0 for x in ALIKE.get(name, (name,))):
                for k in range(len(stack) - 1, 0, -1):
                    if names[k] in SAME[name]:
                        break
                    if names[k] in ALIKE.get(name, (name,)):
                        close(k)
                        break
            node = -1
            if name not in HIDDEN and stack[-1] >= 0:
                node = len(self.tag)
                self.tag.append(name)
                self.parent.append(stack[-1])
                self.depth.append(self.depth[stack[-1]] + 1)
                self.attributes.append(attributes)
            if not attributes.endswith("/"):
                stack.append(node)
                names.append(name)
                open_[name] += 1
        if at < len(source) and stack[-1] >= 0:
            self.segments.append((stack[-1], block, source[at:]))

    def text(self, kept: np.ndarray) -> str:
        out, last = [], None
        for node, block, text in self.segments:
            if kept[node]:
                if block != last:
                    out.append([])
                    last = block
                out[-1].append(html.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text)
        blocks = (_SPACE.sub(" ", "".join(b)).strip() for b in out)
        return "\n".join(b for b in blocks if b)


class Forest:
    """The elements of several pages in one numbering, by depth."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = np.array([len(p.tag) for p in pages])
        self.first = np.cumsum(sizes) - sizes
        shift = np.repeat(self.first, sizes)
        own = np.concatenate([np.array(p.parent) for p in pages])
        self.root = own < 0
        self.parent = np.where(self.root, 0, own + shift)
        self.pages, self.size = pages, len(own)
        self.depth = np.concatenate([np.array(p.depth) for p in pages])
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1])[1:]

    def add_up(self, x: np.ndarray) -> np.ndarray:
        """Each node's sum over its subtree."""
        x = x.copy()
        for level in reversed(self.levels):
            np.add.at(x, self.parent[level], x[level])
        return x

    def features(self) -> np.ndarray:
        n, parent = self.size, self.parent
        tags = [t for p in self.pages for t in p.tag]
        code = np.fromiter((_TAG_AT.get(t, len(TAGS)) for t in tags), np.int64, n)
        link, path = np.isin(code, [_TAG_AT["a"], _TAG_AT["button"]]), np.zeros((n, len(TAGS) + 1), np.float32)
        kind = np.zeros((n, len(TAGS) + 1), np.float32)
        kind[np.arange(n), code] = 1
        token = np.zeros((n, len(TOKENS)), np.float32)
        named = [(self.first[i] + k, v) for i, p in enumerate(self.pages) for k, v in enumerate(p.attributes) if v]
        for node, text in named:
            for m in _ATTRIBUTE.finditer(text):
                for w in _WORD.findall(m[1] or m[2] or m[3] or ""):
                    if (k := _TOKEN_AT.get(w.lower())) is not None:
                        token[node, k] = 1
        for level in self.levels:
            up = parent[level]
            link[level] |= link[up]
            path[level] = np.maximum(path[up], kind[up])
            token[level] = np.maximum(token[level], token[up] * 0.5)  # what stands above counts less
        told = [(self.first[i] + node, len(t), t.count(" ") + 1, t.count(". ") + t.count(", ") + t.endswith(".")) for i, p in enumerate(self.pages) for node, _, t in p.segments]
        told = np.array(told, np.float64).reshape(-1, 4)
        at = told[:, 0].astype(np.int64)
        own = np.stack([*(np.bincount(at, told[:, k], n) for k in (1, 2, 3)), np.bincount(at, told[:, 1] * link[at], n), np.ones(n), np.isin(code, [_TAG_AT[t] for t in ("p", "li", "h1", "h2", "h3", "blockquote")]).astype(float)], 1)
        total = self.add_up(own)
        inner = np.flatnonzero(~self.root)
        up = parent[inner]
        children = np.bincount(up, minlength=n)
        order = np.argsort(up, kind="stable")
        begin = np.cumsum(children) - children
        place, alike = np.zeros(n), np.zeros(n)
        place[inner[order]] = np.arange(len(inner)) - begin[up[order]]
        _, same, count = np.unique(up * (len(TAGS) + 1) + code[inner], return_inverse=True, return_counts=True)
        alike[inner] = count[same] / children[up]
        chars, above = np.maximum(1, total[:, 0]), np.where(self.root, np.arange(n), parent)
        page = np.repeat(self.first, np.diff(np.append(self.first, n)))
        number = np.stack([np.log1p(total[:, 0]), np.log1p(own[:, 0]), total[:, 0] / chars[page], total[:, 0] / chars[above], total[:, 3] / chars, total[:, 2] / np.maximum(1, total[:, 1]), np.log1p(total[:, 0] / total[:, 4]), np.log1p(total[:, 4]), np.log1p(total[:, 5]), self.depth, place / np.maximum(1, children[above]), children[above], children, alike], 1)
        return np.hstack([number, kind[:, :-1], path[:, :-1], token]).astype(np.float32)

    def decode(self, chance: np.ndarray) -> list[np.ndarray]:
        """For each page, the likeliest choice of nodes in which all above a kept node are kept."""
        # words within a block go with the block
        inline = np.array([t in INLINE for p in self.pages for t in p.tag]) & ~self.root[self.parent]
        drop = self.add_up(np.where(inline, 0, np.log(np.maximum(1 - chance, 1e-6))))
        keep = np.where(inline, 0, np.log(np.maximum(chance, 1e-6)))
        for level in reversed(self.levels):
            np.add.at(keep, self.parent[level], np.where(inline[level], keep[level], np.maximum(drop[level], keep[level])))
        kept = self.root.copy()
        for level in self.levels:
            kept[level] = kept[self.parent[level]] & (inline[level] | (keep[level] >= drop[level]))
        return np.split(kept, self.first[1:])


class Boosted:
    """Trees of equal depth on binned features, fitted to log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24) -> None:
        self.depth, self.rate = depth, rate
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        z = np.full(len(y), self.base)
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                for f in range(x.shape[1]):
                    size = len(self.edges[f]) + 1
                    if size < 2:
                        continue
                    key = (node - first) * size + binned[:, f]
                    gs, hs = (np.bincount(key, w, width * size).reshape(width, size).cumsum(1) for w in (g, h))
                    left_g, left_h = gs[:, :-1], hs[:, :-1]
                    right_g, right_h = gs[:, -1:] - left_g, hs[:, -1:] - left_h
                    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    gain[(left_h < 2) | (right_h < 2)] = 0
                    at = gain.argmax(1)
                    better = np.flatnonzero(gain[np.arange(width), at] > best)
                    best[better] = gain[better, at[better]]
                    feature[first + better], cut[first + better] = f, self.edges[f][at[better]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] >= cut[node])
            leaf = node - (2**depth - 1)
            value = np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            z += rate * value[leaf]
            self.feature.append(feature)
            self.cut.append(cut.astype(np.float32))
            self.leaf.append(value)

    def chance(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            z += self.rate * leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-z))


MARK = "⁣"  # in training pages, stands in every block of main text


def training_pages(count: int = 400, seed: int = 11) -> list[str]:
    """Pages of many layouts; blocks of main text begin with MARK."""
    r = random.Random(seed)
    syllables = "ka lo mi ren tus ver al or ine ta shu pel gra non est".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(1, 18).capitalize() + r.choice(". . , ! ?".split()) for _ in range(r.randint(a, b)))

    def name(*options: str) -> str:
        pick = r.choice(options)
        return r.choice(["", "", "site-", "c-", "x_", "page-"]) + pick + r.choice(["", "", "-box", "-inner", "_area", "-1"])

    def wrap(tag: str, inner: str, *names: str) -> str:
        how = r.random()
        if tag != "div" and how < 0.4:
            return f"<{tag}>{inner}</{tag}>"
        own = f"{r.choice(['class', 'id', 'class'])}=\"{name(*names)}\""
        return f"<{tag if how < 0.7 else 'div'} {own}>{inner}</{tag if how < 0.7 else 'div'}>"

    def links(a: int, b: int) -> str:
        each = [f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(r.randint(a, b))]
        return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>", " | ".join(each), "".join(f"<div>{x}</div>" for x in each)])

    def aside() -> str:
        return r.choice([
            lambda: wrap("div", sentences(1, 3) if r.random() < 0.7 else f'<a href="/x">{words(2, 9)}</a>', "ad", "ads", "advert", "banner", "promo", "sponsor"),
            lambda: wrap("aside", f"<h3>{words(1, 3)}</h3>" + links(2, 7) + (f"<p>{sentences(1, 2)}</p>" if r.random() < 0.5 else ""), "sidebar", "side", "widget", "related", "recommend"),
            lambda: wrap("div", f"<p>{sentences(1, 3)}</p><button>{words(1, 2)}</button>", "cookie-notice", "cookie", "consent", "gdpr", "notice", "popup", "modal"),
            lambda: wrap("form", f"<label>{words(1, 4)}</label><input name=q><p>{sentences(1, 1)}</p><button>{words(1, 2)}</button>", "form", "search", "newsletter", "subscribe", "login"),
            lambda: wrap("div", f"<a>{words(1, 1)}</a> <a>{words(1, 1)}</a>", "share", "social"),
        ])()

    def comments() -> str:
        one = [wrap("div", f"<b>{words(1, 2)}</b> <p>{sentences(1, 5)}</p>" + r.choice(["", "<a href=#>reply</a>"]), "comment", "reply", "comment-body") for _ in range(r.randint(1, 6))]
        return wrap("section", f"<h2>{words(1, 2)}</h2>" + "".join(one), "comments", "disqus", "comment-list")

    def block() -> str:
        x = MARK + sentences(1, 7)
        how = r.random()
        if how < 0.62:
            inner = r.choice(["", "", "", f" <a href=/y>{words(1, 3)}</a>", f" <em>{words(1, 3)}</em>", f"<br>{sentences(1, 2)}", f" <b>{words(1, 2)}</b>"])
            return r.choice([f"<p>{x}{inner}</p>", f"<p>{x}{inner}</p>", f"<p>{x}{inner}", f"<p><b>{x}<br>", f"<div>{x}{inner}</div>"])
        if how < 0.74:
            tag = r.choice(["h2", "h3", "h4"])
            return f"<{tag}>{MARK}{words(2, 7)}</{tag}>"
        if how < 0.84:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{MARK}{words(2, 14)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"
        if how < 0.91:
            return f"<blockquote><p>{x}</p></blockquote>"
        if how < 0.95:
            return "<table>" + "".join(f"<tr><td>{MARK}{words(1, 4)}</td><td>{MARK}{words(1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        return r.choice([f"<pre>{MARK}{words(3, 30)}</pre>", f"<figure><img src=x><figcaption>{MARK}{words(3, 9)}</figcaption></figure>"])

    out = []
    for _ in range(count):
        blocks = [block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13, 20]))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), aside())
        title = f"<h1>{MARK}{words(2, 9)}</h1>" if r.random() < 0.85 else ""
        body = title + "".join(blocks)
        main = r.choice([lambda: f"<article>{body}</article>", lambda: f"<article>{body}</article>", lambda: f"<main>{body}</main>", lambda: f"<main><article>{body}</article></main>", lambda: f'<div class="{name("content", "article", "post", "entry", "story", "main", "text")}">{body}</div>', lambda: f'<div class="{name("wrap", "container", "column")}"><div id="{name("content", "main", "article-body", "post-content")}">{body}</div></div>', lambda: f"<div><div>{body}</div></div>"])()
        before, after = [], []
        if r.random() < 0.85:
            before.append(wrap("nav", links(3, 9), "nav", "menu", "navigation"))
        if r.random() < 0.5:
            before.insert(0, wrap("header", f"<a href=/>{words(1, 3)}</a>" + (f"<p>{sentences(1, 1)}</p>" if r.random() < 0.5 else "") + (links(2, 6) if r.random() < 0.4 else ""), "header", "head", "banner"))
        if r.random() < 0.25:
            before.append(wrap("div", " &gt; ".join(words(1, 2) for _ in range(3)), "breadcrumb", "crumbs"))
        for _ in range(r.choice([0, 1, 1, 2])):
            (before if r.random() < 0.5 else after).append(aside())
        if r.random() < 0.35:
            after.append(comments())
        if r.random() < 0.85:
            after.append(wrap("footer", f"&copy; {words(1, 3)} &middot; {sentences(1, 1)}" + (links(2, 6) if r.random() < 0.5 else ""), "footer", "foot", "copyright", "legal"))
        page = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            page = f'<div class="{name("wrap", "container", "page")}">{page}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>")
    return out


@lru_cache(1)
def fitted() -> Boosted:
    sources = training_pages()
    held = []
    for page in map(Page, sources):
        own = np.zeros(len(page.tag))
        for node, _, text in page.segments:
            own[node] += text.count(MARK)
        held.append(own)
    forest = Forest([Page(s.replace(MARK, "")) for s in sources])
    inner = ~forest.root
    return Boosted(forest.features()[inner], (forest.add_up(np.concatenate(held)) > 0)[inner].astype(float))


def main_texts(sources: list[str], model: Boosted) -> list[str]:
    if not sources:
        return []
    forest = Forest([Page(s) for s in sources])
    kept = forest.decode(model.chance(forest.features()))
    return [p.text(k) for p, k in zip(forest.pages, kept, strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars). The trees are broadcast: their size is fixed."""
    held = pages.sparkSession.sparkContext.broadcast(fitted())

    def run(batches):
        for batch, sources in slices(batches, "html", 2_000_000):
            texts = main_texts([s.decode("utf-8", "replace") for s in sources], held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
