"""Main text of web pages by a tree-structured graphical model over the elements.

Every element that is not inline is a node with two states, main text or not. A node's own evidence is a weighted sum of
features (tag, words of class and id, text and link shares, place); parent and child share a potential for each pair of
states, by kind of child. Sum-product messages up and down the tree give the exact marginal of every node, and a piece
of text is kept where the marginal of its element is at least one half. Weights are learned in numpy by maximum
likelihood (observed minus expected features) from the labelled pages of `html_examples` and a bounded sample of the
pages at hand, labelled by their own `article` or `main` element.

Text of scripts, heads and other unseen elements is left out. Where such an element is not closed, a head ends at the
first tag or text that cannot stand in it, svg and math at the first HTML element, and all at the end tag of an element
around them.

Pages pass whole and one by one, so a long page is only as much memory as it has text. A null or empty page gives an
empty text; repeated rows give equal texts; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import html_examples
from lectern.llm.common import plain, restored, shielded, text_chunks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template noscript iframe object svg math canvas audio video".split())
#: What may stand in a head; anything else ends it.
HEAD = frozenset("head html base basefont bgsound link meta title style script noscript noframes template".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements inside of those two that hold HTML again (the parser gives names in lower case).
HOSTS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: An opening tag ends an open element of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such an end does not reach across.
WALLS = frozenset("ul ol dl table select".split())
TAGS = "root html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody thead blockquote pre figure figcaption nav aside header footer form fieldset button textarea select option address details summary".split()
TAG = {t: i for i, t in enumerate(TAGS)}
OFF = frozenset("nav aside header footer form".split())
BINS, NUMBERS, KINDS = 8192, 7, 4
#: Characters above which the length of a text says no more about it.
LONG = 1000


@dataclass
class Page:
    """Elements in page order; `parts` are pieces of text in page order, each with its element."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["root"])
    marks: list[list[str]] = field(default_factory=lambda: [[]])
    label: list[int | None] = field(default_factory=lambda: [0])
    links: list[int] = field(default_factory=lambda: [0])
    parts: list[tuple[int, str]] = field(default_factory=list)


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.open = Page(), [("root", 0)]
        self.text: list[str] = []
        self.links = 0
        #: The unseen element that is open and what is open inside it.
        self.unseen: list[str] = []

    def flush(self) -> None:
        if self.text:
            body = " ".join("".join(self.text).split())
            if body:
                self.page.parts.append((self.open[-1][1], body))
            self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.unseen and self.shut_out(tag):
            self.unseen = []
        if self.unseen:
            if tag not in VOID:
                self.unseen.append(tag)
            return
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in UNSEEN:
            self.unseen = [tag]
            return
        if tag in INLINE:
            self.links += tag == "a"
            self.open.append((tag, self.open[-1][1]))
            return
        self.flush()
        self.end_implied(tag)
        page, above = self.page, self.open[-1][1]
        given = dict(attrs)
        page.parent.append(above)
        page.depth.append(page.depth[above] + 1)
        page.tag.append(tag)
        page.marks.append(re.findall("[a-z]+", f"{given.get('class') or ''} {given.get('id') or ''} {given.get('role') or ''}".lower()))
        page.label.append(1 if "data-main" in given else 0 if "data-off" in given else None)
        page.links.append(0)
        self.open.append((tag, len(page.tag) - 1))

    def shut_out(self, tag: str) -> bool:
        """Whether a tag cannot stand in the unseen element that is open, which then ends: its own end tag was left out."""
        if self.unseen[0] == "head":
            return tag == "body" or (len(self.unseen) == 1 and tag not in HEAD)
        return self.unseen[0] in FOREIGN and tag in TAG and HOSTS.isdisjoint(self.unseen)

    def ends_above(self, tag: str) -> bool:
        """Whether an end tag belongs to an element that the unseen one lies in."""
        for name, at in reversed(self.open):
            if name == tag:
                return at > 0 or tag in INLINE
            if tag in INLINE and name not in INLINE:
                return False
        return False

    def end_implied(self, tag: str) -> None:
        ends = ENDS.get(tag, ())
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name == "p" or name in ends:
                self.cut(at)
                if name != "p":
                    return
            elif name not in INLINE and (name in WALLS or not ends):
                return

    def cut(self, at: int) -> None:
        for name, _ in self.open[at:]:
            self.links -= name == "a"
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag in self.unseen:
                del self.unseen[len(self.unseen) - 1 - self.unseen[::-1].index(tag) :]
                return
            if not self.ends_above(tag):
                return
            self.unseen = []
        if tag in VOID:
            return
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name == tag:
                if tag not in INLINE:
                    self.flush()
                self.cut(at)
                return
            if tag in INLINE and name not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.unseen == ["head"] and data.strip():
            self.unseen = []
        if not self.unseen:
            self.text.append(data)
            if self.links > 0:
                self.page.links[self.open[-1][1]] += len(data)


def parse(html: str | None) -> Page:
    reader = Reader()
    if html:
        reader.feed(html)
        reader.close()
        reader.flush()
    return reader.page


def own_labels(page: Page) -> list[int]:
    """Marks handed down the tree; without any mark, the page's `article` (or else `main`) without the parts in `OFF`."""
    if any(x == 1 for x in page.label):
        out: list[int] = []
        for above, mark in zip(page.parent, page.label, strict=True):
            out.append(mark if mark is not None else out[above])
        return out
    name = "article" if "article" in page.tag else "main"
    out = []
    for above, tag in zip(page.parent, page.tag, strict=True):
        up = out[above] if above >= 0 else 0
        out.append(0 if tag in OFF else 1 if tag == name else up)
    return out


def bin_of(word: str) -> int:
    h = 0
    for c in word:
        h = (h * 131 + ord(c)) & 0xFFFFFFFF
    return (h ^ (h >> 13)) % BINS


@dataclass
class Forest:
    """All elements of several pages, parents before children."""

    parent: np.ndarray
    levels: list[np.ndarray]
    tag: np.ndarray
    kind: np.ndarray
    numbers: np.ndarray
    bin_node: np.ndarray
    bin_at: np.ndarray
    first: list[int]


def forest(pages: list[Page]) -> Forest:
    parent, depth, tag, numbers, bin_node, bin_at, first = [], [], [], [], [], [], []
    for page in pages:
        base, n = len(parent), len(page.tag)
        first.append(base)
        own, marks, before, total = [0] * n, [0] * n, [0] * n, 0
        seen = [False] * n
        for node, body in page.parts:
            if not seen[node]:
                seen[node], before[node] = True, total
            own[node] += len(body)
            marks[node] += body.count(".") + body.count(",")
            total += len(body)
        below = own[:]
        for i in range(n - 1, 0, -1):
            below[page.parent[i]] += below[i]
        parent += [p + base if p >= 0 else -1 for p in page.parent]
        depth += page.depth
        tag += [TAG.get(t, len(TAGS)) for t in page.tag]
        for i in range(n):
            mine = own[i]
            numbers.append((1, np.log1p(min(mine, LONG)) / 5, np.log1p(min(below[i], 4 * LONG)) / 8, page.links[i] / (mine + 1), min(marks[i] / (mine + 1) * 20, 2), mine == 0, before[i] / (total + 1)))
            for word in page.marks[i]:
                bin_node.append(base + i)
                bin_at.append(bin_of(word))
    depths, tags = np.array(depth, dtype=np.int64), np.array(tag, dtype=np.int64)
    order = np.argsort(depths, kind="stable")
    levels = np.split(order, np.searchsorted(depths[order], np.arange(1, depths.max(initial=0) + 1)))
    kind = KIND_OF[tags]
    return Forest(np.array(parent), levels, tags, kind, np.array(numbers, dtype=np.float64), np.array(bin_node, dtype=np.int64), np.array(bin_at, dtype=np.int64), first)


KIND_OF = np.array([1 if t in ("article", "main", "section", "div", "body", "html") else 2 if t in OFF else 0 if t in TAG else 3 for t in [*TAGS, "other"]])


@dataclass
class Weights:
    tag: np.ndarray
    word: np.ndarray
    number: np.ndarray
    edge: np.ndarray  # kind of child, state of parent, state of child

    def evidence(self, f: Forest) -> np.ndarray:
        words = np.bincount(f.bin_node, self.word[f.bin_at], minlength=len(f.tag)) if len(f.bin_node) else 0
        return self.tag[f.tag] + f.numbers @ self.number + words


def _both(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(x.take(0, axis=axis), x.take(1, axis=axis))


def marginals(f: Forest, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Probability of main text for each node, and of each pair of states for each node and its parent (roots: zeros)."""
    n = len(f.tag)
    below = np.zeros((n, 2))
    below[:, 1] = w.evidence(f)
    up = np.zeros((n, 2))  # message to the parent, by the parent's state
    for level in reversed(f.levels[1:]):
        up[level] = _both(w.edge[f.kind[level]] + below[level][:, None, :], 2)
        for state in (0, 1):
            below[:, state] += np.bincount(f.parent[level], up[level, state], minlength=n) if len(level) > 64 else 0
        if len(level) <= 64:
            np.add.at(below, f.parent[level], up[level])
    belief, pair = below.copy(), np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        above = belief[f.parent[level]] - up[level]
        joint = above[:, :, None] + w.edge[f.kind[level]] + below[level][:, None, :]
        belief[level] = _both(joint, 1)
        joint -= np.logaddexp(belief[level][:, 0], belief[level][:, 1])[:, None, None]
        pair[level] = np.exp(joint)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


def fit(pages: list[Page], labels: list[list[int]], weight: list[float], rounds: int = 400, rate: float = 0.1) -> Weights:
    f = forest(pages)
    y = np.array([x for page in labels for x in page], dtype=np.int64)
    share = np.repeat(np.array(weight), [len(x) for x in labels])
    child = np.flatnonzero(f.parent >= 0)
    w = Weights(np.zeros(len(TAGS) + 1), np.zeros(BINS), np.zeros(NUMBERS), np.zeros((KINDS, 2, 2)))
    params = [w.tag, w.word, w.number, w.edge]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), share[child])
    total = share.sum()
    for step in range(1, rounds + 1):
        p, pair = marginals(f, w)
        miss = (y - p) * share
        edge = seen.copy()
        for k in range(KINDS):
            at = child[f.kind[child] == k]
            edge[k] -= (pair[at] * share[at][:, None, None]).sum(axis=0)
        grads = [
            np.bincount(f.tag, miss, minlength=len(w.tag)),
            np.bincount(f.bin_at, miss[f.bin_node], minlength=BINS) if len(f.bin_at) else np.zeros(BINS),
            f.numbers.T @ miss,
            edge,
        ]
        for i, (x, g) in enumerate(zip(params, grads, strict=True)):
            g = g / total - 3e-5 * x
            one[i] = 0.9 * one[i] + 0.1 * g
            two[i] = 0.99 * two[i] + 0.01 * g * g
            x += rate * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.99**step)) + 1e-8)
    return w


def train(pages: DataFrame, html: str = "html", sample: int = 300) -> Weights:
    """Learn from the examples and from at most `sample` pages, those with the lowest hash that mark an article or main.

    Pages over 100,000 characters are not learned from. The two sources weigh the same.
    """
    h = F.xxhash64(html)
    marked = F.col(html).rlike("(?i)<(?:article|main)[\\s>]") & (F.length(html) <= 100_000)
    marks = pages.where(marked).select(html, h.alias("_h"))
    # The hashes are chosen first, so that tasks send numbers and not pages to be compared.
    top = marks.select("_h").distinct().orderBy("_h").limit(sample).agg(F.max("_h")).head()[0]
    rows = marks.where(F.col("_h") <= F.lit(top)).groupBy("_h").agg(F.min(html).alias(html)).orderBy("_h").toPandas()
    known, found = [parse(p) for p in html_examples.pages()], [parse(t) for t in rows[html]]
    own = [own_labels(p) for p in known + found]
    nodes = [len(x) for x in own]
    mine, theirs = sum(nodes[: len(known)]), sum(nodes[len(known) :])
    weight = [1.0] * len(known) + [mine / theirs if theirs else 0.0] * len(found)
    return fit(known + found, own, weight)


def main_texts(pages: list[str | None], w: Weights) -> list[str]:
    parsed = [parse(p) for p in pages]
    f = forest(parsed)
    p, _ = marginals(f, w)
    return ["\n".join(body for node, body in page.parts if p[base + node] >= 0.5) for page, base in zip(parsed, f.first, strict=True)]


@shielded("html", "text")
def extract(pages: DataFrame, w: Weights, html: str = "html", text: str = "text") -> DataFrame:
    """`pages` without `html` and with its main text."""
    kept = [c for c in pages.columns if c not in (html, text)]
    before = pages.select(*kept).schema
    pages = plain(pages.select(*kept, F.col(html).alias("_html")))
    schema = T.StructType([pages.schema[c] for c in kept]).add(text, T.StringType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in text_chunks(frame, "_html"):
                bodies = [t if isinstance(t, str) else None for t in part["_html"]]
                yield part.drop(columns="_html").assign(**{text: main_texts(bodies, w)})

    return restored(pages.mapInPandas(run, schema), before)
