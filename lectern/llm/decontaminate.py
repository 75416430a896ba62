"""Benchmark decontamination: documents stream through a generalised suffix automaton of the benchmark items.

The automaton holds every run of words of every item; each document word moves it on and gives the longest run that ends
there. Where that run is as long as a window, the state that stands for the last window's words names the items. An item
shorter than a window is one window itself. Words outside the items' pairs of neighbours reset the automaton, so only
stretches of neighbouring item words are streamed, and those shorter than the shortest window not at all.

Items are taken in blocks of at most `BLOCK_WORDS` words, each with an automaton of its own, so an automaton's size is
bounded whatever the benchmark's; a document passes one after the other without a shuffle. Texts without words, null
texts and items without words hit nothing. An item without an id hits words like any other; only the list of ids leaves
it out. Repeated rows are each judged; extra columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import checkpoint, plain, restored, shielded, text_chunks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WINDOW, BLOCK_WORDS = 13, 100_000


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER) if not text.isascii() else text.lower())


class Automaton:
    """Suffix automaton over several word sequences; marks the states of windows with the items that hold them."""

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(name, [self.ids.setdefault(w, len(self.ids) + 1) for w in seq]) for name, seq in items if seq]
        for _, seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        sizes = {min(window, len(seq)) for _, seq in sequences}
        self.sizes = sorted(sizes)
        self.shortest = self.sizes[0] if sizes else 0
        pairs = {(a << 32) | b for _, seq in sequences for a, b in zip(seq, seq[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        tops = {size: self._tops(size, by_length) for size in sizes}
        windows: dict[tuple[int, int], int] = {}
        self.names: list[set[str]] = []
        for name, seq in sequences:
            size, state, run = min(window, len(seq)), 0, 0
            for c in seq:
                state, run = self.step(state, run, c)
                if run >= size:
                    at = windows.setdefault((tops[size][state], size), len(windows))
                    if at == len(self.names):
                        self.names.append(set())
                    if name is not None:
                        self.names[at].add(name)
        # Per state, the windows that end where its runs end, shortest first: those of its link, then its own.
        self.hits: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        own: dict[int, list[tuple[int, int]]] = {}
        for (state, size), at in sorted(windows.items(), key=lambda w: w[0][1]):
            own.setdefault(state, []).append((size, at))
        for state in by_length:
            self.hits[state] = self.hits[self.link[state]] + tuple(own.get(state, ()))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def step(self, state: int, run: int, c: int) -> tuple[int, int]:
        while c not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            run = self.length[state]
        return self.next[state][c], run + 1

    def _tops(self, size: int, by_length: list[int]) -> list[int]:
        """Per state, the state of the last `size` words of its runs; links are shorter, so one pass settles all."""
        top = [0] * len(self.next)
        for state in by_length:
            link = self.link[state]
            top[state] = top[link] if self.length[link] >= size else state
        return top

    def scan(self, seq: list[str]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurring window, and the items whose windows occur."""
        hit, found = np.zeros(len(seq), dtype=bool), set()
        seen: set[int] = set()
        if not self.shortest or len(seq) < self.shortest:
            return hit, found
        get = self.ids.get
        codes = np.array([get(w, 0) for w in seq], dtype=np.int64)
        for start, stop in self.stretches(codes):
            state = run = 0
            for at, c in enumerate(codes[start:stop].tolist(), start):
                state, run = self.step(state, run, c)
                for size, window in self.hits[state]:
                    if size > run:
                        break
                    seen.add(window)
                    hit[at + 1 - size : at + 1] = True
        return hit, found.union(*(self.names[w] for w in seen))

    def stretches(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of item words whose neighbours are also neighbours in some item, long enough for a window."""
        inside = codes > 0
        joined = np.zeros(len(codes), dtype=bool)
        if len(self.pairs):
            pair = (codes[:-1] << 32) | codes[1:]
            place = np.searchsorted(self.pairs, pair)
            joined[1:] = self.pairs[np.minimum(place, len(self.pairs) - 1)] == pair
        starts = np.flatnonzero(inside & ~joined)
        ends = np.flatnonzero(inside & ~np.append(joined[1:], False)) + 1
        long = ends - starts >= self.shortest
        return zip(starts[long].tolist(), ends[long].tolist(), strict=True)


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """Items in blocks of bounded size, one block on the driver at a time; an item longer than a block is alone in one."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string"), text)
    block, size = [], 0
    for name, body in rows.distinct().toLocalIterator():
        seq = words(body)
        if block and size + len(seq) > block_words:
            yield block
            block, size = [], 0
        block.append((name, seq))
        size += len(seq)
    if block:
        yield block


SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))


@shielded("text")
def find(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with `n_words`, `hit_spans` (word positions, end excluded) and `item_ids` (strings in order)."""
    kept = [c for c in docs.columns if c not in ("n_words", "hit_spans", "item_ids")]
    out = docs.select(
        *[docs[c] for c in kept],
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(SPANS).alias("hit_spans"),
        F.array().cast("array<string>").alias("item_ids"),
    )
    n = 0
    for block in item_blocks(items, item_id, text, block_words):
        out = _pass(out, Automaton(block, window), text)
        n += 1
        if n % 8 == 0:
            out = checkpoint(out)
    return out if n else _pass(out, Automaton([], window), text)


def _pass(docs: DataFrame, automaton: Automaton, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    before, docs = docs.schema, plain(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            for part in text_chunks(frame, text):
                counts, spans, names = [], [], []
                for body, before, known in zip(part[text], part["hit_spans"], part["item_ids"], strict=True):
                    seq = words(body) if isinstance(body, str) else []
                    hit, found = own.scan(seq)
                    for a, b in before:
                        hit[a:b] = True
                    counts.append(str(len(seq)))
                    spans.append(_spans(hit))
                    names.append(sorted({*known, *found}))
                yield part.assign(n_words=counts, hit_spans=spans, item_ids=names)

    return restored(docs.mapInPandas(run, docs.schema), before)


def _spans(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def contaminated(share: int = 20) -> Column:
    """Coverage limit: some word is hit, and at least one in `share`."""
    return (n_hit() > 0) & (n_hit() * share >= F.col("n_words"))


def remove_spans(docs: DataFrame, text: str = "text", min_words: int = WINDOW) -> DataFrame:
    """`docs` from `find` without the text of hit spans of at least `min_words` words; documents over the coverage limit go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{text: [_without(t, s, min_words) for t, s in zip(frame[text], frame["hit_spans"], strict=True)]})

    clean = plain(docs.where(~contaminated()))
    return restored(clean.mapInPandas(run, clean.schema), docs.schema)


def _without(body: str | None, spans: list[list[int]], min_words: int) -> str | None:
    long = [(a, b) for a, b in spans if b - a >= min_words]
    if not isinstance(body, str) or not long:
        return body
    places = [m.span() for m in WORD.finditer(body.translate(LOWER))]
    parts, at = [], 0
    for a, b in long:
        parts.append(body[at : places[a][0]])
        at = places[b - 1][1]
    return "".join(parts) + body[at:]


def item_digest() -> Column:
    return F.sha2(F.array_join("item_ids", ","), 256)


