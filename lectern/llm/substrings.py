"""Exact substring dedup by difference-cover anchors.

A position is a cover position if its number modulo `PERIOD` is in `COVER`. For any two positions there is a shift below
`PERIOD` that takes both to cover positions, so any two equal windows of at least `PERIOD - 1 + ANCHOR` words hold equal
runs of `ANCHOR` words that start at cover positions in both. Only those runs are hashed and shuffled. A run that occurs
once cannot lie in a repeated window; windows with a run that occurs again are extended to their full length, and equal
windows are resolved by a hash of all their words: every window but the first of its kind is a repeat.

The first is the smallest (id, text hash, position). Rows with equal id and text are one document and get equal results;
null ids come first. Null texts have no words, texts shorter than a window keep all of theirs. Within a task equal runs
and equal windows are reduced to the first before anything is shuffled, so copies and very frequent passages cost no
more than one row a task; a document travels as one row of packed numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import checkpoint, mix64, plain, release, restored, shielded, text_chunks

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
PERIOD, COVER = 13, (0, 1, 3, 9)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters of text that are resolved together, and that a bucket of hashes answers for.
GROUP_CHARS, BUCKET_CHARS = 8_000_000, 20_000_000
CHECK = np.uint64(0xD6E8FEB86659FD93)
NULL_ID = np.iinfo(np.int64).min


class Hasher:
    """64-bit hashes of words, remembered for as many words as fit."""

    def __init__(self) -> None:
        import xxhash

        self.known: dict[str, int] = {}
        self.digest = xxhash.xxh3_64_intdigest

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        known, digest = self.known, self.digest
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.array([known[w] for w in words], dtype=np.uint64)


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` values from each place; the last places, with fewer left, are cut off."""
    with np.errstate(over="ignore"):
        power, block, size, out, done, rest = BASE, h, 1, None, 0, length
        while rest:
            if rest & 1:
                out = block if out is None else out[: len(block) - done] * power + block[done:] if len(block) > done else out[:0]
                done += size
            rest >>= 1
            if rest:
                block = block[: max(0, len(block) - size)] * power + block[size:]
                power, size = power * power, size * 2
        return mix64(out[: max(0, len(h) - length + 1)])


class Words:
    """Word hashes of several documents, one after the other."""

    def __init__(self, texts: list[str], hasher: Hasher) -> None:
        cut = [WORD.findall(t) for t in texts]
        self.sizes = np.array([len(c) for c in cut], dtype=np.int64)
        self.h = hasher([w for c in cut for w in c])
        ends = np.cumsum(self.sizes)
        self.doc = np.repeat(np.arange(len(cut)), self.sizes)
        self.at = np.arange(len(self.h)) - (ends - self.sizes)[self.doc]

    def whole(self, length: int) -> np.ndarray:
        """Places from which `length` words of one document follow."""
        return np.flatnonzero(self.at + length <= self.sizes[self.doc])

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        where = self.whole(length)
        where = where[np.isin(self.at[where] % PERIOD, COVER)]
        return where, runs(self.h, length)[where]


def packed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def grouped(docs: DataFrame, key: str, text: str, groups: int, *columns: str) -> DataFrame:
    """Documents with a hash of their text and the number of the group they are resolved in."""
    th = F.xxhash64(text)
    number = F.pmod(F.xxhash64(F.col(key).cast("string"), th), F.lit(groups)).cast("int")
    return docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_ID)).alias("_id"), th.alias("_th"), F.coalesce(text, F.lit("")).alias("_text"), number.alias("_g"), *columns)


def live_anchors(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """`_g` and packed hashes: the anchors of the group that occur again, there or in another group."""
    length = window - PERIOD + 1

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for frame in frames:
            for part in text_chunks(frame, "_text"):
                rows = []
                for g, own in part.groupby("_g"):
                    _, h = Words(own["_text"].tolist(), hasher).anchors(length)
                    h, n = np.unique(h, return_counts=True)
                    for b, at in by_bucket(h % np.uint64(buckets)):
                        one = n[at] == 1
                        rows.append((b, g, h[at[one]].tobytes(), h[at[~one]].tobytes()))
                if rows:
                    yield packed(rows, ["_b", "_g", "once", "more"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        once = [np.frombuffer(x, dtype=np.uint64) for x in frame["once"]]
        more = [np.frombuffer(x, dtype=np.uint64) for x in frame["more"]]
        h, n = np.unique(np.concatenate([*once, *more, *more]), return_counts=True)
        again = h[n > 1]
        rows = []
        for g, a, b in zip(frame["_g"], once, more, strict=True):
            live = np.concatenate([a[_in(a, again)], b])
            if len(live):
                rows.append((g, live.tobytes()))
        return packed(rows, ["_g", "live"])

    sent = docs.select("_text", "_g").repartition("_g").mapInPandas(emit, "_b bigint, _g int, once binary, more binary")
    return sent.groupBy("_b").applyInPandas(answer, "_g int, live binary")


def _in(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), dtype=bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def candidate_windows(words: Words, live: np.ndarray, window: int) -> np.ndarray:
    """Places whose window holds a live anchor at a shift below the period."""
    where, h = words.anchors(window - PERIOD + 1)
    where = where[_in(h, live)]
    near = np.zeros(len(words.h) + 1, dtype=np.int64)
    np.add.at(near, np.maximum(where - PERIOD + 1, 0), 1)
    np.add.at(near, where + 1, -1)
    near = np.cumsum(near)[:-1] > 0
    places = words.whole(window)
    # An anchor may also mark places of the document before; those are then judged like any other.
    return places[near[places]]


def repeats(docs: DataFrame, live: DataFrame, window: int, buckets: int) -> DataFrame:
    """`_g` and packed (id, text hash, position) of the windows that are not the first of their kind."""
    names = ["_b", "_g", "h", "c", "id", "th", "at"]

    def emit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in right["live"]] or [np.empty(0, np.uint64)]))
        if not len(known) or not len(left):
            return packed([], names).astype({"_b": "int64", "_g": "int32"})
        g = int(left["_g"].iloc[0])
        left = left.sort_values(["_id", "_th"], kind="stable")
        words = Words(left["_text"].tolist(), Hasher())
        places = candidate_windows(words, known, window)
        h = runs(words.h, window)[places]
        with np.errstate(over="ignore"):
            c = (runs(words.h ^ CHECK, window)[places] >> np.uint64(32)).astype(np.uint32)
        ids, ths = left["_id"].to_numpy()[words.doc[places]], left["_th"].to_numpy()[words.doc[places]]
        at = words.at[places].astype(np.int32)
        order = np.lexsort((np.arange(len(h)), c, h))  # places are in order of id, text hash and position
        h, c, ids, ths, at = h[order], c[order], ids[order], ths[order], at[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        other = ~first & ((ids != ids[head]) | (ths != ths[head]) | (at != at[head]))
        rows = [(-1 - g, g, b"", b"", *_columns(ids, ths, at, np.flatnonzero(other)))] if other.any() else []
        own = np.flatnonzero(first)
        for b, part in by_bucket(h[own] % np.uint64(buckets)):
            part = own[part]
            rows.append((b, g, h[part].tobytes(), c[part].tobytes(), *(x[part].tobytes() for x in (ids, ths, at))))
        return packed(rows, names)

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["_b"].iloc[0] < 0:
            return frame[["_g", "id", "th", "at"]]
        take = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in frame[name]])
        h, c, ids, ths, at = take("h", np.uint64), take("c", np.uint32), take("id", np.int64), take("th", np.int64), take("at", np.int32)
        g = np.repeat(frame["_g"].to_numpy(), [len(x) // 8 for x in frame["h"]])
        order = np.lexsort((at, ths, ids, c, h))
        h, c, ids, ths, at, g = h[order], c[order], ids[order], ths[order], at[order], g[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        other = np.flatnonzero((ids != ids[head]) | (ths != ths[head]) | (at != at[head]))
        rows = [(n, *_columns(ids, ths, at, other[part])) for n, part in by_bucket(g[other])]
        return packed(rows, ["_g", "id", "th", "at"])

    schema = "_b bigint, _g int, h binary, c binary, id binary, th binary, at binary"
    sent = docs.select("_id", "_th", "_text", "_g").groupBy("_g").cogroup(live.groupBy("_g")).applyInPandas(emit, schema)
    return sent.groupBy("_b").applyInPandas(answer, "_g int, id binary, th binary, at binary")


def _columns(ids: np.ndarray, ths: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """In order of document and position, which packs well."""
    which = which[np.lexsort((at[which], ths[which], ids[which]))]
    return ids[which].tobytes(), ths[which].tobytes(), at[which].tobytes()


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n_words), -1)
    return np.cumsum(edge)[:-1] > 0


@shielded("key", "text")
def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """`docs` with the words of repeated windows taken out of `text`, and `n_words` and `n_removed`.

    A text that loses words keeps the others joined by one space; so does the text of every other row, whose words stay.
    """
    if window < PERIOD:
        raise ValueError(f"windows of at least {PERIOD} words are needed")
    spark = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).head()[0]
    groups, buckets = -(-chars // GROUP_CHARS) + 1, -(-chars // BUCKET_CHARS) + 1
    own = grouped(docs, key, text, groups)
    live = checkpoint(live_anchors(own, window, buckets))
    release(spark)
    again = checkpoint(repeats(own, live, window, buckets))
    release(spark)
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    before = docs.select(*kept).schema
    given = plain(docs.select(*kept))
    # The text travels once, as the column that is given back.
    rows = grouped(given, key, text, groups, *kept).drop("_text")
    schema = given.schema.add("n_words", T.LongType()).add("n_removed", T.LongType())

    def clean(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        take = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in right[name]] or [np.empty(0, kind)])
        ids, ths, at = take("id", np.int64), take("th", np.int64), take("at", np.int32)
        order = np.lexsort((ths, ids))
        ids, ths, at = ids[order], ths[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])])) if len(ids) else []
        starts = {(int(ids[i]), int(ths[i])): at[i:j] for i, j in zip(new, [*new[1:], len(ids)], strict=True)} if len(ids) else {}
        bodies, sizes, gone = [], [], []
        for i, th, body in zip(left["_id"], left["_th"], left[text], strict=True):
            words = WORD.findall(body) if isinstance(body, str) else []
            found = starts.get((i, th))
            if found is not None:
                off = covered(len(words), found, window)
                gone.append(int(off.sum()))
                sizes.append(len(words))
                words = [w for w, x in zip(words, off.tolist(), strict=True) if not x]
            else:
                gone.append(0)
                sizes.append(len(words))
            bodies.append(" ".join(words) if isinstance(body, str) else None)
        out = left.assign(**{text: bodies, "n_words": sizes, "n_removed": gone})
        return out[[*kept, "n_words", "n_removed"]]

    return restored(rows.groupBy("_g").cogroup(again.groupBy("_g")).applyInPandas(clean, schema), before)
