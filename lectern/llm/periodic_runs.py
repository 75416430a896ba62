"""Periodic runs: stretches of words that repeat with a period, found by seed and extend on diagonals.

A run is a stretch of consecutive words of one text with smallest period q (words q apart are identical), at least
`max(MIN_LENGTH, MIN_EXPONENT * q)` words long, that no neighbouring word extends keeping q. On the diagonal of lag q it is
one unbroken match of at least `overlap(q)` words.

Lags are taken in classes [2^j, 2^(j+1)). All words of a class are indexed by grams of the least overlap that a run of the
class guarantees. Such a gram is as long as the largest lag of its class, so inside a run it comes back after exactly one
period and no sooner: the pairs of an occurrence with the next one in the same document hold a seed of every run, and are
fewer than the words. A pair whose lag is in the class is extended word by word to both sides, unless the table of the
furthest word covered per lag says that an earlier extension went past it. Positions whose gram occurs once are left out of
all later, longer classes.

Grams are compared by 64-bit hashes that are mixed with the document; extensions compare the words. A null text has no
words. Every row is treated by itself, so repeated rows, null ids and further columns do not matter; columns with the names
of the results are replaced. One text is one step of one task, however long; memory grows with the longest text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.common import mix64, plain, restored, shielded, text_chunks

MIN_LENGTH, MIN_EXPONENT = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Odd, so that a gram's two halves do not commute.
TURN = np.uint64(0x9E3779B97F4A7C15)


def overlap(period: int) -> int:
    """Words that a run of this period shares with itself one period later, at least."""
    return max(MIN_LENGTH, MIN_EXPONENT * period) - period


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * TURN + right)


def differs(ids: np.ndarray, i: int, lag: int, way: int) -> int:
    """Where, from `i` on in direction `way`, the first word differs from the one `lag` after it."""
    step = 32
    while True:
        if way > 0:
            wrong = np.flatnonzero(ids[i : i + step][: max(0, len(ids) - lag - i)] != ids[i + lag : i + lag + step])
        else:
            low = max(0, i - step + 1)
            wrong = np.flatnonzero((ids[low : i + 1] != ids[low + lag : i + 1 + lag])[::-1])
        if len(wrong):
            return i + way * int(wrong[0])
        i += way * step
        step *= 2


def stretches(ids: np.ndarray, docs: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in `ids`, which starts and ends with a word that occurs once, and has one
    between any two documents; `docs` numbers the documents."""
    found, furthest = [], {}
    power, bits = joined(ids.astype(np.uint64), docs.astype(np.uint64)), 0  # hashes of 2^bits words
    alive = np.arange(len(ids))
    for j in count():
        k = min(overlap(q) for q in range(1 << j, 2 << j))
        if k > len(ids):
            return found
        # The first and the last 2^a words of a gram, which overlap or meet.
        a = k.bit_length() - 1
        while bits < a:
            power = joined(power[: len(power) - (1 << bits)], power[1 << bits :])
            bits += 1
        alive = alive[alive + k <= len(ids)]
        gram = joined(power[alive], power[alive + k - (1 << a)])
        order = np.argsort(gram, kind="stable")
        place, gram = alive[order], gram[order]
        again = gram[1:] == gram[:-1]
        if not again.any():
            return found
        first, lag = place[:-1][again], np.diff(place)[again]
        seeds = (lag >= 1 << j) & (lag < 2 << j)
        first, lag = first[seeds], lag[seeds]
        at = np.argsort(first, kind="stable")
        for i, q in zip(first[at].tolist(), lag[at].tolist(), strict=True):
            if i < furthest.get(q, 0):
                continue
            end = furthest[q] = differs(ids, i, q, 1)
            start = differs(ids, i, q, -1) + 1 if end > i else i
            if end - start >= overlap(q):
                found.append((start, end - start + q, q))
        alive = np.sort(place[np.append(again, False) | np.append(False, again)])


def runs_of(texts: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text, the runs by start, then period."""
    words = [t.split() for t in texts]
    number = defaultdict(count().__next__)
    parts, docs = [[-1]], [[0]]
    for d, w in enumerate(words, 1):
        parts += [list(map(number.__getitem__, w)), [-d - 1]]
        docs.append([d] * (len(w) + 1))
    ids, doc = np.concatenate([np.array(p, np.int64) for p in parts]), np.concatenate([np.array(p, np.int64) for p in docs])
    begin = np.cumsum([1] + [len(w) + 1 for w in words])
    out = [(w, []) for w in words]
    for start, length, period in sorted(stretches(ids, doc), key=lambda r: (r[0], r[2])):
        d = int(doc[start]) - 1
        out[d][1].append((start - int(begin[d]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that some run contains after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


@shielded("text")
def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `n_words`, `runs` (by start, then period; words are numbered from 0) and `collapsed`, the text with
    each run cut down to its first period, words joined by one space (empty for a null text)."""
    kept = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    before = docs.select(*kept).schema
    docs = plain(docs.select(*kept))
    schema = T.StructType(list(docs.schema)).add("n_words", T.LongType()).add("runs", T._parse_datatype_string(RUNS)).add("collapsed", T.StringType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in text_chunks(frame, text):
                got = runs_of([t.encode() if isinstance(t, str) else b"" for t in part[text]])
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r in got]
                yield part.assign(n_words=[len(w) for w, _ in got], runs=runs, collapsed=[collapsed(*x).decode() for x in got])

    return restored(docs.mapInPandas(run, schema), before)
