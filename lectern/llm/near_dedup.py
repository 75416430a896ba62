"""MinHash near-dedup: chosen-path set similarity join.

A document's set is its distinct `WORDS`-word shingles. Documents with equal sets are one class. Every class carries
`COORDINATES` minwise hashes. In each of `TREES` independent trees a node chooses, by a hash of its path, each coordinate
with probability `1 / (similarity * COORDINATES)`, and sends its members on by their minwise hash there: similar sets
meet in some tree, others part. Trees have depth 2. In every node with two members or more

1. each member is compared with the node's smallest member (a star, so a node of n copies costs n comparisons);
2. links found so far are joined to components, and a node whose members all lie in one component is done;
3. any other node is compared exhaustively across components: one with at most `SMALL` members by a join, a larger one in
   cells of two blocks of members, first by hashes alone and then, for the members left, with full sets: a cell confirms its pairs itself, likeliest first, passes over
   those that its own links have joined by then, and gives back only links that join two components.

So no link between different texts is skipped but by the trees' chance, and pairs inside a component, which can join
nothing more, are not made. A pair goes on if its set sizes allow the similarity and at least half the minwise hashes
agree (a pair at similarity 0.75 fails that with probability 5e-6), and is then confirmed on the full sets. No node is
branched beyond depth 2, so the trees' chance is the same in crowded nodes: all trees share the hashes, and over the
binomial spread of their agreement a pair at similarity 0.75 meets in none of 20 trees with probability 8e-6.

Null and empty texts have no set and are linked with nothing. Rows with equal id and text are one document. Components
take the smallest non-null id. Nothing is collected on the driver but counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import checkpoint, mix64, release, shielded, text_chunks
from lectern.llm.substrings import Hasher, runs

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS, COORDINATES, TREES, SMALL, BLOCK = 5, 64, 20, 16, 2048
#: Shingles of a block of a crowded node, about; more of them are more blocks.
BLOCK_SHINGLES = 2_000_000
#: Agreeing hashes from which a pair of a crowded node is confirmed in the first of two rounds.
SURE = 48
PATHS = "path bigint, cls binary"


@dataclass(frozen=True)
class Link:
    """Sets are linked if `100 * |intersection| >= percent * |union|`."""

    percent: int = 75

    @property
    def similarity(self) -> float:
        return self.percent / 100


def shingles(words: list[str], hasher: Hasher) -> np.ndarray:
    """Hashes of the distinct shingles, in order; fewer words than a shingle has are one."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(runs(hasher(words), min(WORDS, len(words))) + np.uint64(max(0, WORDS - len(words))))


def text_words(text: str) -> list[str]:
    return WORD.findall(text.lower() if text.isascii() else text.translate(LOWER))


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x >> np.uint64(32)).astype(np.uint32)
    return x[:COORDINATES] | np.uint32(1), x[COORDINATES:]


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document: `_id`, `_th`, set size, class (hash of the whole set) and packed minwise hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hasher = Hasher()
        a, b = coefficients()
        for frame in frames:
            for part in text_chunks(frame, "_text"):
                sets = [shingles(text_words(t), hasher) for t in part["_text"]]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                sig = np.zeros((len(sets), COORDINATES), dtype=np.uint32)
                if len(full):
                    h = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    for j in range(COORDINATES):
                        sig[full, j] = np.minimum.reduceat(h * a[j] + b[j], starts)
                yield pd.DataFrame(
                    {
                        "_id": part["_id"],
                        "_th": part["_th"],
                        "n": sizes,
                        "cls": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        "sig": [x.tobytes() if n else None for x, n in zip(sig, sizes, strict=True)],
                    }
                )

    rows = docs.select(F.col(key).cast("string").alias("_id"), F.xxhash64(text).alias("_th"), F.coalesce(text, F.lit("")).alias("_text"))
    found = rows.mapInPandas(run, "_id string, _th bigint, n bigint, cls binary, sig binary")
    return found.withColumn("_id", F.col("_id").cast("bigint"))


def children(path: np.ndarray, sig: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each member of a node: which member, and the path of each child it goes to."""
    own = np.arange(COORDINATES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        draw = mix64(path[:, None] * np.uint64(0x9E3779B97F4A7C15) + own[None, :])
        chosen = draw < np.uint64(2**64 / (similarity * COORDINATES))
        who, at = np.nonzero(chosen)
        return who, mix64(draw[who, at] + mix64(sig[who, at].astype(np.uint64)))


def unpack(sig: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sig), dtype=np.uint32).reshape(-1, COORDINATES)


def _expand(frame: pd.DataFrame, path: np.ndarray, who: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"path": path.astype(np.int64), "cls": frame["cls"].to_numpy()[who]})


def planted(classes: DataFrame, link: Link) -> DataFrame:
    """Nodes at depth 2 of all trees: `path`, `cls`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 2000):
                part = frame.iloc[start : start + 2000]
                sig = unpack(part["sig"])
                for tree in range(TREES):
                    root = np.full(len(part), tree + 1, dtype=np.uint64)
                    first, path = children(root, sig, link.similarity)
                    again, deeper = children(path, sig[first], link.similarity)
                    yield _expand(part, deeper, first[again])

    return classes.select("cls", "sig").mapInPandas(run, PATHS)


def shared(nodes: DataFrame) -> DataFrame:
    """Nodes with two members or more, each row with the node's smallest member."""
    stars = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("cls").alias("hub")).where("size > 1")
    return nodes.join(stars.select("path", "hub"), "path")


def crossed(nodes: DataFrame, classes: DataFrame, link: Link, sets: DataFrame | None = None) -> DataFrame:
    """Pairs `a`, `b` of members of a node (`path`, `cls`, `label`, `size`) in different components, with their `agree`ing hashes.

    Only pairs that their set sizes and hashes let go on. With `sets` they are confirmed where they meet, and a cell gives
    enough of its links to join the components it joins: fewer than it has members, however many pairs there are. Members
    are dealt to blocks of about `BLOCK`, and every two blocks of a node meet in one cell, so a large node is many tasks.
    """
    blocks, held, work = F.ceil(F.col("size") / BLOCK), ["n", "sig"], _cell if sets is None else _joined
    rows = nodes.join(classes.select("cls", "n", "sig"), "cls")
    if sets is not None:
        weights = nodes.join(classes.select("cls", "n"), "cls").groupBy("path").agg(F.sum("n").alias("weight"))
        blocks, held = F.greatest(blocks, F.ceil(F.col("weight") / BLOCK_SHINGLES)), [*held, "set"]
        rows = rows.join(weights, "path").join(sets.dropDuplicates(["cls"]), "cls")
    return _in_cells(rows, held, blocks, lambda cell: work(cell, link), "a binary, b binary, agree int")


def meeting(nodes: DataFrame, classes: DataFrame, link: Link) -> DataFrame:
    """`path`, `cls` of the members of a node that some member of another component goes on with."""
    rows = nodes.join(classes.select("cls", "n", "sig"), "cls")
    return _in_cells(rows, ["n", "sig"], F.ceil(F.col("size") / BLOCK), lambda cell: _meeting(cell, link), PATHS)


def _in_cells(rows: DataFrame, held: list[str], blocks: Column, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls", "path"), blocks))
    rows = rows.withColumn("met", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    cells = rows.select("path", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "cls", "label", *held)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for frame in frames:
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            if not len(frame):
                continue
            at = frame[["path", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(axis=1)))
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                yield work(frame.iloc[lo:hi])
            # The last cell may go on in the next frame.
            left = frame.iloc[starts[-1] :]
        if left is not None:
            yield work(left)

    cells = cells.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    return cells.mapInPandas(run, schema).distinct()


def _candidates(cell: pd.DataFrame, link: Link) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members `x` and `y` that meet in a cell, the agreeing hashes of each two, and which two go on."""
    sig, n, label = unpack(cell["sig"]), cell["n"].to_numpy(), pd.factorize(cell["label"])[0]
    inside, first = cell["i"].iloc[0] == cell["j"].iloc[0], (cell["own"] == cell["i"]).to_numpy()
    x = np.flatnonzero(first)
    y = x if inside else np.flatnonzero(~first)
    agree = np.zeros((len(x), len(y)), dtype=np.uint8)
    for a, b in zip(sig[x].T, sig[y].T, strict=True):
        agree += a[:, None] == b
    good = (agree >= COORDINATES // 2) & (label[x][:, None] != label[y])
    good &= 100 * np.minimum(n[x][:, None], n[y]) >= link.percent * np.maximum(n[x][:, None], n[y])
    return x, y, agree, np.triu(good, 1) if inside else good


def _pairs(cls: np.ndarray, x: np.ndarray, y: np.ndarray, agree: np.ndarray) -> pd.DataFrame:
    pairs = [(a, b) if a < b else (b, a) for a, b in zip(cls[x], cls[y], strict=True)]
    return pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "agree": agree.astype(np.int32)})


def _cell(cell: pd.DataFrame, link: Link) -> pd.DataFrame:
    x, y, agree, good = _candidates(cell, link)
    at, to = np.nonzero(good)
    return _pairs(cell["cls"].to_numpy(), x[at], y[to], agree[at, to])


def _meeting(cell: pd.DataFrame, link: Link) -> pd.DataFrame:
    x, y, _, good = _candidates(cell, link)
    return cell.iloc[np.union1d(x[good.any(axis=1)], y[good.any(axis=0)])][["path", "cls"]]


def _joined(cell: pd.DataFrame, link: Link) -> pd.DataFrame:
    """Links of a cell that join its components, each confirmed on the full sets."""
    x, y, agree, good = _candidates(cell, link)
    n, label = cell["n"].to_numpy(), pd.factorize(cell["label"])[0]
    used = np.union1d(x[good.any(axis=1)], y[good.any(axis=0)])
    codes: dict[int, np.ndarray] = {}
    if len(used):
        sets = [np.frombuffer(s, dtype=np.uint64) for s in cell["set"].iloc[used]]
        ends = np.cumsum([len(s) for s in sets])
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        codes = dict(zip(used.tolist(), np.split(code, ends[:-1]), strict=True))
        seen = np.zeros(code.max() + 1, dtype=np.int64)
    found = []
    for going in (good & (agree >= SURE), good & (agree < SURE)) if len(used) else ():
        for i in np.flatnonzero(going.any(axis=1)):
            at = np.flatnonzero(going[i] & (label[y] != label[x[i]]))
            if not len(at):
                continue
            sides = [codes[t] for t in y[at].tolist()]
            seen[codes[x[i]]] = 1
            both = np.add.reduceat(seen[np.concatenate(sides)], np.cumsum([0] + [len(s) for s in sides[:-1]]))
            seen[codes[x[i]]] = 0
            for k in at[100 * both >= link.percent * (n[x[i]] + n[y[at]] - both)]:
                if label[y[k]] != label[x[i]]:
                    label[label == label[y[k]]] = label[x[i]]
                    found.append((i, k))
    at, to = np.array(found, dtype=np.int64).reshape(-1, 2).T
    return _pairs(cell["cls"].to_numpy(), x[at], y[to], agree[at, to])


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, link: Link) -> DataFrame:
    """The pairs `a`, `b` whose full sets are similar enough."""
    side = lambda name: classes.select(F.col("cls").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"s_{name}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where(100 * F.least("n_a", "n_b") >= link.percent * F.greatest("n_a", "n_b"))
    agree = _agreeing("s_a", "s_b")
    near = near.where(agree >= COORDINATES // 2).select("a", "b")
    whole = lambda name: sets.select(F.col("cls").alias(name), F.col("set").alias(f"set_{name}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for x, y in zip(frame["set_a"], frame["set_b"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                good.append(100 * both >= link.percent * (len(x) + len(y) - both))
            yield frame.loc[good, ["a", "b"]]

    return near.join(whole("b"), "b").join(whole("a"), "a").mapInPandas(run, "a binary, b binary")


@F.pandas_udf(T.IntegerType())
def _agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series((unpack(a) == unpack(b)).sum(axis=1) if len(a) else [], dtype="int32")


def full_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """`cls` and packed shingle hashes of the classes in `wanted`, read from one document of each.

    A row that is there several times gives its set as often.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for frame in frames:
            for part in text_chunks(frame, "_text"):
                yield pd.DataFrame({"cls": part["cls"], "set": [shingles(text_words(t), hasher).tobytes() for t in part["_text"]]})

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    on = rows["_id"].eqNullSafe(wanted["_id"]) & (rows["_th"] == wanted["_th"])
    return rows.join(wanted, on).select("cls", "_text").mapInPandas(run, "cls binary, set binary")


def components(edges: DataFrame) -> DataFrame:
    """`cls` and `label` (the smallest class reachable) of every class with a link, by alternating stars."""
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.where("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("cls"), F.col("v").alias("label")).distinct())
        before = state


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def unsettled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """`path`, `cls`, `label`, `size` of the nodes whose members lie in several components."""
    rows = labelled(nodes, labels)
    sizes = rows.groupBy("path").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
    return checkpoint(rows.join(sizes.where("low < high").select("path", "size"), "path"))


def links(docs: DataFrame, signed: DataFrame, key: str, text: str, link: Link) -> DataFrame:
    """Confirmed links `a`, `b` between classes, enough of them to join every component."""
    classes = signed.where("n > 0").groupBy("cls").agg(F.min("n").alias("n"), F.min("sig").alias("sig"), F.min(F.struct("_id", "_th")).alias("one"))
    classes = checkpoint(classes.select("cls", "n", "sig", F.col("one._id").alias("_id"), F.col("one._th").alias("_th")))
    nodes = checkpoint(shared(planted(classes, link)))
    release(docs.sparkSession)
    wanted = classes.join(nodes.select("cls").distinct(), "cls", "left_semi").select("cls", "_id", "_th")
    sets = checkpoint(full_sets(docs, key, text, wanted))
    release(docs.sparkSession)
    star = nodes.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    edges, tried = _more(None, None, star, classes, sets, link)
    open_ = unsettled(nodes.select("path", "cls"), components(edges))
    few = open_.where(F.col("size") <= SMALL)
    other = few.select("path", F.col("cls").alias("b"), F.col("label").alias("to"))
    across = few.select("path", F.col("cls").alias("a"), "label").join(other, "path").where("a < b AND label <> to")
    edges, _ = _more(edges, tried, across.select("a", "b").distinct(), classes, sets, link)
    many = open_.where(F.col("size") > SMALL)
    if many.isEmpty():
        return edges
    labels = components(edges)
    met = checkpoint(meeting(unsettled(many.select("path", "cls"), labels), classes, link))
    release(docs.sparkSession)
    many = unsettled(met, labels)
    joined = checkpoint(crossed(many, classes, link, sets).select("a", "b").distinct())
    release(docs.sparkSession)
    return edges.union(joined)


def _more(edges: DataFrame | None, tried: DataFrame | None, pairs: DataFrame, classes: DataFrame, sets: DataFrame, link: Link) -> tuple[DataFrame, DataFrame]:
    """Add the confirmed ones of the pairs that were not tried before."""
    pairs = checkpoint(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs)
    found = checkpoint(confirmed(pairs, classes, sets, link).distinct())
    release(pairs.sparkSession)
    return found if edges is None else edges.union(found), pairs if tried is None else tried.union(pairs)


@shielded("key", "text")
def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", link: Link = Link()) -> DataFrame:
    """One row per row of `docs`: `key`, `_th` (hash of the text), `n_shingles`, `cls`, `component`, `component_id`, `kept`.

    `component` is the same for all rows of a component and for no others, also where ids are null or shared; it is null
    for a text without words, which is linked with nothing. `kept` marks the document with the smallest id of its component.
    """
    signed = checkpoint(signatures(docs.select(key, text), key, text))
    labels = components(links(docs, signed, key, text, link))
    ids = signed.where("n > 0").groupBy("cls").agg(F.min("_id").alias("own"))
    ids = labelled(ids, labels)
    least = ids.groupBy("label").agg(F.min("own").alias("component_id"))
    ids = checkpoint(ids.join(least, "label").select("cls", F.col("label").alias("component"), "component_id"))
    out = signed.drop("sig").join(ids, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(key), "_th", F.col("n").alias("n_shingles"), "cls", "component", component.alias("component_id")).withColumn(
        "kept", F.col(key).eqNullSafe(F.col("component_id"))
    )
