"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample: k-means splits a node's vectors into `branching` children until a node holds few
of the sample. Every row is then filed under the leaf it reaches by going to the nearest child at each step. A query keeps
a priority queue of nodes: the best one is taken out, an inner node puts its children in, a leaf is visited. A node's
priority is the inner product with its centre plus the spread of its members along the query. How many leaves are
visited is calibrated: for some queries the true neighbours among all rows are found by a full scan, and visits are
widened until the leaves hold the wanted share of them, all leaves if need be.

Leaves and the queries that visit them meet in cells of bounded size: small neighbouring leaves share one, and a leaf with
many rows (copies of one vector) or many visitors is dealt over several. A cell gives `k` rows per query at most. The tree
and the counts per leaf are as large as the sample allows, whatever the data.

Nearness is the inner product in double precision, of the vectors as they are. Vectors that are null, empty, zero or hold
null or non-finite components take no part. Vectors of different lengths are not compared; lengths that the sample lacks
share one leaf. Rows with a query's own id never answer it. Repeated candidates each count; repeated equal query rows
are asked once. Null ids come last in ties and answer every query, but a query without an id gets no other row without one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import checkpoint
from lectern.llm.top_k import usable

CANDIDATES, QUERIES = 4096, 512
#: Rows whose scores are summed exactly at once.
PAIRS = 100_000


@dataclass(frozen=True)
class Settings:
    """Vectors that the tree is fitted on, children of a node, sample vectors of a leaf, queries of the calibration, and the share of
    true neighbours that visits are widened to."""

    sample: int = 20_000
    branching: int = 8
    leaf: int = 128
    probes: int = 200
    recall: float = 0.95


@dataclass
class Node:
    center: np.ndarray
    spread: float
    leaf: int = -1
    centers: np.ndarray | None = None
    spreads: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)


def searchable(vector: Column) -> Column:
    return usable(vector) & F.exists(vector, lambda x: x != 0)


def closest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) / 2 - x @ centers.T).argmin(1)


def split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Part of each vector; some parts may be empty, and equal vectors are in one part."""
    centers = x[rng.choice(len(x), k, replace=False)]
    part = closest(x, centers)
    for _ in range(rounds):
        sums = np.zeros_like(centers)
        np.add.at(sums, part, x)
        n = np.bincount(part, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        part = closest(x, centers)
    return part


def grow(x: np.ndarray, s: Settings, leaves: list[int], rng: np.random.Generator) -> Node:
    center = x.mean(axis=0)
    node = Node(center, float(np.sqrt(((x - center) ** 2).sum(1).mean() / x.shape[1])))
    part = split(x, s.branching, rng) if len(x) > max(s.leaf, s.branching) else np.zeros(len(x), int)
    numbers = np.unique(part)
    if len(numbers) > 1:
        node.children = [grow(x[part == n], s, leaves, rng) for n in numbers]
        node.centers = np.stack([c.center for c in node.children])
        node.spreads = np.array([c.spread for c in node.children])
    else:
        node.leaf = len(leaves)
        leaves.append(len(x))
    return node


class Forest:
    """One tree per length of vector; leaf 0 is that of the lengths without a tree."""

    def __init__(self, vectors: list[np.ndarray], s: Settings) -> None:
        leaves, rng = [0], np.random.default_rng(11)
        lengths = sorted({len(v) for v in vectors})
        self.trees = {n: grow(np.stack([v for v in vectors if len(v) == n]), s, leaves, rng) for n in lengths}
        self.n_leaves = len(leaves)

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each of some vectors of one length."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.trees[x.shape[1]], np.arange(len(x)))] if x.shape[1] in self.trees else []
        while todo:
            node, rows = todo.pop()
            if not node.children:
                out[rows] = node.leaf
                continue
            part = closest(x[rows], node.centers)
            todo += [(c, rows[part == n]) for n, c in enumerate(node.children)]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves by best bin first."""
        if len(q) not in self.trees:
            yield 0
            return
        norm, queue, n = float(np.sqrt(q @ q)), [(0.0, 0, self.trees[len(q)])], 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if not node.children:
                yield node.leaf
                continue
            for child, score in zip(node.children, node.centers @ q + norm * node.spreads, strict=True):
                n += 1
                heapq.heappush(queue, (-float(score), n, child))


def first_of(group: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best `k` of each group, groups in order: score down, then ids up, null ones last."""
    order = np.lexsort((ids, none, -score, group))
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[place < k]


def best_rows(q: np.ndarray, own: tuple[np.ndarray, np.ndarray], x: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int, visited: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, row numbers and exact scores of the best `k` rows that each query visits."""
    rough = q @ x.T
    if visited is not None:
        rough[~visited] = -np.inf
    rough[(own[0][:, None] == ids) & (own[1][:, None] == none)] = -np.inf
    if len(x) > k:
        kth = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
        # Matrix products differ by rounding; the slack keeps every row that may be among the best.
        near = rough >= (kth - 1e-12 * q.shape[1] * np.abs(q).max(axis=1) * np.abs(x).max())[:, None]
    else:
        near = np.ones(rough.shape, bool)
    near &= rough > -np.inf
    ends, out, start = np.cumsum(near.sum(axis=1)), [], 0
    while start < len(q):
        # As many queries as give about `PAIRS` rows to sum exactly, one at least.
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
        n, at = np.nonzero(near[start:stop])
        n += start
        # Summed row by row in one order, so that equal vectors have equal scores.
        score = (x[at] * q[n]).sum(axis=1)
        first = first_of(n, score, none[at], ids[at], k)
        out.append((n[first], at[first], score[first]))
        start = stop
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def cells_of(held: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Each leaf's cell and the blocks it is dealt over. Neighbouring leaves share a cell while it has room."""
    out, cell, size = {}, 0, 0
    for leaf, n in sorted(held.items()):
        if size and size + n > CANDIDATES:
            cell, size = cell + 1, 0
        out[leaf] = cell
        size += n
    total = {}
    for leaf, c in out.items():
        total[c] = total.get(c, 0) + held[leaf]
    return {leaf: (c, -(-total[c] // CANDIDATES)) for leaf, c in out.items()}


def rows_of(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, none (whether the id is null), v."""
    kept = df.where(searchable(F.col(vector)))
    return kept.select(F.coalesce(F.col(vec_id).cast("bigint"), F.lit(0)).alias("id"), F.col(vec_id).isNull().alias("none"), F.col(vector).cast("array<double>").alias("v"))


def fit(rows: DataFrame, s: Settings) -> Forest:
    """Fit on the `s.sample` rows with the lowest hash."""
    sample = rows.select("v", F.xxhash64("v", "id").alias("h")).orderBy("h").limit(s.sample).toPandas()
    return Forest([np.asarray(v, float) for v in sample["v"]], s)


def file_rows(rows: DataFrame, forest) -> DataFrame:
    """`rows` with their leaf. `forest` is a broadcast."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            leaf = np.zeros(len(frame), np.int64)
            for _, at in frame.groupby(frame["v"].str.len()).indices.items():
                leaf[at] = forest.value.file(np.stack(frame["v"].to_numpy()[at]))
            yield frame.assign(leaf=leaf)

    return rows.mapInPandas(run, "id bigint, none boolean, v array<double>, leaf bigint")


def calibrate(filed: DataFrame, asked: DataFrame, forest, k: int, s: Settings) -> tuple[int, float]:
    """Leaf visits that reach the wanted recall, and the recall they have on the probes, against a scan of all rows.

    The probes are a bounded number of queries with the lowest hash; each task keeps its best `k` rows for each.
    """
    probes = asked.orderBy(F.xxhash64("key"), "key").limit(s.probes).toPandas()
    held, by_length = [np.asarray(v, float) for v in probes["v"]], {}
    for n, v in enumerate(held):
        by_length.setdefault(len(v), []).append(n)
    own_id, own_none = probes["id"].to_numpy(np.int64), probes["none"].to_numpy(bool)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [np.zeros(0, int), np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for frame in frames:
            for length, at in frame.groupby(frame["v"].str.len()).indices.items():
                numbers = np.array(by_length.get(length, []), int)
                if not len(numbers):
                    continue
                x, ids, none, leaf = np.stack(frame["v"].to_numpy()[at]), frame["id"].to_numpy()[at], frame["none"].to_numpy(bool)[at], frame["leaf"].to_numpy()[at]
                n, row, score = best_rows(np.stack([held[i] for i in numbers]), (own_id[numbers], own_none[numbers]), x, ids, none, k)
                found = (numbers[n], score, none[row], ids[row], leaf[row])
                best = [np.concatenate(pair) for pair in zip(best, found, strict=True)]
                kept = first_of(best[0], best[1], best[2], best[3], k)
                best = [c[kept] for c in best]
        yield pd.DataFrame(dict(zip(("probe", "score", "none", "id", "leaf"), best, strict=True)))

    order = W.partitionBy("probe").orderBy(F.desc("score"), "none", "id")
    found = filed.select("id", "none", "v", "leaf").mapInPandas(scan, "probe int, score double, none boolean, id bigint, leaf bigint")
    true = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("probe", "leaf").toPandas()
    if not len(true):
        return 1, 1.0
    # The visit at which each true neighbour is met.
    place = [{leaf: n for n, leaf in enumerate(forest.value.visits(q), 1)} for q in held]
    at = np.sort([place[p][leaf] for p, leaf in zip(true["probe"], true["leaf"], strict=True)])
    needed = int(at[int(np.ceil(s.recall * len(at))) - 1])
    return needed, float((at <= needed).mean())


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "vector", settings: Settings = Settings()) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: for each row of `queries` the `k` nearest rows of `vectors` found."""
    rows, asked = rows_of(vectors, vec_id, vector), rows_of(queries, vec_id, vector).distinct()
    forest = rows.sparkSession.sparkContext.broadcast(fit(rows, settings))
    # Numbered before it is cut, so that copies of one vector are dealt evenly and a task run again deals them alike.
    filed = checkpoint(file_rows(rows, forest).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))
    asked = checkpoint(asked.withColumn("key", F.xxhash64("id", "none", "v")))
    visits, _ = calibrate(filed, asked, forest, k, settings)
    # A row per leaf, and the sample bounds the leaves.
    cells = cells_of({r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()})

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for n, v in enumerate(frame["v"]):
                met = {}
                for _, leaf in zip(range(visits), forest.value.visits(np.asarray(v, float))):
                    if leaf in cells:
                        met.setdefault(cells[leaf], []).append(leaf)
                rows += [(n, *cell, leaves) for cell, leaves in met.items()]
            at = frame.iloc[[r[0] for r in rows]].reset_index(drop=True)
            yield at.assign(cell=[r[1] for r in rows], blocks=[r[2] for r in rows], leaves=[r[3] for r in rows])

    planned = asked.mapInPandas(plan, "id bigint, none boolean, v array<double>, key bigint, cell bigint, blocks bigint, leaves array<bigint>")
    visiting = checkpoint(planned)
    sought = visiting.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("shifts"))
    of_leaf = rows.sparkSession.createDataFrame([(leaf, *cell) for leaf, cell in cells.items()], "leaf bigint, cell bigint, blocks bigint")
    cand = filed.join(F.broadcast(of_leaf.join(sought, "cell")), "leaf")
    cand = cand.select("id", "none", "v", "leaf", "cell", F.pmod("deal", "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shifts") - 1)).alias("shift"))
    ask = visiting.join(F.broadcast(sought), "cell")
    ask = ask.select("id", "none", "v", "key", "leaves", "cell", F.pmod("key", "shifts").alias("shift"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [left.head(0).rename(columns={"id": "query_id", "none": "query_none"})[["query_id", "query_none", "key"]].assign(vec_id=0, none=False, score=0.0)]
        for length, at in left.groupby(left["v"].str.len()).indices.items():
            c, q = right[right["v"].str.len() == length], left.iloc[at]
            if not len(c):
                continue
            ids, none, asked_by = c["id"].to_numpy(), c["none"].to_numpy(bool), (q["id"].to_numpy(), q["none"].to_numpy(bool))
            where, leaves = pd.factorize(c["leaf"])
            visited = np.stack([np.isin(leaves, of) for of in q["leaves"]])[:, where]
            n, row, score = best_rows(np.stack(q["v"].to_numpy()), asked_by, np.stack(c["v"].to_numpy()), ids, none, k, visited)
            out.append(pd.DataFrame({"query_id": asked_by[0][n], "query_none": asked_by[1][n], "key": q["key"].to_numpy()[n], "vec_id": ids[row], "none": none[row], "score": score}))
        return pd.concat(out)

    cell = ["cell", "block", "shift"]
    met = ask.groupBy(*cell).cogroup(cand.groupBy(*cell)).applyInPandas(meet, "query_id bigint, query_none boolean, key bigint, vec_id bigint, none boolean, score double")
    order = W.partitionBy("query_id", "key").orderBy(F.desc("score"), "none", "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.when(~F.col("query_none"), F.col("query_id")).alias("query_id"), "rank", F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), "score")
