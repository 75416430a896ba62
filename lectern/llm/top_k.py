"""Exact top-k by inner product: aggregation of sorted lists without random access.

Every block of candidates has one list per dimension, sorted by that component. A query reads the lists of its positive
components from the top and of its negative ones from the bottom, all to the same depth. What was read and the last
value of each list give every candidate a lower and an upper bound of its score; candidates whose upper bound is below
the k-th lower bound cannot qualify any more. Reading stops when few enough are left, and their scores are resolved.

Queries and candidates meet in a grid of blocks of bounded size, so nothing is broadcast and no block grows with the
data. Blocks are dealt round robin, so no id or vector can fill one. Vectors that are null or empty, or hold a null or a
non-finite component, take no part; vectors of different lengths are not compared. Rows with a query's own id never
answer it. Repeated candidates each count; repeated equal query rows are asked once. Null ids come last in ties.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CANDIDATES, QUERIES, STEP = 8192, 2048, 128
SCHEMA = "query_id bigint, _q bigint, vec_id bigint, score bigint"
NO_ID = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & good


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


class SortedLists:
    """One list per component over a block of candidates, readable from either end to any depth."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.from_below = np.empty_like(order)
        np.put_along_axis(self.from_below, order, np.arange(len(x))[:, None], axis=0)

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Highest and lowest value of every component, known from the top and from the bottom of the lists."""
        n = len(self.x)
        low_end, high_end = self.sorted[0], self.sorted[-1]
        top, bottom = self.from_below >= n - depth, self.from_below < depth
        at_top, at_bottom = self.sorted[n - depth], self.sorted[depth - 1]
        x = self.x
        return np.where(top, x, at_top), np.where(top, x, low_end), np.where(bottom, x, high_end), np.where(bottom, x, at_bottom)


def block_top(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and the positions and scores of its best `k` of the block, ties included."""
    lists, n, found = SortedLists(x.astype(np.float64)), len(x), []
    left = np.arange(len(queries))
    # Sums of products are compared as doubles; the slack is above what rounding can add up to.
    slack = 1e-9 * (np.abs(queries).astype(np.float64).sum(1) * np.abs(lists.x).max(initial=0)) + 0.5
    depth = max(k, n // 16)
    while len(left):
        depth = min(depth, n)
        high_top, low_top, high_bottom, low_bottom = lists.bounds(depth)
        waiting = []
        for start in range(0, len(left), STEP):
            part = left[start : start + STEP]
            q = queries[part].astype(np.float64)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            upper = up @ high_top.T + down @ low_bottom.T
            lower = up @ low_top.T + down @ high_bottom.T
            mine = own[part][:, None] == ids[None, :]
            upper[mine] = lower[mine] = -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(part), -np.inf)
            open_ = (upper >= (kth - slack[part])[:, None]) & ~mine
            few = (open_.sum(1) <= max(8 * k, n // 8)) | (depth == n)
            for i in np.flatnonzero(few):
                at = np.flatnonzero(open_[i])
                found.append((int(part[i]), at, x[at] @ queries[part[i]]))
            waiting.append(part[~few])
        left, depth = np.concatenate(waiting) if waiting else left[:0], depth * 2
    best = []
    for i, at, score in found:
        if len(at) > k:
            first = np.lexsort((ids[at], -score))[:k]
            at, score = at[first], score[first]
        best.append((i, at, score))
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: the `k` rows of `vectors` with the highest inner product.

    Both tables hold whole-number vectors. Equal scores are ranked by the smaller id.
    """
    cand = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v"))
    asked = queries.select(F.col(vec_id).cast("bigint").alias("query_id"), F.col(vector).alias("v")).distinct()
    n_cand, n_asked = -(-cand.count() // CANDIDATES), -(-asked.count() // QUERIES)
    if not n_cand or not n_asked:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    cand = cand.repartition(n_cand).withColumn("_cb", F.spark_partition_id())
    cand = cand.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    asked = asked.repartition(n_asked).withColumn("_qb", F.spark_partition_id()).withColumn("_q", F.xxhash64("query_id", "v"))
    asked = asked.withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, q in left.groupby(left["v"].str.len()):
            c = right[right["v"].str.len() == size]
            if len(c) == 0:
                continue
            empty = c["vec_id"].isna().to_numpy()
            ids = c["vec_id"].fillna(0).to_numpy(np.int64)
            ids[empty] = NO_ID
            x, asked_by = np.stack(c["v"].to_numpy()).astype(np.int64), q["query_id"].fillna(NO_ID - 1).to_numpy(np.int64)
            keys = q["_q"].to_numpy()
            for i, at, score in block_top(np.stack(q["v"].to_numpy()).astype(np.int64), asked_by, x, ids, k):
                got = pd.array(ids[at], dtype="Int64")
                got[empty[at]] = pd.NA
                out.append(pd.DataFrame({"query_id": asked_by[i], "_q": keys[i], "vec_id": got, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "_q": [], "vec_id": [], "score": []}).astype("int64")

    met = asked.groupBy("_qb", "_cb").cogroup(cand.groupBy("_qb", "_cb")).applyInPandas(meet, SCHEMA)
    order = W.partitionBy("query_id", "_q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
