"""Interval joins and prefix sums that keep their shape when one key holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def large(df: DataFrame) -> DataFrame:
    """A side of a join of which both grow with the documents. Spark takes a stored table for as large as its compressed files, a
    thirtieth of its rows, and would send it whole through the driver."""
    return df.hint("merge")


def blocks(start: Column, end: Column, size: int) -> Column:
    """Numbers of the blocks of `size` positions that `[start, end]` touches; empty when `end < start`."""
    return F.when(end >= start, F.sequence(F.floor(start / size), F.floor(end / size))).otherwise(
        F.array().cast("array<bigint>")
    )


def point_in_interval(
    points: DataFrame, point: str, intervals: DataFrame, start: str, end: str, keys: list[str], size: int, how="inner"
) -> DataFrame:
    """Join each point to the intervals holding it. Equi-key: the keys and the block, so a long document is split."""
    p = points.withColumn("_block", F.floor(F.col(point) / size))
    s = intervals.withColumn("_block", F.explode(blocks(F.col(start), F.col(end), size)))
    for k in keys:
        s = s.withColumnRenamed(k, f"_k_{k}")
    on = [p["_block"] == s["_block"], p[point] >= s[start], p[point] <= s[end]]
    on += [p[k] == s[f"_k_{k}"] for k in keys]
    return p.join(s, reduce(lambda a, b: a & b, on), how).drop(*[f"_k_{k}" for k in keys], p["_block"], s["_block"])


def overlapping(
    left: DataFrame, ls: str, le: str, right: DataFrame, rs: str, re: str, keys: list[str], size: int, how="inner"
) -> DataFrame:
    """Pairs of overlapping intervals. A pair sharing several blocks is kept only in the first of them."""
    lhs = left.withColumn("_lb", F.explode_outer(blocks(F.col(ls), F.col(le), size)))
    rhs = right.withColumn("_rb", F.explode(blocks(F.col(rs), F.col(re), size)))
    for k in keys:
        rhs = rhs.withColumnRenamed(k, f"_k_{k}")
    first = F.floor(F.greatest(lhs[ls], rhs[rs]) / size)
    on = [lhs["_lb"] == rhs["_rb"], lhs[ls] <= rhs[re], lhs[le] >= rhs[rs], lhs["_lb"] == first]
    on += [lhs[k] == rhs[f"_k_{k}"] for k in keys]
    out = lhs.join(rhs, reduce(lambda a, b: a & b, on), how)
    return out.drop(*[f"_k_{k}" for k in keys], "_lb", "_rb")


def prefix_sums(
    counts: DataFrame, keys: list[str], order: str, values: dict[str, str], chunk: int = 1024, levels: int = 1
) -> DataFrame:
    """Exclusive running sums of `values` (column -> name) over an integer order, without one task per key.

    Sums inside chunks of the order, plus sums over chunk totals, which are summed in chunks themselves where `levels` is
    more than one: a key whose order spans n numbers gives a window of n / chunk ** levels rows at most, the others hold
    `chunk` numbers each.
    """
    at = f"_chunk{levels}"
    c = counts.withColumn(at, F.floor(F.col(order) / chunk))
    inner = W.partitionBy(*keys, at).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    totals = c.groupBy(*keys, at).agg(*[F.sum(v).alias(f"_t_{n}") for v, n in values.items()])
    if levels > 1:
        totals = prefix_sums(totals, keys, at, {f"_t_{n}": f"_o_{n}" for n in values.values()}, chunk, levels - 1)
    else:
        outer = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_o_{n}") for n in values.values()]
        totals = totals.select(*keys, at, *sums)
    totals = totals.select(*keys, at, *[f"_o_{n}" for n in values.values()])
    c = c.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_i_{n}") for v, n in values.items()])
    out = c.join(totals, [*keys, at])
    for n in values.values():
        out = out.withColumn(n, F.col(f"_i_{n}") + F.col(f"_o_{n}")).drop(f"_i_{n}", f"_o_{n}")
    return out.drop(at)
