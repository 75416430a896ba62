"""Exact order statistics and running values that never sort or gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    weight: str | None = None,
    width: float = 1000,
) -> DataFrame:
    """Per key, the element of the sorted values at each 0-based rank; a rank is a function of the count.

    Equal values are counted before the shuffle, counts are summed in buckets of `width`, and only the bucket that
    holds a rank is looked into.
    """
    v = df.where(F.col(value).isNotNull())
    counts = v.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    counts = counts.withColumn("_b", F.floor(F.col(value) / width))
    w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    b = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    b = b.withColumn("_to", F.sum("_bc").over(w)).withColumn("_n", F.sum("_bc").over(W.partitionBy(*keys)))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), f(F.col("_n")).cast("bigint").alias("at")) for n, f in ranks.items()])
    b = b.withColumn("_from", F.col("_to") - F.col("_bc")).withColumn("_r", F.explode(wanted))
    b = b.where((F.col("_from") <= F.col("_r.at")) & (F.col("_r.at") < F.col("_to")))
    b = b.select(*keys, "_b", "_from", F.col("_r.name").alias("_name"), F.col("_r.at").alias("_at"))
    inside = counts.join(b, [*keys, "_b"])
    run = F.sum("_c").over(W.partitionBy(*keys, "_b", "_name").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    hit = inside.withColumn("_run", F.col("_from") + run).where(F.col("_run") > F.col("_at"))
    return hit.groupBy(*keys).agg(*[F.min(F.when(F.col("_name") == n, F.col(value))).alias(n) for n in ranks])


def upper_median(df: DataFrame, keys: list[str], value: str, weight: str | None = None, width: float = 1000) -> DataFrame:
    """Element floor(n / 2) of the sorted values per key."""
    return order_statistics(df, keys, value, {"median": lambda n: F.floor(n / 2)}, weight, width)


def previous_value(df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: int = 1024) -> DataFrame:
    """Last value that is not null strictly before each row, over a unique integer order, in chunks of that order."""
    c = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    inner = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    some = F.when(F.col(value).isNotNull(), F.col(order))
    ends = c.groupBy(*keys, "_chunk").agg(F.max_by(value, some).alias("_e"))
    ends = ends.select(*keys, "_chunk", F.last("_e", ignorenulls=True).over(outer).alias("_carried"))
    c = c.withColumn("_own", F.last(value, ignorenulls=True).over(inner))
    j = c.join(ends, [*keys, "_chunk"])
    return j.withColumn(out, F.coalesce("_own", "_carried")).drop("_own", "_carried", "_chunk")
