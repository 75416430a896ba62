"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import functools
import gc
import inspect
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import checkpoint

__all__ = ["checkpoint", "held_out", "mix64", "plain", "read", "release", "restored", "shared_folder", "shielded", "text_chunks"]

#: Text handed to one numpy step; a longer single text is a step of its own.
CHUNK_CHARS = 4_000_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row belongs to the fold that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def release(spark: SparkSession) -> None:
    """Let the driver notice results that nobody holds any more, so that executors drop their shuffle files.

    A plan is held by its data frame and a shuffle by its plan, so it takes more than one collection to get through.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def text_chunks(frame: pd.DataFrame, column: str = "text", chars: int = CHUNK_CHARS) -> Iterator[pd.DataFrame]:
    """Consecutive rows of at most about `chars` characters together; every row is in exactly one."""
    if len(frame) == 0:
        return
    ends = np.cumsum([len(t) + 1 if isinstance(t, str) else 1 for t in frame[column]])
    start = 0
    while start < len(frame):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield frame.iloc[start:stop].reset_index(drop=True)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers; the same everywhere and on every run."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def plain(df: DataFrame) -> DataFrame:
    """`df` with whole-number columns as strings: pandas would turn those with nulls into doubles and lose digits."""
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, WHOLE) else F.col(f"`{f.name}`") for f in df.schema])


def restored(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Undo `plain` for the columns that `df` shares with `schema`."""
    types = {f.name: f.dataType for f in schema if isinstance(f.dataType, WHOLE)}
    return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a session without one (a test) gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        checkpoint(spark.range(1))
    return sc.getCheckpointDir()


def shielded(*names: str, only: tuple[str, ...] | None = None) -> Callable:
    """Keep a table's own columns apart from the helper columns of an operator, which start with an underscore.

    Columns of the argument `docs` or `pages` with such names (with `only`: all but those named) are renamed on the way
    in and back on the way out. `names` are the arguments that name columns of it.
    """

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(f)

        @functools.wraps(f)
        def run(*args, **given) -> DataFrame:
            bound = signature.bind(*args, **given)
            bound.apply_defaults()
            at = next(n for n in ("docs", "pages") if n in bound.arguments)
            df, own = bound.arguments[at], {}
            for c in df.columns:
                if c not in only if only is not None else c.startswith("_"):
                    fresh = f"clash{len(own)}"
                    while fresh in df.columns:
                        fresh += "x"
                    own[c] = fresh
            bound.arguments[at] = df.withColumnsRenamed(own)
            for n in names:
                bound.arguments[n] = own.get(bound.arguments[n], bound.arguments[n])
            return f(*bound.args, **bound.kwargs).withColumnsRenamed({v: k for k, v in own.items()})

        return run

    return wrap
