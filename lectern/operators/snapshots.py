"""Stored tables that changes are folded into, batch by batch.

A table is kept as states that merge: per key the least, the greatest or the latest of each field. Merging does not depend
on order and takes a row twice without harm, so batches may come late, mixed or again and give what one batch gives.

Rows lie in parts by a hash of the key. A batch is written aside, merged with the parts its keys lie in, and those parts alone
are written anew, in a folder of their own. A row per touched part in `commits`, written last and in one file, makes the
version visible: readers see whole versions only, a batch that fails leaves none, and older versions stay readable until
`forget`. The name of a batch is kept with its rows; a batch that is there already changes nothing. A table has one writer at
a time, as a stream or a scheduled job is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove_folder

COMMITS = "version bigint, batch string, part int, folder string"


@dataclass(frozen=True)
class Fold:
    """How the rows of one key become one.

    least, greatest: fields of which that value stays. last: fields of which the value of the latest `ts` stays; null values
    change nothing, and of values of one instant the largest stays.
    """

    keys: tuple[str, ...]
    least: tuple[str, ...] = ()
    greatest: tuple[str, ...] = ()
    last: tuple[str, ...] = ()
    ts: str = "ts"

    def lift(self, changes: DataFrame) -> DataFrame:
        """Changes as states. Columns the fold does not name are left out."""
        latest = [F.when(F.col(c).isNotNull(), F.struct(F.col(self.ts).alias("at"), F.col(c).alias("is"))).alias(c) for c in self.last]
        return changes.select(*self.keys, *self.least, *self.greatest, *latest)

    def merge(self, states: DataFrame) -> DataFrame:
        kept = [F.min(c).alias(c) for c in self.least] + [F.max(c).alias(c) for c in (*self.greatest, *self.last)]
        return states.groupBy(*self.keys).agg(*kept)

    def values(self, states: DataFrame) -> DataFrame:
        return states.select(*self.keys, *self.least, *self.greatest, *[F.col(c)["is"].alias(c) for c in self.last])


@dataclass(frozen=True)
class StoredTable:
    """A table under `path`. `schema` is that of the changes, `parts` how many parts keys are dealt over (fixed for good), and
    `split` the columns they are dealt by, the first key if none is named."""

    spark: SparkSession
    path: str
    fold: Fold
    schema: T.StructType
    parts: int = 64
    split: tuple[str, ...] = ()

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*(self.split or self.fold.keys[:1])), F.lit(self.parts)).cast("int")

    def _states(self, folders: list[str]) -> DataFrame:
        empty = self.fold.lift(self.spark.createDataFrame([], self.schema))
        return self.spark.read.schema(empty.schema).parquet(*folders) if folders else empty

    def commits(self, version: int | None = None) -> DataFrame:
        """version, batch, part, folder of the commits up to `version`."""
        try:
            rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMITS)
        return rows if version is None else rows.where(F.col("version") <= version)

    def _folders(self, commits: DataFrame, parts: list[int] | None = None) -> list[str]:
        """Newest folder of each part: at most `parts` names."""
        rows = commits.where(F.col("part").isNotNull())
        rows = rows if parts is None else rows.where(F.col("part").isin(parts))
        newest = rows.groupBy("part").agg(F.max_by("folder", "version").alias("folder"))
        return [f"{self.path}/data/{r['folder']}/part={r['part']}" for r in newest.collect()]

    def version(self) -> int:
        """Number of the last version, 0 for a table without any."""
        return self.commits().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def states(self, version: int | None = None) -> DataFrame:
        return self._states(self._folders(self.commits(version)))

    def read(self, version: int | None = None) -> DataFrame:
        """Keys and values, of the last version or of the one named."""
        return self.fold.values(self.states(version))

    def apply(self, changes: DataFrame, batch: str) -> bool:
        """Fold one batch in as a new version; False if a batch of that name is in the table already."""
        commits = self.commits()
        last = commits.agg(F.max("version").alias("n"), F.bool_or(F.col("batch") == batch).alias("known")).first()
        if last["known"]:
            return False
        folder = uuid.uuid4().hex
        aside = f"{self.path}/batches/{folder}"
        self.fold.merge(self.fold.lift(changes)).withColumn("part", self._part()).write.parquet(aside)
        staged = self.spark.read.parquet(aside)
        touched = sorted(r["part"] for r in staged.select("part").distinct().collect())
        if touched:
            before = self._states(self._folders(commits, touched)).withColumn("part", self._part())
            merged = self.fold.merge(before.unionByName(staged).drop("part")).withColumn("part", self._part())
            # Parts are dealt by size: a large one over several files, small ones together.
            merged.hint("rebalance", F.col("part")).write.partitionBy("part").parquet(f"{self.path}/data/{folder}")
        rows = [((last["n"] or 0) + 1, batch, p, folder) for p in touched or [None]]
        self.spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        remove_folder(self.spark, aside)
        return True

    def forget(self, version: int) -> int:
        """Delete what only versions before `version` read: parts replaced since, and folders of batches that failed or are
        done. Gives the number of folders deleted; no batch may be running."""
        kept = {f.rsplit("/data/", 1)[1] for f in self._folders(self.commits(version))}
        later = self.commits().where((F.col("version") > version) & F.col("part").isNotNull())
        kept |= {f"{r['folder']}/part={r['part']}" for r in later.select("folder", "part").toLocalIterator()}
        n = 0
        for folder in list_folders(self.spark, f"{self.path}/data"):
            for part in list_folders(self.spark, f"{self.path}/data/{folder}"):
                if f"{folder}/{part}" not in kept:
                    n += remove_folder(self.spark, f"{self.path}/data/{folder}/{part}")
        return n + remove_folder(self.spark, f"{self.path}/batches")

    def sink(self, name: str) -> Callable[[DataFrame, int], None]:
        """foreachBatch function: each micro-batch folded in under the stream's name and its number, so once, however often
        it is tried."""

        def run(batch: DataFrame, number: int) -> None:
            self.apply(batch, f"{name}/{number}")

        return run


def list_folders(spark: SparkSession, path: str) -> list[str]:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()] if files.exists(at) else []


# ---- the usage log as stored tables ----

CLIENTS = Fold(keys=("client",), least=("first_seen",), greatest=("last_seen",), last=("lang",))
FEEDBACK = Fold(keys=("id", "client", "deleted"), greatest=("written",), last=("ts", "day", "scan", "vote", "reason", "comment", "photo"), ts="at")


def client_changes(touches: DataFrame) -> DataFrame:
    """Changes of the table of clients from (client, ts, lang) touches; null clients are not counted."""
    t = touches.where(F.col("client").isNotNull())
    return t.select("client", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), "ts", "lang")


def feedback_changes(written: DataFrame | None = None, edits: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """Changes of the table of feedback: rows written, edits (id, client, ts, reason, comment, photo) and deletes (id, ts).

    An edit before its row, or a delete before either, waits in the table for it.
    """
    shape = "id bigint, client bigint, deleted boolean, written boolean, at timestamp, ts timestamp, day date, scan bigint, vote string, reason string, comment string, photo string"
    kinds = ((written, False, True), (edits, False, False), (deletes, True, False))
    out = None
    for rows, deleted, first in kinds:
        if rows is None:
            continue
        own = {c: c for c in rows.columns if c != "ts" or first}
        given = {**own, "at": "ts"}
        fixed = {"deleted": F.lit(deleted), "written": F.lit(first)}
        cols = []
        for field in T.StructType.fromDDL(shape).fields:
            value = fixed.get(field.name)
            if value is None:
                value = F.col(given[field.name]) if field.name in given else F.lit(None)
            cols.append(value.cast(field.dataType).alias(field.name))
        part = rows.select(*cols)
        out = part if out is None else out.unionByName(part)
    return out


def live_feedback(table: StoredTable, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows written and not deleted, with the edits of the client that wrote them; photo references of the deleted ones)."""
    rows = table.read(version)
    gone = rows.where("deleted").select("id")
    live = rows.where("written and not deleted").drop("deleted", "written")
    return live.join(gone, "id", "left_anti"), live.join(gone, "id", "left_semi").select("id", "photo")
