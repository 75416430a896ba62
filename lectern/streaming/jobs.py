"""Structured Streaming forms of the usage and locate jobs.

Each takes a streaming DataFrame and returns one; `run_to_table` drives a query to completion into parquet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.locate import LocateConfig, locate
from ..operators.store import CorpusIndex
from ..session import dealt, has_folder, remove_folder, shared_folder
from .stateful import SETTINGS, LateRows, with_rows_before

LATE = "1 day"


def daily_counts(scans: DataFrame, late: str = LATE) -> DataFrame:
    """Scans by status per day of event time; rows later than the watermark are dropped and counted (`LateRows`)."""
    w = scans.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    counts = {"confident": "confident", "ambiguous": "ambiguous", "insufficient": "insufficient", "error": "errors"}
    out = w.agg(F.count(F.lit(1)).alias("scans"), *[F.count_if(F.col("status") == s).alias(n) for s, n in counts.items()])
    return out.select(F.to_date("w.start").alias("day"), "scans", *counts.values())


def first_activity(touches: DataFrame, late: str = LATE) -> DataFrame:
    """One row per client and day."""
    t = touches.where(F.col("client").isNotNull()).withColumn("day", F.to_date("ts"))
    return t.withWatermark("ts", late).dropDuplicatesWithinWatermark(["client", "day"]).select("client", "day", "ts")


def new_clients(touches: DataFrame) -> DataFrame:
    """First time each client is seen; counts combine before the state, one small row per client."""
    t = touches.where(F.col("client").isNotNull())
    return t.groupBy("client").agg(F.min("ts").alias("first_seen"))


def feedback_joined(feedback: DataFrame, scans: DataFrame, within: timedelta = timedelta(days=1), late: str = LATE) -> DataFrame:
    """Feedback with its scan, if that came at most `within` before it; both sides keep state only that long."""
    s = scans.select(F.col("id").alias("scan_id"), F.col("ts").alias("scan_ts"), F.col("status").alias("scan_status"), F.col("kind").alias("scan_kind"))
    return with_rows_before(feedback, s, "scan", "scan_id", "scan_ts", within // timedelta(microseconds=1), late)


def locate_batches(corpus: CorpusIndex, cfg: LocateConfig, path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: readings of a batch located in a stored corpus, appended under their batch number.

    Top-k windows are not allowed on streams, so every batch is one locate job. A batch that is run again after a
    failure overwrites its own folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        locate(batch, corpus, cfg).results.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def output_folder(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


ROWS = 100_000
"""Rows of a file of a log in batches."""


def log_in_batches(log: DataFrame, ts: str, batches: int, disorder: str) -> DataFrame:
    """`log` as a stream of so many batches in which rows come up to `disorder` out of order, written under the shared folder.

    A last batch holds one row of the far future, after which the watermark has passed all others. A live log needs none.
    The log is read once, by all tasks, and laid down by batch; then every batch is written as equally many files, with
    empty ones if it needs them, so that what a trigger takes is one batch.
    """
    spark = log.sparkSession
    folder = output_folder(spark)
    path, staged = f"{folder}/log", f"{folder}/staged"
    most = log.select(F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {disorder})")).first()[0]
    time = F.unix_micros(ts)
    ends = log.agg(F.min(time).alias("lo"), (F.max(time) + most + 1).alias("hi"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).first()
    comes = time + F.pmod(F.xxhash64(*log.columns), F.lit(most))
    batch = F.floor((comes - ends["lo"]) * batches / (ends["hi"] - ends["lo"]))
    parts = max(1, -(-ends["n"] // (batches * ROWS)))
    dealt(log).withColumn("_batch", batch).write.partitionBy("_batch").parquet(staged)
    for b in range(batches):
        rows = spark.read.schema(log.schema).parquet(f"{staged}/_batch={b}") if has_folder(spark, f"{staged}/_batch={b}") else spark.createDataFrame([], log.schema)
        (rows.coalesce(1) if parts == 1 else rows.repartition(parts)).write.mode("append").parquet(path)
        for _ in range((b + 1) * parts - len(spark.read.schema(log.schema).parquet(path).inputFiles())):
            spark.createDataFrame([], log.schema).coalesce(1).write.mode("append").parquet(path)
    end = log.limit(1).withColumn(ts, F.lit(ends["last"] + timedelta(days=10_000)).cast(log.schema[ts].dataType))
    end.coalesce(1).write.mode("append").parquet(path)
    remove_folder(spark, staged)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", parts).parquet(path)


def run_to_table(df: DataFrame, mode: str = "append", late: LateRows | None = None) -> DataFrame:
    """Process all available input into parquet and read it back. Update and complete output keep their batch number.

    State is kept in RocksDB, on the executors' disks and in the checkpoint. `late` hears how many rows came too late.
    """
    spark = df.sparkSession
    path = output_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    if late:
        spark.streams.addListener(late)
    try:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        if late:
            late.ended.wait(60)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        if late:
            spark.streams.removeListener(late)
    return spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of every key."""
    cols = [c for c in table.columns if c not in (*keys, "batch")]
    g = table.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("_r"))
    return g.select(*keys, "_r.*")
