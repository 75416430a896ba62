"""Tables kept between jobs: the usage log folded in by batches, results kept by content key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators.results import StoredResults
from ..operators.snapshots import CLIENTS, FEEDBACK, StoredTable, client_changes, feedback_changes, live_feedback
from ..session import shared_folder
from ..streaming import jobs
from . import sql as S
from . import tables as T
from . import usage_queries as U
from .registry import registry as R

BATCHES = 10
CLIENTS_SQL = f"WITH {U.SCANS} SELECT client, {U.STAMP_SQL.format('first_seen')}, {U.STAMP_SQL.format('last_seen')}, lang FROM (SELECT client, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(lang, ts) FILTER (lang IS NOT NULL) AS lang FROM touches GROUP BY client)"


def stored(spark, fold, changes, parts=8):
    return StoredTable(spark, f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", fold, changes.schema, parts)


def mixed(changes, batches=BATCHES):
    """Changes in so many batches, each with rows of all times."""
    n = F.pmod(F.xxhash64(*changes.columns), F.lit(batches))
    for b in range(batches):
        yield f"batch {b}", changes.where(n == b)


def clients_out(table):
    return table.read().select("client", U.STAMP("first_seen"), U.STAMP("last_seen"), "lang")


@R.query("stored_clients", CLIENTS_SQL)
def _(spark, d):
    changes = client_changes(U._touches(spark, d))
    table = stored(spark, CLIENTS, changes)
    for name, batch in mixed(changes):
        table.apply(batch, name)
        table.apply(batch, name)
    return clients_out(table)


@R.query("stream_stored_clients", CLIENTS_SQL)
def _(spark, d):
    path = jobs.output_folder(spark)
    T.raw(spark, d, "events").repartition(BATCHES, "event_id").write.parquet(f"{path}/log")
    log = spark.readStream.schema(T.raw(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    changes = client_changes(U.as_touches(U.as_scans(log)))
    table = stored(spark, CLIENTS, changes)
    q = changes.writeStream.foreachBatch(table.sink("clients")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return clients_out(table)


@R.query(
    "stored_feedback",
    f"""WITH {U.SCANS}, gone AS (SELECT id FROM feedback WHERE reason IS NOT NULL AND k > 50),
    live AS (SELECT id, client, vote, CASE WHEN k < 70 THEN 'other' ELSE reason END AS reason, CASE WHEN k < 30 THEN 'second' WHEN k < 70 THEN 'first' ELSE comment END AS comment, photo FROM feedback)
    SELECT id, client, vote, reason, comment, photo, false AS deleted FROM live WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT id, NULL, NULL, NULL, NULL, photo, true FROM live WHERE id IN (SELECT id FROM gone)""",
)
def _(spark, d):
    f = U._feedback(spark, d)
    gone = f.where(F.col("reason").isNotNull() & (F.col("k") > 50)).select("id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    changes = feedback_changes(f, U.feedback_edits(f), gone)
    table = stored(spark, FEEDBACK, changes)
    for name, batch in mixed(changes):
        table.apply(batch, name)
    live, photos = live_feedback(table)
    columns = ["id", "client", "vote", "reason", "comment", "photo"]
    return live.select(*columns, F.lit(False).alias("deleted")).unionByName(photos.withColumn("deleted", F.lit(True)), allowMissingColumns=True)


@R.query(
    "stored_results",
    f"""WITH st AS (SELECT DISTINCT sha256(text || 'v1') AS key FROM documents WHERE lang = 'en')
    SELECT doc_id, len({S.toks('text')}) AS tokens, sha256(text || 'v1') IN (SELECT key FROM st) AS cached,
      (SELECT count(DISTINCT text) FROM documents WHERE sha256(text || 'v1') NOT IN (SELECT key FROM st)) AS computed FROM documents""",
)
def _(spark, d):
    docs = T.documents(spark, d)
    compute = lambda df: df.select("key", F.size(tokenize("text")).alias("tokens"))
    empty = spark.createDataFrame([], "tokens int")
    results = StoredResults(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}", empty.schema)
    results.run(T.raw(spark, d, "documents").where("lang = 'en'").select("text"), "text", "v1", compute)
    known = results.as_of()
    out, n = results.run(docs.select("doc_id", "text"), "text", "v1", compute)
    cached = known.select("key", F.lit(True).alias("cached"))
    out = out.join(cached, "key", "left").withColumn("cached", F.when(F.col("key").isNotNull(), F.coalesce("cached", F.lit(False))))
    return out.select("doc_id", "tokens", "cached", F.lit(n).alias("computed"))
