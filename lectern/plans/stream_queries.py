"""Streaming jobs over the event log and the benchmark items, read as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.locate import LocateConfig
from ..streaming import jobs, stateful
from . import locate_queries as L
from . import tables as T
from . import usage_queries as U
from .registry import registry as R

#: The log of the ordered jobs: cut in ten batches, its rows up to 20 hours out of order.
BATCHES, DISORDER = 10, "20 hours"
ZONE = "America/New_York"


def stream(spark, d, name):
    schema = T.raw(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def scans(spark, d):
    return U.as_scans(stream(spark, d, "events"))


@R.query(
    "stream_daily_counts",
    f"WITH {U.SCANS} SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS scans, count(*) FILTER (status = 'confident') AS confident, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'insufficient') AS insufficient, count(*) FILTER (status = 'error') AS errors FROM scans GROUP BY day",
)
def _(spark, d):
    out = jobs.latest(jobs.run_to_table(jobs.daily_counts(scans(spark, d)), "update"), ["day"])
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@R.query("stream_first_activity", f"WITH {U.SCANS} SELECT client, strftime(day, '%Y-%m-%d') AS day FROM ev GROUP BY ALL")
def _(spark, d):
    out = jobs.run_to_table(jobs.first_activity(scans(spark, d).select("client", "ts")))
    return out.select("client", F.date_format("day", "yyyy-MM-dd").alias("day"))


@R.query(
    "stream_rate_limit",
    f"""WITH {U.SCANS}, k AS (SELECT client, list([epoch_us(ts)] ORDER BY ts) AS l FROM ev GROUP BY client),
    o AS (SELECT client, unnest(list_reduce(l[2:], lambda a, x: CASE WHEN x[1] >= a[-1] + 21600000000 THEN list_append(a, x[1]) ELSE a END, l[1])) AS opener FROM k),
    j AS (SELECT ev.id, ev.client, row_number() OVER (PARTITION BY ev.client, o.opener ORDER BY ts, id) AS nth FROM ev ASOF JOIN o ON ev.client = o.client AND epoch_us(ev.ts) >= o.opener)
    SELECT client AS key, id, nth <= 3 AS allowed FROM j""",
)
def _(spark, d):
    r = U.as_scans(T.raw(spark, d, "events")).select(F.col("client").alias("key"), "ts", "id")
    log = jobs.log_in_batches(r, "ts", BATCHES, DISORDER)
    return jobs.run_to_table(stateful.rate_limit(log, 3, 6 * 3600, jobs.LATE)).select("key", "id", "allowed")


@R.query(
    "stream_feedback_with_scan",
    f"WITH {U.SCANS} SELECT f.id, f.scan, f.vote, s.status AS scan_status, s.kind AS scan_kind FROM feedback f LEFT JOIN scans s ON s.id = f.scan AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 1 DAY",
)
def _(spark, d):
    log = jobs.log_in_batches(U.as_scans(T.raw(spark, d, "events")), "ts", BATCHES, DISORDER)
    out = jobs.run_to_table(jobs.feedback_joined(U.as_feedback(log), log))
    return out.select("id", "scan", "vote", "scan_status", "scan_kind")


@R.query("stream_new_clients", f"WITH {U.SCANS} SELECT client, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM ev GROUP BY client")
def _(spark, d):
    out = jobs.latest(jobs.run_to_table(jobs.new_clients(scans(spark, d)), "update"), ["client"])
    return out.select("client", U.STAMP("first_seen"))


@R.query(
    "stream_learned_wpc",
    """WITH e AS (SELECT event_id AS id, user_id AS client, ts, floor(value * 10) AS wpc FROM events WHERE event_type IN ('view', 'click')),
    m AS (SELECT *, floor(avg(wpc) OVER (PARTITION BY client ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 0.5)::INT AS m FROM e)
    SELECT id, client, CASE WHEN m > 50 AND m < 2000 THEN m END AS learned FROM m""",
)
def _(spark, d):
    s = U.as_scans(T.raw(spark, d, "events")).where(F.col("event_type").isin("view", "click"))
    e = s.select("client", "ts", "id", F.floor(F.col("value") * 10).cast("double").alias("wpc"))
    log = jobs.log_in_batches(e, "ts", BATCHES, DISORDER)
    return jobs.run_to_table(stateful.learned_wpc(log, jobs.LATE)).select("id", "client", "learned")


@R.query(
    "stream_active_clients",
    f"WITH {U.SCANS} SELECT strftime(day, '%Y-%m-%d') AS day, count(DISTINCT client) AS clients FROM (SELECT client, timezone('{ZONE}', ts AT TIME ZONE 'UTC')::DATE AS day FROM ev WHERE client IS NOT NULL) GROUP BY day",
)
def _(spark, d):
    touches = U.as_scans(T.raw(spark, d, "events")).select("client", "ts", "id")
    log = jobs.log_in_batches(touches, "ts", BATCHES, DISORDER)
    out = jobs.run_to_table(stateful.active_clients(log, ZONE, jobs.LATE))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "clients")


@R.query("stream_locate", L.LOCATED + "SELECT query_id, status, tokens, doc_id, first_word, last_word, round(score, 6) AS score FROM decided")
def _(spark, d):
    lines = T.cut_lines(stream(spark, d, "benchmark"), "item_id")
    path = jobs.output_folder(spark)
    write = jobs.locate_batches(T.corpus_index(spark, d), LocateConfig(), f"{path}/out")
    q = lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.read.parquet(f"{path}/out")
    top = ["top_candidate.doc_id", "top_candidate.first_word", "top_candidate.last_word"]
    return r.select("query_id", "status", "tokens", *top, F.round("top_candidate.score", 6).alias("score"))
