"""Usage analytics and dated periods; the log is the events table, the periods are orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import periods, usage
from . import tables as T
from .registry import registry as R

TODAY = date(1998, 3, 4)

SCANS = """ev AS (SELECT event_id AS id, ts, strftime(ts, '%Y-%m-%d')::DATE AS day, user_id AS client, event_type, CAST(json_extract(props, '$.k') AS INT) AS k, floor(value * 100)::INT AS total_ms, value FROM events),
scans AS (SELECT id, ts, day, client, CASE WHEN k < 20 THEN 'manual' ELSE 'camera' END AS kind, CASE event_type WHEN 'view' THEN 'confident' WHEN 'purchase' THEN 'confident' WHEN 'click' THEN 'ambiguous' WHEN 'signup' THEN 'insufficient' ELSE 'error' END AS status, total_ms, k AS col, event_type, k FROM ev),
touches AS (SELECT client, ts, CASE event_type WHEN 'view' THEN 'en' WHEN 'click' THEN 'es' END AS lang FROM ev),
feedback AS (SELECT id, ts, day, id - 1 AS scan, client, CASE WHEN value < 5 THEN 'down' WHEN k >= 10 THEN 'up' END AS vote, CASE WHEN event_type = 'signup' THEN 'slow' END AS reason, CASE WHEN k > 95 THEN 'k' || k END AS comment, CASE WHEN k > 80 THEN 'p' || id END AS photo, k FROM ev WHERE event_type IN ('click', 'signup')),
cfg AS (SELECT (SELECT max(ts) FROM events) AS now)"""


def _scans(spark, d):
    return as_scans(T.raw(spark, d, "events"))


def as_scans(events):
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    status = F.create_map(
        *[F.lit(x) for x in ("view", "confident", "purchase", "confident", "click", "ambiguous", "signup", "insufficient", "error", "error")]
    )
    return e.select(
        F.col("event_id").alias("id"),
        "ts",
        F.to_date("ts").alias("day"),
        F.col("user_id").alias("client"),
        F.when(F.col("k") < 20, "manual").otherwise("camera").alias("kind"),
        F.element_at(status, F.col("event_type")).alias("status"),
        F.floor(F.col("value") * 100).cast("int").alias("total_ms"),
        F.col("k").alias("col"),
        "event_type",
        "k",
        "value",
    )


def _touches(spark, d):
    return as_touches(_scans(spark, d))


def as_touches(scans):
    lang = F.when(F.col("event_type") == "view", "en").when(F.col("event_type") == "click", "es")
    return scans.select("client", "ts", lang.alias("lang"))


def _feedback(spark, d):
    return as_feedback(_scans(spark, d))


def as_feedback(scans):
    e = scans.where(F.col("event_type").isin("click", "signup"))
    return e.select(
        "id",
        "ts",
        "day",
        (F.col("id") - 1).alias("scan"),
        "client",
        F.when(F.col("value") < 5, "down").when(F.col("k") >= 10, "up").alias("vote"),
        F.when(F.col("event_type") == "signup", "slow").alias("reason"),
        F.when(F.col("k") > 95, F.concat(F.lit("k"), "k")).alias("comment"),
        F.when(F.col("k") > 80, F.concat(F.lit("p"), "id")).alias("photo"),
        "k",
    )


def feedback_edits(f):
    """Two edits of each feedback, those of k from 70 by another client than wrote it."""
    mine = F.when(F.col("k") < 70, F.col("client")).otherwise(F.col("client") + 1)
    step = lambda i, comment, reason: f.select(
        "id",
        mine.alias("client"),
        (F.col("ts") + F.expr(f"INTERVAL {i} SECOND")).alias("ts"),
        reason.alias("reason"),
        comment.alias("comment"),
        F.lit(None).cast("string").alias("photo"),
    )
    return step(1, F.lit("first"), F.lit("other")).unionByName(
        step(2, F.when(F.col("k") < 30, "second"), F.lit(None).cast("string"))
    )


def _now(spark, d):
    return T.raw(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]


STAMP = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
STAMP_SQL = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"
DAY = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
DAY_SQL = "strftime({0}, '%Y-%m-%d') AS {0}"


@R.query(
    "upsert_clients",
    f"WITH {SCANS} SELECT client, {STAMP_SQL.format('first_seen')}, {STAMP_SQL.format('last_seen')}, lang FROM (SELECT client, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(lang, ts) FILTER (lang IS NOT NULL) AS lang FROM touches GROUP BY client)",
)
def _(spark, d):
    return usage.upsert_clients(_touches(spark, d)).select("client", STAMP("first_seen"), STAMP("last_seen"), "lang")


@R.query("active_days", f"WITH {SCANS} SELECT DISTINCT client, {DAY_SQL.format('day')} FROM ev")
def _(spark, d):
    return usage.active_days(_touches(spark, d)).select("client", DAY("day"))


@R.query(
    "record_scans",
    f"WITH {SCANS} SELECT conv_id, turn, strftime(ts, '%Y-%m-%d') AS day, substr(text, 1, 200) AS target, substr(text, 1, 4000) AS text FROM conversations JOIN ev ON ev.id = conv_id * 10 + turn",
)
def _(spark, d):
    c = T.raw(spark, d, "conversations").withColumn("id", F.col("conv_id") * 10 + F.col("turn")).withColumn("target", F.col("text"))
    raw = c.join(_scans(spark, d).select("id", "ts"), "id")
    return usage.record_scans(raw).select("conv_id", "turn", DAY("day"), "target", "text")


@R.query(
    "attach_navigation",
    f"""WITH {SCANS}, up AS (SELECT id, client, ts, 't' || k AS target, 1 AS s FROM ev WHERE event_type = 'purchase' UNION ALL
      SELECT id, CASE WHEN k < 50 THEN client ELSE client + 1 END, ts, 'u' || k, 2 FROM ev WHERE event_type = 'purchase')
    SELECT scans.id, scans.client, (SELECT arg_max(target, s) FROM up WHERE up.id = scans.id AND up.client = scans.client) AS target,
      (SELECT arg_max(s, s) FROM up WHERE up.id = scans.id AND up.client = scans.client)::VARCHAR AS nav FROM scans""",
)
def _(spark, d):
    s = _scans(spark, d)
    p = s.where(F.col("event_type") == "purchase").select(F.col("id").alias("scan"), "client", "ts", "k")
    step = lambda i, c, t: p.select(
        "scan", c.alias("client"), (F.col("ts") + F.expr(f"INTERVAL {i} SECOND")).alias("ts"), F.concat(F.lit(t), "k").alias("target"), F.lit(str(i)).alias("nav")
    )
    other = F.when(F.col("k") < 50, F.col("client")).otherwise(F.col("client") + 1)
    updates = step(1, F.col("client"), "t").unionByName(step(2, other, "u"))
    blank = s.withColumn("target", F.lit(None).cast("string")).withColumn("nav", F.lit(None).cast("string"))
    return usage.attach_navigation(blank, updates).select("id", "client", "target", "nav")


@R.query(
    "merge_feedback",
    f"""WITH {SCANS} SELECT id, CASE WHEN k < 70 THEN 'other' ELSE reason END AS reason, CASE WHEN k < 30 THEN 'second' WHEN k < 70 THEN 'first' ELSE comment END AS comment, photo FROM feedback""",
)
def _(spark, d):
    f = _feedback(spark, d)
    updates = feedback_edits(f)
    return usage.merge_feedback(f, updates).select("id", "reason", "comment", "photo")


@R.query(
    "delete_feedback",
    f"WITH {SCANS} SELECT id, reason IS NOT NULL AND k > 50 AS deleted, CASE WHEN reason IS NOT NULL AND k > 50 THEN photo END AS photo FROM feedback",
)
def _(spark, d):
    f = _feedback(spark, d)
    rest, photos = usage.delete_feedback(f, f.where(F.col("reason").isNotNull() & (F.col("k") > 50)))
    kept = rest.select("id", F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("photo"))
    return kept.unionByName(photos.select("id", F.lit(True).alias("deleted"), "photo"))


@R.query("exists_checks", f"WITH {SCANS} SELECT id, client FROM feedback WHERE id IN (SELECT id - 1 FROM feedback) OR id IN (SELECT id FROM scans WHERE client = feedback.client AND kind = 'manual')")
def _(spark, d):
    f, s = _feedback(spark, d), _scans(spark, d)
    refs = f.select("id", "client")
    pointed = usage.existing(refs, f.select(F.col("scan").alias("id"), "client"), guard_client=False)
    return pointed.unionByName(usage.existing(refs, s.where("kind = 'manual'"))).distinct()


RANGES_SQL = """rg AS (SELECT unnest(['today', 'week', 'month', 'total']) AS range, unnest([today, today - 6, today - 29, DATE '0001-01-01']) AS first FROM (SELECT strftime(now, '%Y-%m-%d')::DATE AS today FROM cfg))"""


@R.query(
    "range_stats",
    f"""WITH {SCANS}, {RANGES_SQL}
    SELECT range, (SELECT count(DISTINCT client) FROM ev WHERE day >= first) AS users, (SELECT count(*) FROM (SELECT client, min(ts) AS f FROM touches GROUP BY client) WHERE f >= first) AS new_users,
    (SELECT count(*) FROM scans WHERE day >= first) AS scans, {", ".join(f"(SELECT count(*) FROM scans WHERE day >= first AND status = '{s}') AS {n}" for s, n in (("confident", "confident"), ("ambiguous", "ambiguous"), ("insufficient", "insufficient"), ("error", "errors")))},
    (SELECT count(*) FROM feedback WHERE day >= first AND vote = 'up') AS up, (SELECT count(*) FROM feedback WHERE day >= first AND vote = 'down') AS down, (SELECT count(photo) FROM feedback WHERE day >= first) AS photos,
    (SELECT list_sort(list(total_ms))[count(*) // 2 + 1] FROM scans WHERE day >= first AND kind = 'camera') AS median_ms FROM rg""",
)
def _(spark, d):
    return usage.range_stats(_scans(spark, d), _feedback(spark, d), _touches(spark, d), _now(spark, d))


@R.query("upper_median", f"WITH {SCANS} SELECT client, list_sort(list(total_ms))[count(*) // 2 + 1] AS median FROM scans WHERE kind = 'camera' GROUP BY client")
def _(spark, d):
    return usage.upper_median(_scans(spark, d).where("kind = 'camera'"), ["client"], "total_ms")


@R.query(
    "day_series",
    f"""WITH {SCANS}, days AS (SELECT strftime(now, '%Y-%m-%d')::DATE - unnest(range(14))::INT AS day FROM cfg)
    SELECT strftime(days.day, '%Y-%m-%d') AS day, (SELECT count(DISTINCT client) FROM ev WHERE ev.day = days.day) AS users, (SELECT count(*) FROM (SELECT client, min(day) AS f FROM ev GROUP BY client) WHERE f = days.day) AS new_users,
    (SELECT count(*) FROM scans WHERE scans.day = days.day) AS scans, {", ".join(f"(SELECT count(*) FROM scans WHERE scans.day = days.day AND status = '{s}') AS {n}" for s, n in (("confident", "confident"), ("ambiguous", "ambiguous"), ("insufficient", "insufficient"), ("error", "errors")))},
    (SELECT count(*) FROM feedback WHERE feedback.day = days.day AND vote = 'up') AS up, (SELECT count(*) FROM feedback WHERE feedback.day = days.day AND vote = 'down') AS down FROM days""",
)
def _(spark, d):
    s = usage.day_series(_scans(spark, d), _feedback(spark, d), _touches(spark, d), _now(spark, d))
    return s.withColumn("day", DAY("day"))


@R.query("latest_scans", f"WITH {SCANS} SELECT id, client, kind, status, total_ms, col FROM scans ORDER BY ts DESC, id DESC LIMIT 40")
def _(spark, d):
    return usage.latest_scans(_scans(spark, d)).select("id", "client", "kind", "status", "total_ms", "col")


@R.query(
    "feedback_with_scan",
    f"WITH {SCANS} SELECT f.id, f.scan, f.vote, f.reason, f.comment, f.photo, s.status AS scan_status, s.kind AS scan_kind, s.col FROM (SELECT * FROM feedback ORDER BY ts DESC, id DESC LIMIT 60) f LEFT JOIN scans s ON s.id = f.scan",
)
def _(spark, d):
    j = usage.feedback_with_scan(_feedback(spark, d), _scans(spark, d).withColumn("nav", F.lit(None).cast("string")))
    return j.select("id", "scan", "vote", "reason", "comment", "photo", "scan_status", "scan_kind", "col")


@R.query(
    "rate_limit",
    f"""WITH {SCANS}, k AS (SELECT client, list([epoch_us(ts)] ORDER BY ts) AS l FROM ev GROUP BY client),
    o AS (SELECT client, unnest(list_reduce(l[2:], lambda a, x: CASE WHEN x[1] >= a[-1] + 21600000000 THEN list_append(a, x[1]) ELSE a END, l[1])) AS opener FROM k),
    j AS (SELECT ev.id, ev.client, o.opener, row_number() OVER (PARTITION BY ev.client, o.opener ORDER BY ts, id) AS nth FROM ev ASOF JOIN o ON ev.client = o.client AND epoch_us(ev.ts) >= o.opener)
    SELECT id, client, strftime(make_timestamp(opener), '%Y-%m-%d %H:%M:%S.%f') AS opened, nth <= 3 AS allowed FROM j""",
)
def _(spark, d):
    r = _scans(spark, d).select("id", "ts", F.col("client").alias("key"))
    return usage.rate_limit(r, 3, 6 * 3600).select("id", F.col("key").alias("client"), STAMP("opened"), "allowed")


@R.query("caller_key", "SELECT conv_id, turn, CASE WHEN trim(string_split(text, ',')[-1]) <> '' THEN trim(string_split(text, ',')[-1]) WHEN role <> '' THEN role ELSE 'local' END AS caller FROM conversations")
def _(spark, d):
    return T.raw(spark, d, "conversations").select("conv_id", "turn", usage.caller_key(F.col("text"), F.col("role")).alias("caller"))


@R.query(
    "feedback_rules",
    f"""WITH {SCANS}, x AS (SELECT f.id, f.vote, CASE WHEN f.k < 60 THEN f.reason END AS reason, f.comment, f.photo, s.id AS scan FROM feedback f LEFT JOIN (SELECT id FROM scans WHERE kind = 'camera') s ON s.id = f.scan)
    SELECT id, scan, vote IS NOT NULL OR reason IS NOT NULL OR comment IS NOT NULL OR photo IS NOT NULL AS accepted FROM x""",
)
def _(spark, d):
    reason = F.when(F.col("k") < 60, F.col("reason")).otherwise(F.lit("unlisted"))
    good, bad = usage.feedback_rules(_feedback(spark, d).withColumn("reason", reason), _scans(spark, d).where("kind = 'camera'"))
    return good.select("id", "scan", F.lit(True).alias("accepted")).unionByName(bad.select("id", "scan", F.lit(False).alias("accepted")))


@R.query("place_label", f"WITH {SCANS} SELECT id, concat_ws(' · ', coalesce(n_name, section::VARCHAR), CASE WHEN col > 0 THEN 'column ' || col END) AS label FROM (SELECT *, col % 40 AS section FROM scans) LEFT JOIN nation ON n_nationkey = section")
def _(spark, d):
    names = T.raw(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"))
    rows = _scans(spark, d).withColumn("section", F.col("col") % 40)
    return usage.place_label(rows, names).select("id", "label")


# ---- periods ----

PERIODS = """od AS (SELECT o_orderkey AS id, o_orderdate::DATE AS start_day, o_orderdate::DATE + (o_orderkey % 9)::INT AS end_day, o_orderpriority AS pr, o_orderstatus AS st, o_custkey AS cust FROM orders),
periods AS (SELECT id, CASE pr WHEN '1-URGENT' THEN 'holiday' WHEN '2-HIGH' THEN 'custom' ELSE 'week' END AS kind, start_day, end_day FROM od),
hd AS (SELECT 'h' || cust AS holiday, 5650 + id % 450 AS year, start_day AS first, end_day AS last FROM od WHERE pr = '1-URGENT'),
hp AS (SELECT holiday, year, holiday || '-' || year AS key, first - 7 AS start_day, last AS end_day FROM hd WHERE year BETWEEN 5700 AND 6000)"""


def _orders(spark, d):
    o = T.raw(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"),
        day.alias("start_day"),
        F.date_add(day, (F.col("o_orderkey") % 9).cast("int")).alias("end_day"),
        F.col("o_orderpriority").alias("pr"),
        F.col("o_orderstatus").alias("st"),
        F.col("o_custkey").alias("cust"),
    )


def _periods(spark, d):
    kind = F.when(F.col("pr") == "1-URGENT", "holiday").when(F.col("pr") == "2-HIGH", "custom").otherwise("week")
    return _orders(spark, d).select("id", kind.alias("kind"), "start_day", "end_day")


def _holidays(spark, d):
    o = _orders(spark, d).where(F.col("pr") == "1-URGENT")
    return o.select(
        F.concat(F.lit("h"), "cust").alias("holiday"), (F.col("id") % 450 + 5650).alias("year"), F.col("start_day").alias("first"), F.col("end_day").alias("last")
    )


def span():
    return [DAY("start_day"), DAY("end_day")]


SPAN_SQL = f"{DAY_SQL.format('start_day')}, {DAY_SQL.format('end_day')}"


@R.query(
    "week_period",
    f"""WITH {PERIODS}, w AS (SELECT id, st <> 'P' AND dayofweek(start_day) = 6 AS ok, start_day AS sat FROM od)
    SELECT id, CASE WHEN ok THEN strftime(sat - 6, '%Y-%m-%d') END AS start_day, CASE WHEN ok THEN strftime(sat, '%Y-%m-%d') END AS end_day FROM w""",
)
def _(spark, d):
    text = F.when(F.col("st") == "P", F.date_format("start_day", "yyyy/MM/dd")).otherwise(F.date_format("start_day", "yyyy-MM-dd"))
    o = _orders(spark, d).select("id", periods.week_period(text).alias("w"))
    return o.select("id", "w.*").select("id", *span())


@R.query(
    "upcoming_weeks",
    f"WITH {PERIODS}, dd AS (SELECT DISTINCT start_day AS day FROM od) SELECT strftime(day, '%Y-%m-%d') AS day, strftime(day + (6 - dayofweek(day))::INT + 7 * i::INT, '%Y-%m-%d') AS saturday FROM (SELECT day, unnest(range(3)) AS i FROM dd)",
)
def _(spark, d):
    days = _orders(spark, d).select(F.col("start_day").alias("day")).distinct()
    return periods.upcoming_weeks(days, 3).select(DAY("day"), DAY("saturday"))


@R.query("holiday_period", f"WITH {PERIODS} SELECT holiday, year, key, {SPAN_SQL} FROM hp")
def _(spark, d):
    return periods.holiday_periods(_holidays(spark, d)).select("holiday", "year", "key", *span())


@R.query("upcoming_holidays", f"WITH {PERIODS} SELECT holiday, year, key, {SPAN_SQL} FROM hp WHERE end_day >= DATE '{TODAY}' AND start_day <= DATE '{TODAY}' + 400")
def _(spark, d):
    return periods.upcoming_holidays(_holidays(spark, d), TODAY).select("holiday", "year", "key", *span())


@R.query(
    "week_name",
    f"""WITH {PERIODS}, sat AS (SELECT DISTINCT start_day AS saturday FROM od WHERE dayofweek(start_day) = 6),
    rd AS (SELECT saturday, string_agg('s' || n, '-' ORDER BY n) AS section FROM (SELECT DISTINCT start_day AS saturday, cust % 54 AS n FROM od WHERE pr = '5-LOW' AND dayofweek(start_day) = 6) GROUP BY ALL),
    ho AS (SELECT saturday, min(holiday) AS holiday FROM sat JOIN hd ON saturday BETWEEN first AND last GROUP BY ALL)
    SELECT strftime(saturday, '%Y-%m-%d') AS saturday, coalesce(holiday, section) AS name FROM sat LEFT JOIN ho USING (saturday) LEFT JOIN rd USING (saturday)""",
)
def _(spark, d):
    o = _orders(spark, d)
    sat = o.where(F.dayofweek("start_day") == periods.SATURDAY).select(F.col("start_day").alias("saturday"))
    n = F.col("cust") % 54
    readings = o.where(F.col("pr") == "5-LOW").select(F.col("start_day").alias("date"), n.alias("n"), F.concat(F.lit("s"), n).alias("section_name"))
    return periods.week_name(sat, readings, _holidays(spark, d)).select(DAY("saturday"), "name")


@R.query(
    "active_on_day",
    f"WITH {PERIODS} SELECT strftime(day, '%Y-%m-%d') AS day, id, kind FROM (SELECT DISTINCT start_day AS day FROM od) JOIN periods ON day BETWEEN start_day AND end_day",
)
def _(spark, d):
    p = _periods(spark, d)
    return periods.active_on(p.select(F.col("start_day").alias("day")), p).select(DAY("day"), "id", "kind")


@R.query(
    "upcoming_and_past",
    f"""WITH {PERIODS} SELECT 'upcoming' AS part, id, {SPAN_SQL} FROM periods WHERE end_day >= DATE '{TODAY}'
    UNION ALL SELECT * FROM (SELECT 'past', id, {SPAN_SQL} FROM periods WHERE periods.end_day < DATE '{TODAY}' ORDER BY periods.end_day DESC, id DESC LIMIT 10)""",
)
def _(spark, d):
    now, past = periods.upcoming_and_past(_periods(spark, d), TODAY)
    return now.select(F.lit("upcoming").alias("part"), "id", *span()).unionByName(past.select(F.lit("past").alias("part"), "id", *span()))


@R.query(
    "validated_insert",
    f"""WITH {PERIODS}, hk AS (SELECT key, min(start_day) AS hs, max(end_day) AS he FROM hp GROUP BY key),
    rq AS (SELECT id, CASE pr WHEN '1-URGENT' THEN 'holiday' WHEN '2-HIGH' THEN 'custom' ELSE 'week' END AS kind, CASE WHEN pr = '1-URGENT' THEN 'h' || cust || '-' || (5650 + id % 450) ELSE strftime(start_day, '%Y-%m-%d') END AS key, start_day, end_day, st, cust FROM od),
    v AS (SELECT rq.id, kind, CASE WHEN st = 'P' THEN 'name' WHEN kind = 'custom' AND cust % 3 = 0 AND rq.start_day <> rq.end_day THEN 'range' WHEN kind = 'week' AND dayofweek(rq.start_day) <> 6 THEN 'period' WHEN kind = 'holiday' AND hs IS NULL THEN 'period' END AS error,
      CASE kind WHEN 'custom' THEN (CASE WHEN cust % 3 = 0 THEN rq.end_day ELSE rq.start_day END) WHEN 'week' THEN (CASE WHEN dayofweek(rq.start_day) = 6 THEN rq.start_day - 6 END) ELSE hs END AS start_day,
      CASE kind WHEN 'custom' THEN (CASE WHEN cust % 3 = 0 THEN rq.start_day ELSE rq.end_day END) WHEN 'week' THEN (CASE WHEN dayofweek(rq.start_day) = 6 THEN rq.start_day END) ELSE he END AS end_day
      FROM rq LEFT JOIN hk ON kind = 'holiday' AND hk.key = rq.key)
    SELECT id, kind, error, {SPAN_SQL} FROM v""",
)
def _(spark, d):
    o = _orders(spark, d)
    kind = F.when(F.col("pr") == "1-URGENT", "holiday").when(F.col("pr") == "2-HIGH", "custom").otherwise("week")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    key = F.when(F.col("pr") == "1-URGENT", F.concat(F.lit("h"), "cust", F.lit("-"), F.col("id") % 450 + 5650)).otherwise(iso("start_day"))
    swap = F.col("cust") % 3 == 0
    rq = o.select(
        "id",
        kind.alias("kind"),
        key.alias("key"),
        F.when(swap, iso("end_day")).otherwise(iso("start_day")).alias("start"),
        F.when(swap, iso("start_day")).otherwise(iso("end_day")).alias("end"),
        F.when(F.col("st") == "P", "  ").otherwise(F.concat(F.lit(" c"), "cust")).alias("name"),
        F.lit(None).cast("string").alias("message"),
    )
    return periods.validate(rq, _holidays(spark, d)).select("id", "kind", "error", *span())


@R.query("delete_period", f"WITH {PERIODS} SELECT id, kind FROM periods WHERE id NOT IN (SELECT id FROM od WHERE st = 'F')")
def _(spark, d):
    gone = _orders(spark, d).where(F.col("st") == "F")
    return periods.delete(_periods(spark, d), gone).select("id", "kind")
