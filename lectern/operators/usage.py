"""Usage analytics over the log of scans and feedback.

scans: id, ts, day, client, kind, status, lines, total_ms, col, nav, target, text, lang.
feedback: id, ts, day, scan, client, vote, reason, comment, photo, lang.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values
from ..functions.text import truncate
from ..session import checkpoint
from .order import upper_median

STATUSES = ("confident", "ambiguous", "insufficient", "error")


def _last(value: str, ts: str) -> Column:
    """Latest value that is not null; of values of one instant, the largest, so that retries agree."""
    return F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("at"), F.col(value).alias("is"))))["is"]


def upsert_clients(touches: DataFrame) -> DataFrame:
    """client, first_seen, last_seen, lang from (client, ts, lang) touches; null clients are not counted."""
    t = touches.where(F.col("client").isNotNull())
    return t.groupBy("client").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), _last("lang", "ts").alias("lang"))


def active_days(touches: DataFrame, tz: str = "UTC") -> DataFrame:
    t = touches.where(F.col("client").isNotNull())
    return t.select("client", values.local_day("ts", tz).alias("day")).distinct()


def record_scans(raw: DataFrame, tz: str = "UTC") -> DataFrame:
    """Rows ready to append: the day derived, free text cut, empty text null."""
    return raw.withColumns(
        {
            "day": values.local_day("ts", tz),
            "target": F.substring("target", 1, values.MAX_TARGET),
            "text": F.substring("text", 1, values.MAX_TEXT),
        }
    )


def attach_navigation(scans: DataFrame, updates: DataFrame) -> DataFrame:
    """Set target and nav of each scan to the latest update (scan, client, ts, target, nav) by the same client."""
    u = updates.withColumnRenamed("client", "_client").select(
        F.col("scan").alias("id"), "_client", F.struct("target", "nav").alias("_u"), F.col("ts").alias("_ts")
    )
    u = u.groupBy("id", "_client").agg(F.max_by("_u", F.struct("_ts", F.to_json("_u"))).alias("_u"))
    j = scans.join(u, (scans["id"] == u["id"]) & scans["client"].eqNullSafe(u["_client"]), "left").drop(u["id"])
    hit = F.col("_u").isNotNull()
    return j.withColumns(
        {
            "target": F.when(hit, F.substring("_u.target", 1, values.MAX_TARGET)).otherwise(F.col("target")),
            "nav": F.when(hit, F.col("_u.nav")).otherwise(F.col("nav")),
        }
    ).drop("_u", "_client")


def merge_feedback(feedback: DataFrame, updates: DataFrame) -> DataFrame:
    """Fold updates (id, client, ts, reason, comment, photo) into feedback; only the same client may, nulls change nothing.

    Updates are folded per (id, client) first, so the join adds one row per feedback however often it was edited.
    """
    fields = ["reason", "comment", "photo"]
    u = updates.groupBy("id", "client").agg(*[_last(f, "ts").alias(f"_{f}") for f in fields])
    u = u.withColumnRenamed("id", "_id").withColumnRenamed("client", "_client")
    j = feedback.join(u, (feedback["id"] == u["_id"]) & feedback["client"].eqNullSafe(u["_client"]), "left")
    return j.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop("_id", "_client", *[f"_{f}" for f in fields])


def delete_feedback(feedback: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, photo references of the deleted ones)."""
    ids = deletes.select("id")
    return feedback.join(ids, "id", "left_anti"), feedback.join(ids, "id", "left_semi").select("id", "photo")


def existing(refs: DataFrame, rows: DataFrame, guard_client: bool = True) -> DataFrame:
    """Of (id, client) references, those that exist in `rows`, by the same (possibly null) client."""
    r = rows.select(F.col("id").alias("_id"), F.col("client").alias("_client"))
    on = refs["id"] == r["_id"]
    if guard_client:
        on = on & refs["client"].eqNullSafe(r["_client"])
    return refs.join(r, on, "left_semi")


def _status_counts() -> list[Column]:
    names = {"confident": "confident", "ambiguous": "ambiguous", "insufficient": "insufficient", "error": "errors"}
    return [F.count(F.lit(1)).alias("scans")] + [F.count_if(F.col("status") == s).alias(n) for s, n in names.items()]


def _feedback_counts() -> list[Column]:
    return [
        F.count_if(F.col("vote") == "up").alias("up"),
        F.count_if(F.col("vote") == "down").alias("down"),
        F.count_if(F.col("photo").isNotNull()).alias("photos"),
    ]


def ranges(today: date) -> dict[str, date | None]:
    """First day of each report range, None for all time; they all end now."""
    return {"today": today, "week": today - timedelta(6), "month": today - timedelta(29), "total": None}


def _since(day: str, first: date | None) -> Column:
    return F.lit(True) if first is None else F.coalesce(F.col(day) >= F.lit(first), F.lit(False))


def _range_rows(starts: dict[str, date | None], day: str) -> Column:
    """The ranges a day belongs to, for exploding rows that are already summed per day."""
    return F.explode(
        F.filter(F.array(*[F.when(_since(day, d), F.lit(n)) for n, d in starts.items()]), lambda x: x.isNotNull())
    )


def range_stats(scans: DataFrame, feedback: DataFrame, touches: DataFrame, now: datetime, tz: str = "UTC") -> DataFrame:
    """One row per range: users, new users, scans by status, votes, photos and the median camera time.

    The log is summed to days and to clients first. All ranges end now, so a client is active in a range if its last
    day is: no distinct count per range.
    """
    spark = scans.sparkSession
    local = spark.range(1).select(values.local_day(F.lit(now), tz).alias("d")).first()["d"]
    starts = ranges(local)
    names = spark.createDataFrame([(n,) for n in starts], "range string")
    clients = touches.where(F.col("client").isNotNull()).groupBy("client").agg(
        F.max(values.local_day("ts", tz)).alias("last_day"), F.min("ts").alias("first_seen")
    )
    flags = [F.count_if(_since("last_day", d)).alias(f"u_{n}") for n, d in starts.items()]
    for n, d in starts.items():
        fresh = F.lit(True) if d is None else F.col("first_seen") >= values.day_start(F.lit(d), tz)
        flags.append(F.count_if(fresh).alias(f"n_{n}"))
    pairs = [F.struct(F.lit(n).alias("range"), F.col(f"u_{n}").alias("users"), F.col(f"n_{n}").alias("new_users")) for n in starts]
    users = clients.agg(*flags).select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    daily = scans.groupBy("day").agg(*_status_counts())
    s = daily.select("*", _range_rows(starts, "day").alias("range")).groupBy("range").agg(
        *[F.sum(c).alias(c) for c in ("scans", "confident", "ambiguous", "insufficient", "errors")]
    )
    fb = feedback.groupBy("day").agg(*_feedback_counts())
    fb = fb.select("*", _range_rows(starts, "day").alias("range")).groupBy("range").agg(
        *[F.sum(c).alias(c) for c in ("up", "down", "photos")]
    )
    times = scans.where(F.col("kind") == "camera").groupBy("day", "total_ms").agg(F.count(F.lit(1)).alias("c"))
    times = times.select("total_ms", "c", _range_rows(starts, "day").alias("range"))
    med = upper_median(times, ["range"], "total_ms", "c").withColumnRenamed("median", "median_ms")
    out = names.join(users, "range", "left").join(s, "range", "left").join(fb, "range", "left").join(med, "range", "left")
    return out.na.fill(0, [c for c in out.columns if c not in ("range", "median_ms")])


def day_series(scans: DataFrame, feedback: DataFrame, touches: DataFrame, now: datetime, days: int = 14, tz: str = "UTC") -> DataFrame:
    """The last `days` local days, zero-filled: users, new users, scans by status, votes."""
    spark = scans.sparkSession
    today = values.local_day(F.lit(now), tz)
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    users = active_days(touches, tz).groupBy("day").agg(F.count(F.lit(1)).alias("users"))
    fresh = upsert_clients(touches).groupBy(values.local_day("first_seen", tz).alias("day")).agg(F.count(F.lit(1)).alias("new_users"))
    s = scans.groupBy("day").agg(*_status_counts())
    fb = feedback.groupBy("day").agg(*_feedback_counts()[:2])
    out = spine
    for part in (users, fresh, s, fb):
        out = out.join(part, "day", "left")
    return out.na.fill(0)


def latest_scans(scans: DataFrame, n: int = 40) -> DataFrame:
    return scans.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def feedback_with_scan(feedback: DataFrame, scans: DataFrame, n: int = 60) -> DataFrame:
    """The latest feedback with its scan. The cut comes before the join: a scan id is unique, so it adds no rows."""
    f = feedback.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    s = scans.select(F.col("id").alias("scan"), F.col("status").alias("scan_status"), F.col("kind").alias("scan_kind"), "col", "nav")
    return f.join(s, "scan", "left")


def caller_key(forwarded: Column, real_ip: Column, fallback: str = "local") -> Column:
    """Last entry of the forwarding header, else the direct address, else a constant."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(F.trim(F.element_at(F.split(forwarded, ","), -1))), some(real_ip), F.lit(fallback))


def feedback_rules(submitted: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): something must be said; bad enums become null; an unknown scan becomes null."""
    known = scans.select(F.col("id").alias("scan"), F.lit(True).alias("_known"))
    s = submitted.withColumns(
        {
            "vote": values.one_of("vote", values.VOTES),
            "reason": values.one_of("reason", values.REASONS),
            "comment": truncate("comment", values.MAX_COMMENT),
        }
    ).join(known, "scan", "left")
    s = s.withColumn("scan", F.when(F.col("_known"), F.col("scan"))).drop("_known")
    said = F.coalesce("vote", "reason", "comment", "photo").isNotNull()
    return s.where(said), s.where(~said)


def place_label(rows: DataFrame, sections: DataFrame, column_word: str = "column") -> DataFrame:
    """`label`: section name and column, joined by a middle dot; missing parts are left out."""
    names = sections.select(F.col("n").alias("section"), F.col("name").alias("_name"))
    j = rows.join(names, "section", "left")
    section = F.coalesce("_name", F.col("section").cast("string"))
    column = F.when(F.col("col") > 0, F.concat(F.lit(f"{column_word} "), F.col("col")))
    return j.withColumn("label", F.concat_ws(" · ", section, column)).drop("_name")


# ---- rate limit ----


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts))


def window_openers(requests: DataFrame, window_us: int, fold_rows: int = 100_000) -> DataFrame:
    """key, opener (microseconds): requests that open a fixed window, anchored at the key's first request.

    A request opens a window when the last one ended at or before it, so openers form a chain. Keys of at most
    `fold_rows` distinct instants are folded in one row each; larger ones go through `_chain`, which never brings a key
    into one task.
    """
    t = requests.select("key", _micros("ts").alias("t")).distinct()
    size = t.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    small = t.join(size.where(F.col("n") <= fold_rows).select("key"), "key", "left_semi")
    nothing = F.array().cast("array<bigint>")
    fold = F.aggregate(
        F.array_sort(F.col("ts")),
        nothing,
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (x >= F.try_element_at(acc, F.lit(-1)) + window_us), F.concat(acc, F.array(x))
        ).otherwise(acc),
    )
    few = small.groupBy("key").agg(F.collect_list("t").alias("ts")).select("key", F.explode(fold).alias("opener"))
    hot = size.where(F.col("n") > fold_rows).select("key")
    if hot.isEmpty():
        return few
    return few.unionByName(_chain(t.join(hot, "key", "left_semi"), window_us))


def _successors(t: DataFrame, window_us: int) -> DataFrame:
    """key, t, nxt: the first instant at least one window later. Work is split by key and window-long slice of time."""
    rows = t.withColumn("s", F.floor(F.col("t") / window_us))
    by_slice = W.partitionBy("key").orderBy("s")
    slices = rows.groupBy("key", "s").agg(F.min("t").alias("first"))
    nearest = F.lead(F.struct("s", "first")).over(by_slice)
    after = F.lead(F.struct("s", "first"), 2).over(by_slice)
    slices = slices.select("key", "s", nearest.alias("a"), after.alias("b"))
    later = F.when(F.col("a.s") > F.col("s") + 1, F.col("a.first")).otherwise(F.col("b.first"))
    probes = rows.select("key", (F.col("s") + 1).alias("s"), (F.col("t") + window_us).alias("at"), F.col("t").alias("src"))
    marks = rows.select("key", "s", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("src"))
    backward = W.partitionBy("key", "s").orderBy(F.desc("at"), F.col("src").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("src").isNull(), F.col("at")), ignorenulls=True).over(backward)
    found = probes.unionByName(marks).withColumn("nxt", seen).where(F.col("src").isNotNull())
    found = found.select("key", (F.col("s") - 1).alias("s"), F.col("src").alias("t"), "nxt")
    j = found.join(slices.select("key", "s", later.alias("later")), ["key", "s"])
    return j.select("key", "t", F.coalesce("nxt", "later").alias("nxt"))


def _chain(t: DataFrame, window_us: int) -> DataFrame:
    """Openers by doubling: after r rounds every opener up to 2**r links from the first is known."""
    jump = checkpoint(_successors(t, window_us))
    span = t.groupBy("key").agg((F.max("t") - F.min("t")).alias("d")).agg(F.max("d")).first()[0]
    rounds = max(1, int(span // window_us + 1).bit_length())
    known = t.groupBy("key").agg(F.min("t").alias("t"))
    for _ in range(rounds):
        hop = known.join(jump, ["key", "t"]).where(F.col("nxt").isNotNull()).select("key", F.col("nxt").alias("t"))
        known = checkpoint(known.unionByName(hop).distinct())
        twice = jump.select("key", F.col("t").alias("_t"), F.col("nxt").alias("t")).join(jump, ["key", "t"], "left")
        jump = checkpoint(twice.select("key", F.col("_t").alias("t"), "nxt"))
    return known.select("key", F.col("t").alias("opener"))


def rate_limit(requests: DataFrame, limit: int, window_seconds: int, fold_rows: int = 100_000) -> DataFrame:
    """requests (key, ts, id) with `opener` and `allowed`: the first `limit` requests of each window pass."""
    us = window_seconds * 1_000_000
    openers = window_openers(requests, us, fold_rows)
    slot = F.floor(F.col("opener") / us)
    o = openers.select("key", "opener", F.explode(F.array(slot, slot + 1)).alias("s"))
    r = requests.withColumn("_t", _micros("ts")).withColumn("s", F.floor(F.col("_t") / us))
    j = r.join(o, ["key", "s"]).where((F.col("opener") <= F.col("_t")) & (F.col("_t") < F.col("opener") + us))
    nth = F.row_number().over(W.partitionBy("key", "opener").orderBy("_t", "id"))
    return j.withColumn("allowed", nth <= limit).withColumn("opened", F.timestamp_micros("opener")).drop("s", "_t", "opener")
