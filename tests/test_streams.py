"""Stateful streams give what one batch gives, however the log is cut; rows that come too late are counted."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

from lectern.operators import navigate, usage
from lectern.streaming import jobs, stateful

START = dt.datetime(2024, 3, 9, 12)


def log(spark, n, keys, days, extra=lambda i: 0.0):
    rng = random.Random(6)
    rows = [(rng.choice(keys), START + dt.timedelta(seconds=rng.randrange(int(days * 86400))), i, extra(i)) for i in range(n)]
    rows += [(k, START + dt.timedelta(days=days / 2), n + i, extra(i)) for i, k in enumerate(keys * 3)]  # equal times
    return rows, spark.createDataFrame(rows, "key string, ts timestamp, id bigint, wpc double")


def test_rate_limit_over_ten_mixed_batches_equals_one_batch(spark):
    _, requests = log(spark, 300, ["a", "a", "b", "c"], 3)
    requests = requests.select("key", "ts", "id")
    want = {r.id: r.allowed for r in usage.rate_limit(requests, 3, 6 * 3600).collect()}
    stream = stateful.rate_limit(jobs.log_in_batches(requests, "ts", 10, "20 hours"), 3, 6 * 3600, "1 day")
    out = jobs.run_to_table(stream).collect()
    assert {r.id: r.allowed for r in out} == want and len(out) == len(want)
    assert 0 < sum(want.values()) < len(want) and len({r.batch for r in out}) > 1


def test_last_values_over_ten_mixed_batches_equal_the_window(spark):
    rows, estimates = log(spark, 120, ["a", "a", "b"], 4, lambda i: float(40 + i * 7 % 90))
    stream = stateful.learned_wpc(jobs.log_in_batches(estimates.withColumnRenamed("key", "client"), "ts", 10, "20 hours"), "1 day")
    got = {r.id: r.learned for r in jobs.run_to_table(stream).collect()}
    want = {}
    for k in ("a", "b"):
        mine = sorted((t, i, w) for key, t, i, w in rows if key == k)
        for n, (_, i, _) in enumerate(mine):
            last = [w for *_, w in mine[max(0, n - navigate.LEARN_LAST + 1) : n + 1]]
            m = int(sum(last) / len(last) + 0.5)
            want[i] = m if navigate.LEARN_MIN < m < navigate.LEARN_MAX else None
    assert got == want


def test_a_log_in_batches_is_cut_at_its_batches_however_many_files_they_have(spark, monkeypatch):
    """Three files a batch; a batch of the log without rows and one with fewer than files are batches too."""
    monkeypatch.setattr(jobs, "ROWS", 10)
    _, requests = log(spark, 240, ["a", "b"], 2)
    few = spark.createDataFrame([("a", START + dt.timedelta(days=20), 900, 0.0)], requests.schema)
    requests = requests.union(few).select("key", "ts", "id")
    stream = jobs.log_in_batches(requests, "ts", 10, "1 hour")
    heard = stateful.LateRows()
    out = jobs.run_to_table(stateful.rate_limit(stream, 3, 6 * 3600, "2 hours"), late=heard).collect()
    want = {r.id: r.allowed for r in usage.rate_limit(requests, 3, 6 * 3600).collect()}
    assert {r.id: r.allowed for r in out} == want and len(out) == len(want) and not sum(heard.batches.values())
    assert len(heard.batches) >= 11


def test_keys_share_rows_of_state_and_may_be_null(spark, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 4)
    _, requests = log(spark, 300, [*map(str, range(40)), None], 3)
    # Beyond what a fraction holds exactly.
    requests = requests.selectExpr("cast(key as bigint) + 9007199254740992 as key", "ts", "id")
    calls, plain = spark.sparkContext.accumulator(0), stateful.InOrder.__call__

    def counted(self, bucket, frames, state):
        calls.add(1)
        return plain(self, bucket, frames, state)

    monkeypatch.setattr(stateful.InOrder, "__call__", counted)
    stream = stateful.rate_limit(jobs.log_in_batches(requests, "ts", 4, "20 hours"), 3, 6 * 3600, "1 day")
    out = {(r.key, r.id): r.allowed for r in jobs.run_to_table(stream).collect()}
    assert {(r.key, r.id) for r in requests.collect()} == set(out)
    known = requests.where("key is not null")
    assert {r.id: r.allowed for r in usage.rate_limit(known, 3, 6 * 3600).collect()} == {i: x for (k, i), x in out.items() if k is not None}


def test_feedback_meets_scans_as_in_a_batch(spark):
    """A scan in time, too early, later than its feedback, twice, and none; no scan named; times to the microsecond."""
    t = lambda h, us=0: START + dt.timedelta(hours=h, microseconds=us)
    scans = [(1, t(0, 1), "s1"), (2, t(1), "s2"), (3, t(9), "s3"), (4, t(5), "s4"), (4, t(6), "s5"), (6, t(50), "s6"), (None, t(7), "s7")]
    feedback = [(11, t(24, 1), 1, "up"), (12, t(25, 1), 2, None), (13, t(8), 3, "up"), (14, t(7), 4, "up"), (15, t(30), 5, "down"), (16, t(50), 6, "up"), (17, t(7), None, "up")]
    rows = [(True, t_, i, None, x, None) for i, t_, x in scans] + [(False, t_, i, s, None, v) for i, t_, s, v in feedback]
    all_rows = spark.createDataFrame(rows, "scanned boolean, ts timestamp, id bigint, scan bigint, status string, vote string")
    one = jobs.log_in_batches(all_rows, "ts", 3, "20 hours")
    s = one.where("scanned").selectExpr("id", "ts", "status", "'k' as kind")
    out = jobs.run_to_table(jobs.feedback_joined(one.where("not scanned").select("id", "ts", "scan", "vote"), s)).collect()
    far = t(0).year + 20
    got = sorted((r.id, r.ts, r.vote, r.scan_ts, r.scan_status or "") for r in out if r.ts.year < far)
    assert got == [
        (11, t(24, 1), "up", t(0, 1), "s1"),
        (12, t(25, 1), None, None, ""),
        (13, t(8), "up", None, ""),
        (14, t(7), "up", t(5), "s4"),
        (14, t(7), "up", t(6), "s5"),
        (15, t(30), "down", None, ""),
        (16, t(50), "up", t(50), "s6"),
        (17, t(7), "up", None, ""),
    ]


def test_clients_per_local_day_and_late_rows(spark, tmp_path):
    """Days of New York over the change to summer time; a batch brings two rows of a day that is over."""
    zone = "America/New_York"
    rows, touches = log(spark, 60, ["a", "b", "c", "d"], 3)
    path = f"file://{tmp_path}/log"
    on_time = touches.select("ts", "id", "key").toDF("ts", "id", "client")
    on_time.coalesce(1).write.mode("append").parquet(path)
    for ts in (START + dt.timedelta(days=9), START + dt.timedelta(days=30)):
        spark.createDataFrame([(ts, -1, "z")], on_time.schema).coalesce(1).write.mode("append").parquet(path)
        late = [(START + dt.timedelta(hours=1), -2, "late"), (START + dt.timedelta(hours=40), -3, "late")]
    spark.createDataFrame(late, on_time.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(on_time.schema).option("maxFilesPerTrigger", 1).parquet(path)
    heard = stateful.LateRows()
    out = jobs.run_to_table(stateful.active_clients(stream, zone, "1 day"), late=heard).collect()
    want = {}
    for key, ts, _, _ in rows:
        day = ts.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(zone)).date()
        want.setdefault(day, set()).add(key)
    want[(START + dt.timedelta(days=9)).date()] = {"z"}
    assert {r.day: r.clients for r in out} == {d: len(c) for d, c in want.items()}
    table = heard.table(spark).collect()
    assert sum(r.dropped for r in table) == 2 and len(table) >= 4
