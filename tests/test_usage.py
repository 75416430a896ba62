import random
from datetime import date, datetime, timedelta

from lectern.operators import evaluate, navigate, order, periods, series, usage


def test_rate_limit_anchored_window(spark):
    t = datetime(2026, 1, 1)
    rows = [(i, "k", t) for i in range(4)] + [(4, "k", t + timedelta(seconds=60))]
    r = spark.createDataFrame(rows, "id int, key string, ts timestamp")
    got = [x.allowed for x in usage.rate_limit(r, 3, 60).orderBy("id").collect()]
    assert got == [True, True, True, False, True]


def test_rate_limit_hot_key_equals_plain(spark):
    rnd = random.Random(2)
    t, rows = datetime(2026, 1, 1), []
    for i in range(400):
        t += timedelta(seconds=rnd.choice([0, 1, 7, 30, 200]))
        rows.append((i, "hot", t))
    want, reset, count = [], datetime(1970, 1, 1), 0
    for _, _, ts in rows:
        if reset <= ts:
            reset, count = ts + timedelta(seconds=60), 0
        count += 1
        want.append(count <= 3)
    r = spark.createDataFrame(rows, "id int, key string, ts timestamp")
    for bound in (10, 100_000):
        assert [x.allowed for x in usage.rate_limit(r, 3, 60, bound).orderBy("id").collect()] == want


def test_upper_median_and_previous(spark):
    v = spark.createDataFrame([("a", 2000), ("a", 3000), ("b", 5)], "k string, v int")
    assert {r.k: r.median for r in order.upper_median(v, ["k"], "v").collect()} == {"a": 3000, "b": 5}
    rows = [("a", i, i if i % 5 == 0 else None) for i in range(40)]
    p = order.previous_value(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], "o", "v", "p", chunk=4)
    assert {r.o: r.p for r in p.collect()} == {i: ((i - 1) // 5 * 5 if i else None) for i in range(40)}


def test_feedback_guard(spark):
    f = spark.createDataFrame([(1, "a", None, "old", None)], "id int, client string, reason string, comment string, photo string")
    u = spark.createDataFrame(
        [(1, "a", datetime(2026, 1, 2), "slow", None, None), (1, "b", datetime(2026, 1, 3), "other", "x", "y")],
        "id int, client string, ts timestamp, reason string, comment string, photo string",
    )
    assert tuple(usage.merge_feedback(f, u).select("reason", "comment", "photo").first()) == ("slow", "old", None)


def test_periods(spark):
    w = spark.createDataFrame([("2026-10-10",), ("2026-10-11",), ("2026-02-30",)], "d string").select(periods.week_period("d").alias("w"))
    got = [r.w and (r.w.start_day, r.w.end_day) for r in w.collect()]
    assert got == [(date(2026, 10, 4), date(2026, 10, 10)), None, None]
    h = spark.createDataFrame([("spring", 5787, date(2027, 4, 22), date(2027, 4, 29))], "holiday string, year int, first date, last date")
    assert periods.holiday_periods(h).first().start_day == date(2027, 4, 15)


def test_learned_and_consistency(spark):
    rows = [("c", datetime(2026, 1, 1) + timedelta(hours=9 * i), i, 100.0 + i) for i in range(12)]
    e = spark.createDataFrame(rows, "client string, ts timestamp, id int, wpc double")
    got = [r.learned for r in navigate.learned_wpc(e).orderBy("id").collect()]
    mean = lambda i: sum(100 + j for j in range(max(0, i - 4), i + 1)) / min(5, i + 1)
    assert got == [int(mean(i) + 0.5) for i in range(12)]
    r = spark.createDataFrame([("s", 1, "confident", 5), ("s", 2, "ambiguous", 1), ("s", 3, "confident", 4)], "set string, ord int, status string, start int")
    assert [x.backwards for x in evaluate.order_consistency(r, 2).orderBy("ord").collect()] == [False, False, True]


def test_collapse_runs(spark):
    logp = lambda c, p=0.0: [p if i == c else -9.0 for i in range(4)]
    steps = [logp(1), logp(1), logp(0), logp(1), logp(3), logp(0), logp(3), logp(2, -2.0)]
    f = spark.createDataFrame([(1, i, x) for i, x in enumerate(steps)], "series int, step int, logp array<double>")
    assert series.collapse_runs(f, "ab ").first().text == "aa ?"
