"""Checks and rules on small hand-made rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.functions import values
from lectern.operators import corpus, placement, usage


def test_missing_sections_are_reported(spark):
    sections = spark.createDataFrame([(1, 1, 0, 9), (1, 3, 10, 19), (2, 1, 0, 4), (2, 2, 6, 8), (3, 2, 0, 9)], "doc_id int, section int, start int, end int")
    words = spark.createDataFrame([(1, 19), (2, 9), (3, 9)], "doc_id int, pos int")
    got = {tuple(r) for r in corpus.contiguity_check(sections, words).collect()}
    assert got == {(1, 3, "missing"), (2, 2, "gap"), (3, 2, "missing")}


def test_lines_read_stand_for_visible_lines(spark):
    lines = list(range(0, 200, 5))
    row = spark.createDataFrame([(lines, [5] * 40, None)], "line_starts array<int>, line_tokens array<int>, visible int")
    assert placement.estimate_layout(row).head().words_per_column == 200


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_days_do_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = spark.range(1).select(F.timestamp_seconds(F.lit(1711846800)).alias("ts"))  # 2024-03-31 01:00 UTC, a clock change
        day = values.local_day("ts", "Europe/Berlin")
        r = t.select(day.alias("d"), F.unix_seconds(values.day_start(day, "Europe/Berlin")).alias("s"), values.local_day("ts", "America/New_York").alias("n")).head()
        assert (r.d, r.s, r.n) == (date(2024, 3, 31), 1711839600, date(2024, 3, 30))
        next_day = t.select(F.unix_seconds(values.day_start(F.lit(date(2024, 4, 1)), "Europe/Berlin")).alias("s")).head().s
        assert next_day == 1711922400
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_equal_times_have_one_answer(spark):
    at = datetime(2024, 1, 1)
    touches = spark.createDataFrame([("c", at, "de"), ("c", at, "en"), ("c", datetime(2023, 1, 1), "fr")], "client string, ts timestamp, lang string")
    for n in (1, 3):
        assert usage.upsert_clients(touches.repartition(n)).head().lang == "en"
    scans = spark.createDataFrame([("s", "c", "", "")], "id string, client string, target string, nav string")
    updates = spark.createDataFrame([("s", "c", at, "a", "x"), ("s", "c", at, "b", "x")], "scan string, client string, ts timestamp, target string, nav string")
    for n in (1, 3):
        assert usage.attach_navigation(scans, updates.repartition(n)).head().target == "b"


def test_many_marks_and_long_pages(spark):
    """Ten marks on a line and a page of 5,000 lines keep their order."""
    marks = [{"standard": str(n)} for n in (1, 2, 3, 4, 5, 6, 7, 1, 2, 3)]
    rows = [(1, 1, 1, [["a"]], [], marks, False), (1, 1, 2, [["b"]], [], [{"standard": "4"}], False)]
    rows += [(2, p, n, [["w"]], [], [], False) for p in (1, 2) for n in range(1, 5001)]
    schema = "doc_id int, page int, line int, text array<array<string>>, verses array<struct<book:int,chapter:int,verse:int>>, aliyot array<map<string,string>>, isPetucha boolean"
    lines = corpus.parse_lines(spark.createDataFrame(rows, schema))
    m = corpus.group_marks(corpus.line_marks(lines)).collect()
    assert sorted((r.grp, r.n) for r in m) == [(1, n) for n in range(1, 8)] + [(2, n) for n in range(1, 5)]
    off = {(r.page, r.line): r.offset for r in lines.where("doc_id = 2").collect()}
    assert all(off[p, n] == (p - 1) * 5000 + n - 1 for p in (1, 2) for n in range(1, 5001))


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {"spark.checkpoint.dir": None}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
