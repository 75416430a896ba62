"""Dated periods: weeks named by their Saturday, holidays with a lead, custom ranges.

periods: id, created, kind (week, holiday, custom), key, start_day, end_day, name, message.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate
from ..functions.values import MAX_MESSAGE, MAX_NAME, valid_day
from .joins import blocks

# Days a holiday shows before it starts, accepted years, look-ahead and list length.
LEAD_DAYS, FIRST_YEAR, LAST_YEAR, HORIZON_DAYS, PAST_ROWS = 7, 5700, 6000, 400, 10
SATURDAY = 7


def week_period(day: Column | str) -> Column:
    """struct(start_day, end_day) of the week ending on a well-formed Saturday, else null."""
    d = valid_day(day)
    return F.when(F.dayofweek(d) == SATURDAY, F.struct(F.date_sub(d, 6).alias("start_day"), d.alias("end_day")))


def upcoming_weeks(days: DataFrame, count: int, day: str = "day") -> DataFrame:
    """The next `count` Saturdays after each day, its own week first."""
    first = F.date_add(F.col(day), F.lit(SATURDAY) - F.dayofweek(day))
    steps = F.sequence(F.lit(0), F.lit(count - 1))
    return days.select("*", F.explode(F.transform(steps, lambda i: F.date_add(first, i * 7))).alias("saturday"))


def holiday_periods(holiday_days: DataFrame) -> DataFrame:
    """holiday, year, key, start_day, end_day from (holiday, year, first, last)."""
    h = holiday_days.where(F.col("year").between(FIRST_YEAR, LAST_YEAR))
    key = F.concat_ws("-", F.col("holiday"), F.col("year").cast("string"))
    return h.select("holiday", "year", key.alias("key"), F.date_sub("first", LEAD_DAYS).alias("start_day"), F.col("last").alias("end_day"))


def upcoming_holidays(holiday_days: DataFrame, today: date, days: int = HORIZON_DAYS) -> DataFrame:
    p = holiday_periods(holiday_days)
    return p.where((F.col("end_day") >= F.lit(today)) & (F.col("start_day") <= F.date_add(F.lit(today), days)))


def _covering(points: DataFrame, day: str, spans: DataFrame, start: str, end: str, size: int = 16) -> DataFrame:
    """Days joined to the spans that cover them, keyed by blocks of `size` days."""
    number = lambda c: F.datediff(F.col(c), F.lit(date(1970, 1, 1)))
    s = spans.withColumn("_b", F.explode(blocks(number(start), number(end), size)))
    p = points.withColumn("_b", F.floor(number(day) / size))
    return p.join(s, "_b").where((F.col(start) <= F.col(day)) & (F.col(day) <= F.col(end))).drop("_b")


def week_name(saturdays: DataFrame, readings: DataFrame, holiday_days: DataFrame) -> DataFrame:
    """saturday, name: the holiday covering it, else the sections read that day joined by '-'.

    `readings`: date, section_name, n; a day has one or two of them.
    """
    sat = saturdays.select("saturday").distinct()
    read = readings.join(sat, readings["date"] == sat["saturday"], "left_semi").select(
        F.col("date").alias("saturday"), F.struct("n", "section_name").alias("s")
    ).distinct()
    read = read.groupBy("saturday").agg(F.sort_array(F.collect_list("s")).alias("s"))
    read = read.select("saturday", F.array_join(F.transform("s", lambda x: x["section_name"]), "-").alias("section"))
    hol = _covering(sat, "saturday", holiday_days, "first", "last").groupBy("saturday").agg(F.min("holiday").alias("holiday"))
    j = sat.join(hol, "saturday", "left").join(read, "saturday", "left")
    return j.select("saturday", F.coalesce("holiday", "section").alias("name"))


def active_on(days: DataFrame, periods: DataFrame) -> DataFrame:
    """day, id, kind and dates of every period showing on each day."""
    return _covering(days.select("day").distinct(), "day", periods, "start_day", "end_day")


def active_today(periods: DataFrame, today: date) -> DataFrame:
    """Periods showing on a day: holidays first, then by start and id."""
    p = periods.where((F.col("start_day") <= F.lit(today)) & (F.col("end_day") >= F.lit(today)))
    return p.orderBy(F.desc(F.col("kind") == "holiday"), "start_day", "id")


def upcoming_and_past(periods: DataFrame, today: date, past: int = PAST_ROWS) -> tuple[DataFrame, DataFrame]:
    now = periods.where(F.col("end_day") >= F.lit(today)).orderBy("start_day", "id")
    return now, periods.where(F.col("end_day") < F.lit(today)).orderBy(F.desc("end_day"), F.desc("id")).limit(past)


def validate(requests: DataFrame, holiday_days: DataFrame) -> DataFrame:
    """Requests (id, kind, key, start, end, name, message) with their period and the `error` that rejects them, if any."""
    h = holiday_periods(holiday_days).select(
        F.col("key").alias("_key"), F.col("start_day").alias("_hs"), F.col("end_day").alias("_he")
    )
    h = h.groupBy("_key").agg(F.min("_hs").alias("_hs"), F.max("_he").alias("_he"))
    r = requests.join(h, (requests["kind"] == "holiday") & (requests["key"] == h["_key"]), "left")
    week = week_period("key")
    custom = F.col("kind") == "custom"
    start = F.when(custom, valid_day("start")).when(F.col("kind") == "week", week["start_day"]).otherwise(F.col("_hs"))
    end = F.when(custom, valid_day("end")).when(F.col("kind") == "week", week["end_day"]).otherwise(F.col("_he"))
    r = r.withColumns({"start_day": start, "end_day": end, "name": truncate("name", MAX_NAME), "message": truncate("message", MAX_MESSAGE)})
    ok = F.col("start_day").isNotNull() & F.col("end_day").isNotNull() & (F.col("end_day") >= F.col("start_day"))
    error = F.when(F.col("name").isNull(), "name").when(~ok & custom, "range").when(~ok, "period")
    return r.withColumn("error", error).withColumn("key", F.when(~custom, F.col("key"))).drop("_key", "_hs", "_he", "start", "end")


def insert(periods: DataFrame, validated: DataFrame) -> DataFrame:
    good = validated.where(F.col("error").isNull()).select("id", "kind", "key", "start_day", "end_day", "name", "message")
    return periods.select(*good.columns).unionByName(good)


def delete(periods: DataFrame, ids: DataFrame) -> DataFrame:
    return periods.join(ids.select("id"), "id", "left_anti")
