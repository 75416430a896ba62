"""Operators on tables of series: points (series, x, v) with consecutive integer x from 0, and class frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .joins import prefix_sums
from .order import order_statistics, previous_value

# Period detection.
MIN_LAG, STRONG_PEAK, HALF_TOLERANCE, HALF_OVERALL, HALF_OWN, HALF_OWN_SHARE = 6, 0.5, 0.1, 0.15, 0.4, 0.5
# Bands, peaks, stretch, runs and lines.
BAND_FLOOR, BAND_SHARE, BAND_WIDTH = 0.02, 0.5, 0.55
PEAK_DISTANCE, PEAK_REACH, PEAK_HEIGHT, PEAK_PROMINENCE, PEAK_QUANTILE = 0.6, 0.9, 0.15, 0.12, 0.25
STRETCH_LOW, STRETCH_HIGH, STRETCH_MIN = 0.5, 0.995, 0.05
RUN_PROBABILITY, UNSURE_BELOW, MAX_LINES = 0.5, 0.6, 60


def autocorrelation(points: DataFrame, min_lag: int = MIN_LAG) -> DataFrame:
    """grp, series, lag, o: mean-removed autocorrelation, 1 at lag 0, for lags up to a third of the length.

    Lagged pairs meet by an equi-join on (series, x) and are summed before the shuffle. `points`: grp, series, x, v.
    """
    stats = points.groupBy("grp", "series").agg(F.avg("v").alias("_m"), (F.max("x") + 1).alias("_n"))
    p = points.join(stats, ["grp", "series"]).withColumn("c", F.col("v") - F.col("_m"))
    norm = p.groupBy("grp", "series").agg(F.sum(F.col("c") * F.col("c")).alias("_norm")).where("_norm > 0")
    last = F.floor(F.col("_n") / 3).cast("int")
    lagged = p.where(last > min_lag + 2).select("grp", "series", "x", "c", F.explode(F.sequence(F.lit(min_lag), last + 1)).alias("lag"))
    lagged = lagged.withColumn("x", F.col("x") + F.col("lag"))
    other = p.select("grp", "series", "x", F.col("c").alias("c2"))
    s = lagged.join(other, ["grp", "series", "x"]).groupBy("grp", "series", "lag").agg(F.sum(F.col("c") * F.col("c2")).alias("s"))
    return s.join(norm, ["grp", "series"]).select("grp", "series", "lag", F.round(F.col("s") / F.col("_norm"), 9).alias("o"))


def neighbors(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Rows with `prev` and `next` value at the adjacent integer positions, null outside; one shuffle, no sort."""
    sent = df.select(*keys, at, value, F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_d"))
    sent = sent.withColumn("_to", F.col(at) + F.col("_d"))
    pick = lambda d: F.max(F.when(F.col("_d") == d, F.col(value)))
    g = sent.groupBy(*keys, F.col("_to").alias(at)).agg(pick(0).alias(value), pick(1).alias("prev"), pick(-1).alias("next"))
    return g.where(F.col(value).isNotNull())


def _peaks(ac: DataFrame, keys: list[str], value: str, min_lag: int) -> DataFrame:
    n = neighbors(ac, keys, "lag", value)
    v = F.col(value)
    return n.where((v > 0) & (v >= F.col("prev")) & (v > F.col("next")) & (F.col("lag") > min_lag))


def dominant_period(points: DataFrame, min_lag: int = MIN_LAG) -> DataFrame:
    """grp, period: the first strong peak of the summed autocorrelation, halved when half the lag is clearly a period."""
    own = autocorrelation(points, min_lag)
    ac = own.groupBy("grp", "lag").agg(F.round(F.sum("o"), 9).alias("v"))
    peaks = _peaks(ac, ["grp"], "v", min_lag)
    top = peaks.groupBy("grp").agg(F.max("v").alias("top"))
    first = peaks.join(top, "grp").where(F.col("v") >= F.col("top") * STRONG_PEAK)
    first = first.groupBy("grp").agg(F.min_by(F.struct("lag", "v"), "lag").alias("f")).select("grp", F.col("f.lag").alias("flag"), F.col("f.v").alias("fv"))
    near = peaks.join(first, "grp").where(
        (F.col("lag") > min_lag + 1) & (F.abs(F.col("lag") - F.col("flag") / 2) <= F.col("flag") * HALF_TOLERANCE)
    )
    half = near.groupBy("grp").agg(F.min_by(F.struct("lag", "v"), "lag").alias("h"))
    half = half.select("grp", F.col("h.lag").alias("hlag"), F.col("h.v").alias("hv"))
    own_peaks = _peaks(own, ["grp", "series"], "o", min_lag).select("grp", "series", "lag", "o")
    at_first = own.join(first.select("grp", F.col("flag").alias("lag")), ["grp", "lag"]).select("grp", "series", F.col("o").alias("of"))
    in_one = own_peaks.join(half, "grp").where(F.abs(F.col("lag") - F.col("hlag")) <= 2).join(at_first, ["grp", "series"])
    in_one = in_one.where((F.col("o") >= HALF_OWN) & (F.col("o") >= F.col("of") * HALF_OWN_SHARE)).select("grp").distinct()
    in_one = in_one.withColumn("in_one", F.lit(True))
    j = first.join(half, "grp", "left").join(in_one, "grp", "left")
    halve = F.coalesce((F.col("hv") >= F.col("fv") * HALF_OVERALL) | F.col("in_one"), F.lit(False)) & F.col("hlag").isNotNull()
    j = j.select("grp", F.when(halve, F.col("hlag")).otherwise(F.col("flag")).alias("lag"))
    n = neighbors(ac, ["grp"], "lag", "v").join(j, ["grp", "lag"])
    bend = F.col("prev") - 2 * F.col("v") + F.col("next")
    shift = F.when(bend != 0, (F.col("prev") - F.col("next")) * 0.5 / bend).otherwise(F.lit(0.0))
    return n.select("grp", (F.col("lag") + shift).alias("period"))


def bands(points: DataFrame, min_gap: int, width: float = 0.05) -> DataFrame:
    """series, start, end: dense runs parted by gaps of at least `min_gap`, without the narrow ones."""
    med = order_statistics(points, ["series"], "v", {"med": lambda n: F.floor(n / 2)}, width=width)
    size = points.groupBy("series").agg(F.max("x").alias("last_x"))
    p = points.join(med, "series")
    dense = p.where(F.col("v") > F.greatest(F.lit(BAND_FLOOR), F.col("med") * BAND_SHARE)).select("series", "x")
    d = previous_value(dense.withColumn("_x", F.col("x")), ["series"], "x", "_x", "_p")
    d = d.withColumn("opens", (F.col("_p").isNull() | (F.col("x") - F.col("_p") - 1 >= min_gap)).cast("int"))
    d = prefix_sums(d, ["series"], "x", {"opens": "before"}).withColumn("band", F.col("before") + F.col("opens"))
    b = d.groupBy("series", "band").agg(F.min("x").alias("start"), F.max("x").alias("stop")).join(size, "series")
    open_end = F.col("last_x") - F.col("stop") < min_gap
    b = b.select("series", "band", "start", F.when(open_end, F.col("last_x")).otherwise(F.col("stop")).alias("end"))
    b = b.withColumn("_w", F.col("end") - F.col("start"))
    mw = order_statistics(b, ["series"], "_w", {"mw": lambda n: F.floor(n / 2)}, width=64)
    return b.join(mw, "series").where(F.col("_w") >= F.col("mw") * BAND_WIDTH).select("series", "start", "end")


def spaced_maxima(cands: DataFrame, distance: float) -> DataFrame:
    """Candidates (series, x, v) kept greedily by strength, none closer than `distance` to a stronger kept one.

    In every round the strongest of its surroundings is kept and drops those around it, which gives the greedy result
    without ordering a series in one task.
    """
    size = max(1, int(distance) + 1)
    undecided = checkpoint(cands.select("series", "x", "v"))
    kept = None
    while not undecided.isEmpty():
        b = undecided.withColumn("_b", F.floor(F.col("x") / size))
        rivals = b.select("series", F.col("x").alias("rx"), F.col("v").alias("rv"), F.explode(F.array(*[F.col("_b") + i for i in (-1, 0, 1)])).alias("_b"))
        pairs = b.join(rivals, ["series", "_b"]).where(F.abs(F.col("x") - F.col("rx")) < distance)
        best = pairs.groupBy("series", "x", "v").agg(F.max(F.struct("rv", (-F.col("rx")).alias("nx"))).alias("m"))
        won = checkpoint(best.where(-F.col("m.nx") == F.col("x")).select("series", "x", "v"))
        kept = won if kept is None else kept.unionByName(won)
        near = won.select("series", F.col("x").alias("wx"), F.explode(F.array(*[F.floor(F.col("x") / size) + i for i in (-1, 0, 1)])).alias("_b"))
        on = ["series", "_b"]
        lost = b.join(near, on).where(F.abs(F.col("x") - F.col("wx")) < distance).select("series", "x").distinct()
        undecided = checkpoint(undecided.join(lost, ["series", "x"], "left_anti"))
    return kept if kept is not None else undecided


def peak_pick(points: DataFrame, period: float, width: float = 1.0) -> DataFrame:
    """series, x, v: spaced local maxima that are high and stand out enough from the valleys beside them."""
    n = neighbors(points, ["series"], "x", "v")
    cands = n.where((F.col("v") > 0) & (F.col("v") >= F.col("prev")) & (F.col("v") > F.col("next")))
    chosen = spaced_maxima(cands, PEAK_DISTANCE * period)
    ref = order_statistics(chosen, ["series"], "v", {"ref": lambda c: c - 1 - F.floor((c - 1) * PEAK_QUANTILE)}, width=width)
    left = int((PEAK_REACH * period) // 1 + (1 if (PEAK_REACH * period) % 1 > 0.5 else 0))
    right = int((PEAK_REACH * period + 0.5) // 1)
    around = chosen.join(ref, "series").select("series", "x", "v", "ref", F.explode(F.sequence(F.lit(-left), F.lit(right))).alias("d"))
    around = around.withColumn("_at", F.col("x") + F.col("d"))
    at = points.select("series", F.col("x").alias("_at"), F.col("v").alias("_v"))
    low = lambda side: F.min(F.when(side, F.col("_v")))
    v = around.join(at, ["series", "_at"]).groupBy("series", "x", "v", "ref").agg(low(F.col("d") <= 0).alias("l"), low(F.col("d") >= 0).alias("r"))
    keep = (F.col("v") >= F.col("ref") * PEAK_HEIGHT) & (F.col("v") - F.greatest("l", "r") >= F.col("ref") * PEAK_PROMINENCE)
    return v.where(keep).select("series", "x", "v")


def robust_stretch(points: DataFrame, width: float = 0.05) -> DataFrame:
    """points with v scaled so that the median is 0 and the 99.5th percentile 1."""
    at = lambda q: lambda n: F.floor((n - 1) * q + 0.5)
    s = order_statistics(points, ["series"], "v", {"lo": at(STRETCH_LOW), "top": at(STRETCH_HIGH)}, width=width)
    s = s.withColumn("hi", F.greatest(F.col("lo") + STRETCH_MIN, F.col("top")))
    scaled = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return points.join(s, "series").withColumn("v", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).drop("lo", "top", "hi")


def collapse_runs(frames: DataFrame, alphabet: str, min_probability: float = RUN_PROBABILITY) -> DataFrame:
    """series, text, confidence from frames (series, step, logp): class 0 is blank, repeats merge, unsure letters are `?`."""
    best = F.array_max("logp")
    f = frames.select("series", "step", (F.array_position("logp", best) - 1).cast("int").alias("cls"), F.exp(best.cast("double")).alias("p"))
    f = previous_value(f, ["series"], "step", "cls", "_prev")
    f = f.withColumn("opens", (F.col("_prev").isNull() | (F.col("cls") != F.col("_prev"))).cast("int"))
    f = prefix_sums(f, ["series"], "step", {"opens": "before"}).withColumn("run", F.col("before") + F.col("opens"))
    runs = f.where("cls > 0").groupBy("series", "run", "cls").agg(F.max("p").alias("p"), F.min("step").alias("step"))
    letter = F.substring(F.lit(alphabet), F.col("cls"), F.lit(1))
    letter = F.when(letter == " ", letter).when(F.col("p") >= min_probability, letter).otherwise(F.lit("?"))
    runs = runs.withColumn("letter", letter)
    # A text is the reading of one line; its letters fit one row.
    out = runs.groupBy("series").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "letter"))), lambda x: x["letter"]), "").alias("t"),
        F.avg(F.when(F.col("letter") != " ", F.col("p"))).alias("confidence"),
    )
    every = frames.select("series").distinct().join(out, "series", "left")
    text = F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), " +", " "))
    return every.select("series", text.alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def line_filter(lines: DataFrame, unsure_below: float = UNSURE_BELOW, cap: int = MAX_LINES) -> DataFrame:
    """page, line_no, text, uncertain from (page, line_no, text, confidence, cut): the lines of a page below number `cap` that have a letter."""
    seen = lines.where(F.col("line_no") < cap).where(F.regexp_replace("text", "[ ?]", "") != "")
    return seen.withColumn("uncertain", F.col("cut") | (F.col("confidence") < unsure_below))


def best_shift(a: DataFrame, b: DataFrame, max_shift: int) -> DataFrame:
    """pair, shift: d with |d| <= max_shift giving b(y + d) the largest product with a(y); 0 unless another is better.

    a, b: pair, y, v.
    """
    d = F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift))).alias("d")
    s = a.select("pair", F.col("v").alias("va"), "y", d).withColumn("y", F.col("y") + F.col("d"))
    s = s.join(b.withColumnRenamed("v", "vb"), ["pair", "y"]).groupBy("pair", "d").agg(F.sum(F.col("va") * F.col("vb")).alias("score"))
    order = F.struct("score", (F.col("d") == 0).alias("stay"), (-F.col("d")).alias("first"))
    return s.groupBy("pair").agg(F.max_by("d", order).alias("shift"))
