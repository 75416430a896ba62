"""Series operators: hourly counts of events, and embeddings as class frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from . import tables as T
from .registry import registry as R

HOURLY = """h0 AS (SELECT event_type AS series, floor(epoch(ts) / 3600)::BIGINT AS h, count(*) AS c FROM events GROUP BY ALL),
span AS (SELECT min(floor(epoch(ts) / 3600)::BIGINT) AS lo, max(floor(epoch(ts) / 3600)::BIGINT) AS hi FROM events),
points AS (SELECT s.series, x, coalesce(c, 0)::DOUBLE AS v FROM (SELECT DISTINCT series FROM h0) s, (SELECT unnest(range(hi - lo + 1)) AS x, lo FROM span) LEFT JOIN h0 ON h0.series = s.series AND h0.h = lo + x)"""


def counts(spark, d, key: str, seconds: int):
    """series, x, v: events per time step, with zeros for empty steps."""
    e = T.raw(spark, d, "events").select(F.col(key).alias("series"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds).alias("h"))
    c = e.groupBy("series", "h").agg(F.count(F.lit(1)).alias("c"))
    lo, hi = c.agg(F.min("h"), F.max("h")).first()
    steps = c.select("series").distinct().select("series", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("h"))
    j = steps.join(c, ["series", "h"], "left")
    return j.select("series", (F.col("h") - lo).cast("int").alias("x"), F.coalesce("c", F.lit(0)).cast("double").alias("v"))


PERIOD_SQL = """gp AS (SELECT series AS grp, series, x, v FROM points UNION ALL SELECT 'all', series, x, v FROM points),
st AS (SELECT grp, series, avg(v) AS m, max(x) + 1 AS n FROM gp GROUP BY ALL),
cp AS (SELECT grp, series, x, v - m AS c, n // 3 AS ml FROM gp JOIN st USING (grp, series)),
nm AS (SELECT grp, series, sum(c * c) AS norm, any_value(ml) AS ml FROM cp GROUP BY ALL),
lg AS (SELECT grp, series, unnest(range(6, ml + 2)) AS lag, norm FROM nm),
own AS (SELECT a.grp, a.series, lg.lag, round(sum(a.c * b.c) / any_value(norm), 9) AS o FROM lg JOIN cp a ON a.grp = lg.grp AND a.series = lg.series JOIN cp b ON b.grp = a.grp AND b.series = a.series AND b.x = a.x + lg.lag GROUP BY ALL),
ac AS (SELECT grp, lag, round(sum(o), 9) AS v FROM own GROUP BY ALL),
nb AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM ac WINDOW w AS (PARTITION BY grp ORDER BY lag)),
pk AS (SELECT * FROM nb WHERE v > 0 AND v >= p AND v > n AND lag > 6),
f AS (SELECT grp, min(lag) AS flag, arg_min(v, lag) AS fv FROM (SELECT *, max(v) OVER (PARTITION BY grp) AS top FROM pk) WHERE v >= 0.5 * top GROUP BY grp),
hf AS (SELECT grp, min(lag) AS hlag, arg_min(v, lag) AS hv FROM pk JOIN f USING (grp) WHERE lag > 7 AND abs(lag - flag / 2) <= 0.1 * flag GROUP BY grp),
onb AS (SELECT *, lag(o) OVER w AS p, lead(o) OVER w AS n FROM own WINDOW w AS (PARTITION BY grp, series ORDER BY lag)),
io AS (SELECT DISTINCT onb.grp FROM onb JOIN hf USING (grp) JOIN f USING (grp) JOIN own q ON q.grp = onb.grp AND q.series = onb.series AND q.lag = flag WHERE onb.o > 0 AND onb.o >= p AND onb.o > n AND onb.lag > 6 AND abs(onb.lag - hlag) <= 2 AND onb.o >= 0.4 AND onb.o >= 0.5 * q.o),
ch AS (SELECT f.grp, CASE WHEN hlag IS NOT NULL AND (hv >= 0.15 * fv OR io.grp IS NOT NULL) THEN hlag ELSE flag END AS lag FROM f LEFT JOIN hf USING (grp) LEFT JOIN io ON io.grp = f.grp)"""


@R.query("dominant_period", f"WITH {HOURLY}, {PERIOD_SQL} SELECT grp, round(lag + CASE WHEN p - 2 * v + n <> 0 THEN 0.5 * (p - n) / (p - 2 * v + n) ELSE 0 END, 6) AS period FROM ch JOIN nb USING (grp, lag)")
def _(spark, d):
    p = counts(spark, d, "event_type", 3600)
    both = p.withColumn("grp", F.col("series")).unionByName(p.withColumn("grp", F.lit("all")))
    return series.dominant_period(both).select("grp", F.round("period", 6).alias("period"))


USERS = """u0 AS (SELECT user_id AS series, floor(epoch(ts) / 21600)::BIGINT AS h, count(*) AS c FROM events GROUP BY ALL),
uspan AS (SELECT min(h) AS lo, max(h) AS hi FROM u0),
up AS (SELECT s.series, x, coalesce(c, 0)::DOUBLE AS v FROM (SELECT DISTINCT series FROM u0) s, (SELECT unnest(range(hi - lo + 1)) AS x, lo FROM uspan) LEFT JOIN u0 ON u0.series = s.series AND u0.h = lo + x)"""


@R.query(
    "gap_delimited_bands",
    f"""WITH {USERS}, md AS (SELECT series, list_sort(list(v))[count(*) // 2 + 1] AS med, max(x) AS last FROM up GROUP BY series),
    dn AS (SELECT series, x, last, CASE WHEN coalesce(x - lag(x) OVER (PARTITION BY series ORDER BY x) - 1 >= 4, true) THEN 1 ELSE 0 END AS o FROM up JOIN md USING (series) WHERE v > greatest(0.02, 0.5 * med)),
    bd AS (SELECT series, b, min(x) AS start, CASE WHEN any_value(last) - max(x) < 4 THEN any_value(last) ELSE max(x) END AS stop FROM (SELECT *, sum(o) OVER (PARTITION BY series ORDER BY x) AS b FROM dn) GROUP BY ALL),
    mw AS (SELECT series, list_sort(list(stop - start))[count(*) // 2 + 1] AS mw FROM bd GROUP BY series)
    SELECT series, start AS first, stop AS last FROM bd JOIN mw USING (series) WHERE stop - start >= 0.55 * mw""",
)
def _(spark, d):
    b = series.bands(counts(spark, d, "user_id", 21600), 4)
    return b.select("series", F.col("start").alias("first"), F.col("end").alias("last"))


@R.query(
    "peak_pick",
    f"""WITH {HOURLY}, nb AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM points WINDOW w AS (PARTITION BY series ORDER BY x)),
    cd AS (SELECT series, list([{{x: x, v: v}}] ORDER BY v DESC, x) AS l FROM nb WHERE v > 0 AND v >= p AND v > n GROUP BY series),
    chs AS (SELECT series, unnest(list_reduce(l[2:], lambda a, e: CASE WHEN len(list_filter(a, lambda k: abs(k.x - e[1].x) < 3.6)) > 0 THEN a ELSE list_append(a, e[1]) END, l[1])) AS c FROM cd),
    rf AS (SELECT series, list_sort(list(c.v), 'DESC')[floor((count(*) - 1) * 0.25)::INT + 1] AS ref FROM chs GROUP BY series),
    vl AS (SELECT chs.series, c.x AS x, c.v AS v, ref, min(pt.v) FILTER (pt.x BETWEEN floor(c.x - 5.4 + 0.5) AND c.x) AS l, min(pt.v) FILTER (pt.x BETWEEN c.x AND floor(c.x + 5.4 + 0.5)) AS r FROM chs JOIN rf USING (series) JOIN points pt ON pt.series = chs.series AND abs(pt.x - c.x) <= 7 GROUP BY ALL)
    SELECT series, x, v FROM vl WHERE v >= 0.15 * ref AND v - greatest(l, r) >= 0.12 * ref""",
)
def _(spark, d):
    return series.peak_pick(counts(spark, d, "event_type", 3600), 6.0)


EMB = "emb AS (SELECT vec_id AS series, x, embedding[x + 1]::DOUBLE AS v FROM (SELECT *, unnest(range(len(embedding))) AS x FROM embeddings))"


@R.query(
    "robust_stretch",
    f"""WITH {EMB}, q AS (SELECT series, l[floor(0.5 * (n - 1) + 0.5)::INT + 1] AS lo, l[floor(0.995 * (n - 1) + 0.5)::INT + 1] AS top FROM (SELECT series, list_sort(list(v)) AS l, count(*) AS n FROM emb GROUP BY series))
    SELECT series, x, round(least(1, greatest(0, (v - lo) / (greatest(lo + 0.05::DOUBLE, top) - lo))), 6) AS v FROM emb JOIN q USING (series)""",
)
def _(spark, d):
    e = T.raw(spark, d, "embeddings").select(F.col("vec_id").alias("series"), F.posexplode("embedding").alias("x", "f"))
    p = e.select("series", "x", F.col("f").cast("double").alias("v"))
    return series.robust_stretch(p).select("series", "x", F.round("v", 6).alias("v"))


# Letters of the frame classes: a space, then letters.
ALPHABET = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
RUNS = f"""fr AS (SELECT label AS series, vec_id AS step, list_position(embedding, list_max(embedding)) - 1 AS c0, exp(list_max(embedding)::DOUBLE - 0.9) AS p FROM embeddings),
fc AS (SELECT *, CASE WHEN c0 < 8 THEN 0 WHEN c0 < 24 THEN 1 ELSE c0 // 8 END AS cls FROM fr),
ro AS (SELECT *, CASE WHEN cls IS DISTINCT FROM lag(cls) OVER (PARTITION BY series ORDER BY step) THEN 1 ELSE 0 END AS o FROM fc),
rn AS (SELECT series, run, cls, max(p) AS p FROM (SELECT *, sum(o) OVER (PARTITION BY series ORDER BY step) AS run FROM ro) WHERE cls > 0 GROUP BY ALL),
lt AS (SELECT series, run, p, CASE WHEN cls = 1 THEN ' ' WHEN p >= 0.5 THEN substr('{ALPHABET}', cls, 1) ELSE '?' END AS letter FROM rn),
tx AS (SELECT series, trim(regexp_replace(string_agg(letter, '' ORDER BY run), ' +', ' ', 'g')) AS text, coalesce(avg(p) FILTER (letter <> ' '), 0) AS confidence FROM lt GROUP BY series)"""


def _texts(spark, d):
    """Embedding classes folded to eight, read as frames of one series per label."""
    e = T.raw(spark, d, "embeddings")
    top = F.array_max("embedding")
    c0 = F.array_position("embedding", top) - 1
    cls = F.when(c0 < 8, 0).when(c0 < 24, 1).otherwise(F.floor(c0 / 8)).cast("int")
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == F.col("cls"), F.col("best")).otherwise(F.lit(-99.0)))
    f = e.select(F.col("label").alias("series"), F.col("vec_id").alias("step"), cls.alias("cls"), (top.cast("double") - 0.9).alias("best"))
    return series.collapse_runs(f.select("series", "step", one_hot.alias("logp")), ALPHABET)


@R.query("collapse_runs", f"WITH {RUNS} SELECT series, text, round(confidence, 6) AS confidence FROM tx")
def _(spark, d):
    return _texts(spark, d).select("series", "text", F.round("confidence", 6).alias("confidence"))


@R.query(
    "line_filter",
    f"WITH {RUNS} SELECT series // 4 AS page, series % 4 AS line_no, text, confidence < 0.55 OR series % 5 = 0 AS uncertain FROM tx WHERE series % 4 < 60 AND regexp_replace(text, '[ ?]', '', 'g') <> ''",
)
def _(spark, d):
    t = _texts(spark, d).select(F.floor(F.col("series") / 4).alias("page"), (F.col("series") % 4).alias("line_no"), "text", "confidence", (F.col("series") % 5 == 0).alias("cut"))
    return series.line_filter(t, 0.55).select("page", "line_no", "text", "uncertain")


@R.query(
    "best_shift",
    f"""WITH {HOURLY}, sc AS (SELECT b.series AS pair, d, sum(a.v * b.v) AS s FROM points a, (SELECT unnest(range(-5, 6)) AS d) JOIN points b ON b.x = a.x + d WHERE a.series = 'view' AND b.series <> 'view' GROUP BY ALL)
    SELECT pair, arg_max(d, (s, d = 0, -d)) AS shift FROM sc GROUP BY pair""",
)
def _(spark, d):
    p = counts(spark, d, "event_type", 3600)
    b = p.where("series <> 'view'").select(F.col("series").alias("pair"), F.col("x").alias("y"), "v")
    base = p.where("series = 'view'").select(F.col("x").alias("y"), "v")
    others = b.agg(F.collect_set("pair")).scalar()
    return series.best_shift(base.select(F.explode(others).alias("pair"), "y", "v"), b, 5)
