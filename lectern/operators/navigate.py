"""From a placement to a target: direction, columns to go, arrival line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import js_round
from ..session import checkpoint
from .joins import point_in_interval
from .placement import POINT_BLOCK, excerpts

# Fallbacks and accepted range of learned layout.
DEFAULT_WORDS_PER_LINE = 8
LINES_PER_COLUMN = 42
LEARN_LAST, LEARN_MIN, LEARN_MAX = 5, 50, 2000


def column_span(placements: DataFrame) -> DataFrame:
    """span_start, span_end: the matched column, else the scanned span extended over lines seen but not read."""
    wpl = F.when(F.col("words_per_line") > 0, F.col("words_per_line")).otherwise(F.lit(float(DEFAULT_WORDS_PER_LINE)))
    below = F.greatest(F.lit(0), F.col("visible") - F.col("transcribed"))
    above = F.coalesce(F.col("first_line") - 1, F.lit(0))
    start = F.greatest(F.lit(0), F.col("start") - js_round(above * wpl))
    return placements.withColumns(
        {
            "span_start": F.coalesce("col_start", start).cast("int"),
            "span_end": F.coalesce("col_end", F.col("end") + js_round(below * wpl)).cast("int"),
        }
    )


def gap_before(points: DataFrame, pos: str, words: DataFrame, keys: list[str]) -> DataFrame:
    """Blank space written before a word: petucha, setuma or none. Of `words` those with a flag are enough (`corpus.gaps`)."""
    w = words.select("doc_id", F.col("pos").alias("_p"), "petucha_before", "gap_before")
    j = points.join(w, (points["doc_id"] == w["doc_id"]) & (points[pos] == w["_p"]), "left").drop(w["doc_id"])
    kind = F.when(F.col("petucha_before"), "petucha").when(F.col("gap_before"), "setuma").otherwise("none")
    return j.select(*keys, kind.alias("gap"))


def line_hint(here: DataFrame, line_spans: DataFrame, pages: DataFrame, gaps: DataFrame) -> DataFrame:
    """Arrival line of targets inside the current column, from the best source there is.

    The written layout, else the lines of the reading, else an estimate from words per line.
    """
    key = ["query_id", "target_id"]
    near = excerpts(here.withColumn("_stop", F.col("word") + 3), "word", "_stop", line_spans, pages, key, 3)
    j = here.join(near, key, "left").withColumn("at", F.when(F.col("at.column") == F.col("column"), F.col("at")))
    top = F.coalesce("first_line", F.lit(1))
    starts = F.col("line_starts")
    after = lambda i: F.try_element_at(F.filter(F.slice(starts, i + 2, F.size(starts)), lambda x: x.isNotNull()), F.lit(1))
    holds = F.transform(
        starts,
        lambda s, i: F.when(
            s.isNotNull() & (F.col("word") >= s) & (after(i).isNull() | (F.col("word") < after(i))),
            F.struct(i.alias("i"), (s == F.col("word")).alias("at")),
        ),
    )
    read = F.try_element_at(F.filter(holds, lambda x: x.isNotNull()), F.lit(1))
    j = j.withColumn("_read", read)
    wpl = F.when(F.col("words_per_line") > 0, F.col("words_per_line")).otherwise(F.lit(float(DEFAULT_WORDS_PER_LINE)))
    guess = F.greatest(F.lit(1), js_round(top + (F.col("word") - F.col("start")) / wpl))
    j = j.withColumns(
        {
            "line": F.coalesce("at.line", top + F.col("_read.i"), guess).cast("int"),
            "line_exact": F.col("at").isNotNull() | F.col("_read").isNotNull(),
            "at_line_start": F.coalesce("at.at_start", F.col("_read.at"), F.lit(False)),
            "words_vocalized": F.when(F.col("at.written") != "", F.col("at.written")),
            "words_here": F.coalesce("text", F.lit("")),
        }
    )
    gaps = gap_before(j.select(*key, "doc_id", "word"), "word", gaps, key)
    return j.join(gaps, key).select(*key, "line", "line_exact", "at_line_start", "words_here", "words_vocalized", "gap")


def moves(placements: DataFrame, targets: DataFrame, columns: DataFrame) -> DataFrame:
    """Every target with status, direction, word_delta and columns to go (without the arrival line)."""
    p = column_span(placements)
    j = p.join(targets.drop("doc_id"), "query_id")
    inside = (F.col("word") >= F.col("span_start")) & (F.col("word") <= F.col("span_end"))
    cols = columns.where("end >= start").select("doc_id", F.col("n").alias("target_column"), F.col("start").alias("_cs"), F.col("end").alias("_ce"))
    points = j.select("query_id", "target_id", "doc_id", "word")
    at = point_in_interval(points, "word", cols, "_cs", "_ce", ["doc_id"], POINT_BLOCK).select("query_id", "target_id", "target_column")
    j = j.join(at, ["query_id", "target_id"], "left").withColumn("here", inside)
    exact = F.when(F.col("column").isNotNull(), F.abs(F.col("target_column") - F.col("column")))
    per_line = F.when(F.col("words_per_line") > 0, js_round(F.col("words_per_line") * LINES_PER_COLUMN))
    wpc = F.coalesce("learned", "words_per_column", per_line)
    wpc = F.when(~F.col("here") & exact.isNull() & (wpc > 0), wpc)
    estimate = F.greatest(F.lit(1), js_round(F.abs(F.col("word") - F.col("span_start")) / wpc))
    return j.withColumns(
        {
            "status": F.when(F.col("here"), "here").otherwise("move"),
            "direction": F.when(~F.col("here"), F.when(F.col("word") < F.col("start"), "towards-start").otherwise("towards-end")),
            "word_delta": F.col("word") - F.col("start"),
            "columns": F.when(F.col("here"), 0).otherwise(F.coalesce(exact, F.when(wpc.isNotNull(), estimate))).cast("int"),
            "columns_exact": F.when(F.col("here"), F.lit(None)).otherwise(exact.isNotNull()),
            "wpc_used": wpc.cast("int"),
        }
    )


def navigate(placements: DataFrame, targets: DataFrame, ref: dict[str, DataFrame]) -> DataFrame:
    """placements (with `learned` words per column or null) x their targets (query_id, target_id, word)."""
    # One row per target, read by every tier of the arrival line: computed once.
    m = checkpoint(moves(placements, targets, ref["columns"]))
    hint = line_hint(m.where("here"), ref["line_spans"], ref["pages"], ref["gaps"])
    out = m.join(hint, ["query_id", "target_id"], "left")
    return out.withColumn("columns_exact", F.coalesce("columns_exact", "line_exact")).select(
        "query_id", "target_id", "status", "direction", "word_delta", "columns", "columns_exact", "wpc_used",
        "line", "line_exact", "at_line_start", "words_here", "words_vocalized", "gap",
    )


def learned_wpc(estimates: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """Mean of the client's last five estimates (client, ts, id, wpc) at each row, if plausible.

    Only four earlier rows matter, so each slice of time takes the last four of the slices before it along: a client
    with most of the log is many tasks.
    """
    e = estimates.withColumn("_s", F.floor(F.unix_micros("ts") / (slice_seconds * 1_000_000)))
    back = W.partitionBy("client", "_s").orderBy(F.desc("ts"), F.desc("id"))
    tail = e.withColumn("_r", F.row_number().over(back)).where(F.col("_r") < LEARN_LAST).drop("_r")
    tails = tail.groupBy("client", "_s").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "wpc"))).alias("_t"))
    earlier = W.partitionBy("client").orderBy("_s").rowsBetween(1 - LEARN_LAST, -1)
    carried = F.slice(F.reverse(F.flatten(F.collect_list("_t").over(earlier))), 1, LEARN_LAST - 1)
    carry = tails.withColumn("_cs", carried).select("client", "_s", F.explode("_cs").alias("_c"))
    old = carry.select("client", "_s", "_c.ts", "_c.id", "_c.wpc", F.lit(False).alias("_own"))
    both = e.select("client", "_s", "ts", "id", "wpc", F.lit(True).alias("_own")).unionByName(old)
    last5 = W.partitionBy("client", "_s").orderBy("ts", "id").rowsBetween(1 - LEARN_LAST, 0)
    mean = js_round(F.avg("wpc").over(last5))
    out = both.withColumn("_m", mean).where("_own")
    ok = (F.col("_m") > LEARN_MIN) & (F.col("_m") < LEARN_MAX)
    return out.select("client", "ts", "id", F.when(ok, F.col("_m")).cast("int").alias("learned"))


def target_from_verse(requests: DataFrame, verses: DataFrame) -> DataFrame:
    """requests (doc_id, book, chapter, verse, label) with `word`, null if the verse is missing."""
    v = verses.select("doc_id", "book", "chapter", "verse", F.col("start").alias("word"))
    return requests.join(v, ["doc_id", "book", "chapter", "verse"], "left")


def scroll_info(verses: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, total_words, book, book_start: where each book opens. Of `words` (doc_id, pos) the last of each document is enough."""
    total = words.groupBy("doc_id").agg((F.max("pos") + 1).alias("total_words"))
    first = verses.where("chapter = 1 and verse = 1").groupBy("doc_id", "book").agg(F.min("start").alias("book_start"))
    return first.join(total, "doc_id")


def percent(pos: F.Column, total: F.Column) -> F.Column:
    """Position on the map, clamped to 0..100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), pos / F.greatest(total, F.lit(1)) * 100))
