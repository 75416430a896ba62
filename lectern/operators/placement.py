"""Placing an aligned span: verses, sections, columns, lines, layout estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.profile import LATIN, Profile
from ..functions.text import js_round, round_half_up
from . import corpus
from .index import corpus_words
from .joins import overlapping, point_in_interval

POINT_BLOCK = 256
"""Positions per block of the interval joins."""


def slice_text(spans: DataFrame, start: str, end: str, words: DataFrame, keys: list[str], out: str = "text") -> DataFrame:
    """Words of each (clamped) span joined by spaces. A span is a bounded excerpt, so its words fit one row."""
    w = words.select("doc_id", F.col("pos").alias("_pos"), F.col("word").alias("_word"))
    wanted = spans.select(*dict.fromkeys([*keys, "doc_id", start, end]))
    j = point_in_interval(w, "_pos", wanted, start, end, ["doc_id"], POINT_BLOCK)
    g = j.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", "_word"))).alias("_w"))
    g = g.select(*keys, F.array_join(F.transform("_w", lambda x: x["_word"]), " ").alias(out))
    return spans.join(g, keys, "left").withColumn(out, F.coalesce(out, F.lit("")))


def consecutive_slices(documents: DataFrame, size: int, p: Profile = LATIN) -> DataFrame:
    """doc_id, n, text: the words of documents (doc_id, text) in consecutive spans of `size`, numbered from 1 and joined by spaces.
    A span comes from its document's own row: no word becomes a row and nothing is exchanged."""
    d = documents.select("doc_id", corpus_words("text", p).alias("_w"))
    # An inner explode would be checked for emptiness below, by parsing the text a second time.
    first = F.explode_outer(F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size))))
    s = d.select("doc_id", "_w", first.alias("_first")).where("_first is not null")
    n = (F.col("_first") / size + 1).cast("int")
    return s.select("doc_id", n.alias("n"), F.array_join(F.slice("_w", F.col("_first") + 1, F.lit(size)), " ").alias("text"))


def excerpts(
    points: DataFrame, first: str, last: str, line_spans: DataFrame, pages: DataFrame, keys: list[str], written: int, p: Profile = LATIN
) -> DataFrame:
    """keys, text, at: the words of each (clamped) span, and of the line that holds its first position the column, line, whether
    the line starts there and up to `written` written words from there. A span is a bounded excerpt of few lines.

    Spans meet lines by positions alone (`line_spans`); a text goes once, unparsed, to the spans of its line and is parsed there,
    so neither words nor lines without a span become rows.
    """
    ln = line_spans.where("end >= start").select(
        "doc_id", F.col("n").alias("page"), F.col("line_no").alias("line"), F.col("start").alias("_ls"), F.col("end").alias("_le")
    )
    wanted = points.select(*dict.fromkeys([*keys, "doc_id"]), F.col(first).alias("_from"), F.col(last).alias("_to"))
    hits = overlapping(wanted, "_from", "_to", ln, "_ls", "_le", ["doc_id"], POINT_BLOCK)
    hits = hits.groupBy(*corpus.PLACE, "_ls").agg(F.collect_list(F.struct(*keys, "_from", "_to")).alias("_hits"))
    lines = corpus.line_pieces(pages.select(*corpus.PLACE, "text").join(hits, corpus.PLACE), p)
    lines = lines.select(
        "page", "line", "_ls", F.flatten("pieces.words").alias("_words"), F.split(corpus.written_line(), " ").alias("_written"), F.explode("_hits").alias("_h")
    )
    begin, here = F.greatest(F.col("_h._from"), F.col("_ls")), F.col("_h._from") >= F.col("_ls")
    part = F.array_join(F.slice("_words", begin - F.col("_ls") + 1, F.col("_h._to") - begin + 1), " ")
    at = F.struct(
        F.col("page").alias("column"),
        "line",
        (F.col("_h._from") == F.col("_ls")).alias("at_start"),
        F.array_join(F.slice("_written", begin - F.col("_ls") + 1, F.lit(written)), " ").alias("written"),
    )
    rows = lines.select(*[F.col(f"_h.{k}").alias(k) for k in keys], "_ls", part.alias("_part"), F.when(here, at).alias("_at"))
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_ls", "_part"))).alias("_p"), F.max("_at").alias("at"))
    return g.select(*keys, F.array_join(F.transform("_p", lambda x: x["_part"]), " ").alias("text"), "at")


# Placement rules.
LEAD_WORDS = 3
"""A span starting this close to a column's end and running on starts in the next column."""
NEAR_START = 2
MAX_LINE_WORDS = 40
FULL_COLUMN_LINES = 35


def word_ref(points: DataFrame, pos: str, verses: DataFrame, prefix: str = "") -> DataFrame:
    """Points (doc_id, pos) with the book, chapter and verse holding them; a point outside the text is dropped."""
    v = verses.select(
        "doc_id", F.col("start").alias("_vs"), F.col("end").alias("_ve"), *[F.col(c).alias(prefix + c) for c in ("book", "chapter", "verse")]
    )
    return point_in_interval(points, pos, v, "_vs", "_ve", ["doc_id"], POINT_BLOCK).drop("_vs", "_ve")


def overlapping_sections(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """spans (query_id, doc_id, start, end) x sections (doc_id, n, start, end): one row per overlap."""
    s = sections.select("doc_id", F.col("n").alias("section"), F.col("start").alias("_ss"), F.col("end").alias("_se"))
    return overlapping(spans.select("query_id", "doc_id", "start", "end"), "start", "end", s, "_ss", "_se", ["doc_id"], POINT_BLOCK).select(
        "query_id", "doc_id", "section"
    )


def overlapping_subsections(spans: DataFrame, subsections: DataFrame) -> DataFrame:
    """One row per overlapped subsection, without the optional part M, and whether it starts inside the span."""
    s = subsections.where(F.col("n") != "M").select("doc_id", "section", "n", F.col("start").alias("_ss"), F.col("end").alias("_se"))
    j = overlapping(spans.select("query_id", "doc_id", "start", "end"), "start", "end", s, "_ss", "_se", ["doc_id"], POINT_BLOCK)
    here = (F.col("_ss") >= F.col("start")) & (F.col("_ss") <= F.col("end"))
    return j.select("query_id", "doc_id", "section", "n", here.alias("starts_here"))


def standard_column(spans: DataFrame, columns: DataFrame) -> DataFrame:
    """Spans with column, col_start, col_end and from_column_start of the column they open in."""
    c = columns.select("doc_id", "n", F.col("start").alias("_cs"), F.col("end").alias("_ce")).where("_ce >= _cs")
    after = columns.where("end >= start").select(
        "doc_id", (F.col("n") - 1).alias("n"), F.struct(F.col("n"), F.col("start").alias("s"), F.col("end").alias("e")).alias("_next")
    )
    c = c.join(after, ["doc_id", "n"], "left")
    j = point_in_interval(spans, "start", c, "_cs", "_ce", ["doc_id"], POINT_BLOCK)
    moved = (F.col("_ce") - F.col("start") < LEAD_WORDS) & (F.col("end") > F.col("_ce")) & F.col("_next").isNotNull()
    pick = lambda nxt, own: F.when(moved, F.col(f"_next.{nxt}")).otherwise(F.col(own))
    j = j.withColumns({"column": pick("n", "n"), "col_start": pick("s", "_cs"), "col_end": pick("e", "_ce")})
    j = j.withColumn("from_column_start", F.abs(F.col("start") - F.col("col_start")) <= NEAR_START)
    return j.drop("_cs", "_ce", "_next", "n")


def first_line(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Spans (with their column) plus first_line: the column's line of the first aligned line start inside it."""
    inside = F.filter("line_starts", lambda x: x.isNotNull() & (x >= F.col("col_start")) & (x <= F.col("col_end")))
    s = spans.withColumn("_first", F.try_element_at(inside, F.lit(1)))
    ln = lines.where("end >= start").select(
        "doc_id", F.col("n").alias("column"), F.col("line_no").alias("first_line"), F.col("start").alias("_ls"), F.col("end").alias("_le")
    )
    points = s.where("_first is not null").select("query_id", "doc_id", "column", "_first")
    found = point_in_interval(points, "_first", ln, "_ls", "_le", ["doc_id", "column"], POINT_BLOCK)
    return s.drop("_first").join(found.select("query_id", "first_line"), "query_id", "left")


def estimate_layout(spans: DataFrame) -> DataFrame:
    """Spans (line_starts, line_tokens, visible) plus words_per_line and words_per_column."""
    starts = F.col("line_starts")
    steps = F.zip_with(
        F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))),
        F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))),
        lambda a, b: F.when((b > a) & (b - a < MAX_LINE_WORDS), b - a),
    )
    steps = F.filter(steps, lambda x: x.isNotNull())
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    counts = F.filter("line_tokens", lambda x: x > 0)
    wpl = F.when(F.size(steps) > 0, mean(steps)).when(F.size(counts) > 0, mean(counts)).otherwise(F.lit(0.0))
    s = spans.withColumn("_wpl", wpl)
    # Without a count of visible lines, those read stand for it.
    visible = F.coalesce("visible", F.size("line_tokens"))
    full = (visible >= FULL_COLUMN_LINES) & (F.col("_wpl") > 0)
    return s.withColumns(
        {
            "words_per_line": round_half_up(F.col("_wpl"), 1),
            "words_per_column": F.when(full, js_round(F.col("_wpl") * visible).cast("int")),
        }
    ).drop("_wpl")


def first_words(spans: DataFrame, line_spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans plus first_words (up to four) and first_words_vocalized (up to four written words of the line, if it lies in the
    span's column)."""
    s = spans.withColumn("_stop", F.least(F.col("end"), F.col("start") + 3))
    s = s.join(excerpts(s, "start", "_stop", line_spans, pages, ["query_id"], 4), "query_id", "left")
    own = F.when(F.col("at.column") == F.col("column"), F.col("at.written"))
    return s.withColumns({"first_words": F.coalesce("text", F.lit("")), "first_words_vocalized": own}).drop("_stop", "text", "at")


def build_placement(spans: DataFrame, ref: dict[str, DataFrame]) -> DataFrame:
    """Full placement rows.

    `spans`: query_id, doc_id, start, end, score, margin, coverage, aligned, lines_covered, line_starts, line_tokens,
    visible. `ref`: pages, line_spans (`line_ranges` without texts), verses, columns, sections, subsections. A span overlaps few
    sections, so these gather.
    """
    p = estimate_layout(spans)
    col = first_line(standard_column(p, ref["columns"]), ref["line_spans"]).select(
        "query_id", "column", "col_start", "col_end", "from_column_start", "first_line"
    )
    p = first_words(p.join(col, "query_id", "left"), ref["line_spans"], ref["pages"])
    for side in ("start", "end"):
        at = word_ref(spans.select("query_id", "doc_id", F.col(side).alias("_p")), "_p", ref["verses"])
        p = p.join(at.select("query_id", F.struct("book", "chapter", "verse").alias(f"verse_{side}")), "query_id", "left")
    sec = overlapping_sections(spans, ref["sections"]).groupBy("query_id").agg(F.sort_array(F.collect_list("section")).alias("sections"))
    sub = overlapping_subsections(spans, ref["subsections"]).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("section", "n", "starts_here"))).alias("subsections")
    )
    p = p.join(sec, "query_id", "left").join(sub, "query_id", "left")
    return p.withColumns(
        {
            "score": round_half_up(F.col("score"), 2),
            "margin": round_half_up(F.col("margin"), 3),
            "coverage": round_half_up(F.col("coverage"), 3),
        }
    )
