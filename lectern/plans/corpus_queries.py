"""Reference-text build over all documents laid out as pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import corpus
from ..operators.expect import Watch, write_expected
from ..session import shared_folder
from . import sql as S
from . import tables as T
from .registry import registry as R

# The same build stated over single words with windows.
LINES = r"""ln AS (SELECT doc_id, i AS li, i // 42 + 1 AS page, i % 42 + 1 AS line, ls[i + 1] AS txt FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""
RAWS = rf"""runs AS (SELECT doc_id, li, page, line, r AS run, regexp_replace(regexp_replace(rs[r + 1], '#[[][^]]*[]]', '', 'g'), '#[(]p[)]', '', 'g') AS rt FROM (SELECT *, unnest(range(len(rs))) AS r FROM (SELECT *, string_split(txt, ', ') AS rs FROM ln))),
raws AS (SELECT doc_id, li, page, line, run, w AS raw, ws[w + 1] AS rw, contains(ws[w + 1], '.') AS ends FROM (SELECT *, unnest(range(len(ws))) AS w FROM (SELECT *, list_filter(string_split_regex(rt, '\s+'), lambda x: x <> '') AS ws FROM runs))),
raws2 AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY li, run, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ends_before FROM raws),
tk AS (SELECT doc_id, li, page, line, run, raw, t AS tok, ts[t + 1] AS word, ends_before FROM (SELECT *, unnest(range(len(ts))) AS t FROM (SELECT *, {S.toks('rw')} AS ts FROM raws2))),
fw AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY li, run, raw, tok) - 1 AS pos,
  row_number() OVER (PARTITION BY doc_id, li ORDER BY run, raw, tok) AS in_line,
  coalesce(lag(run) OVER (PARTITION BY doc_id, li ORDER BY run, raw, tok), 0) AS prev_run FROM tk)"""
QUEUE = """queue AS (SELECT ln.doc_id, ln.li, coalesce(e.n, 0) + CASE WHEN ln.li = 0 THEN 1 ELSE 0 END AS queued FROM ln LEFT JOIN (SELECT doc_id, li, sum(ends::INT) AS n FROM raws GROUP BY ALL) e USING (doc_id, li))"""
OPENS = """op0 AS (SELECT doc_id, ends_before, arg_min(li, pos) AS li, arg_min(page, pos) AS page, arg_min(line, pos) AS line, min(pos) AS pos FROM fw GROUP BY ALL),
op1 AS (SELECT op0.*, queued, row_number() OVER (PARTITION BY doc_id, li ORDER BY pos) AS nth FROM op0 JOIN queue USING (doc_id, li)),
opens AS (SELECT *, nth <= queued AS is_real, sum((nth <= queued)::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS verse_id FROM op1)"""
VERSES = """verses AS (SELECT doc_id, verse_id, doc_id % 5 + 1 AS book, li + 1 AS chapter, nth AS verse, pos AS start, page, line,
  coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY verse_id) - 1, (SELECT max(pos) FROM fw WHERE fw.doc_id = opens.doc_id)) AS stop FROM opens WHERE is_real)"""
LINE_TABLE = r"""lt AS (SELECT ln.doc_id, page AS n, line AS line_no, li, coalesce(sum(c) OVER (PARTITION BY ln.doc_id ORDER BY li ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  coalesce(sum(c) OVER (PARTITION BY ln.doc_id ORDER BY li), 0) - 1 AS stop, trim(regexp_replace(replace(txt, ', ', ' '), '\s+', ' ', 'g')) AS text, length(txt) < 60 AS petucha, contains(txt, ', ') AS gap
  FROM (SELECT ln.*, coalesce(k.c, 0) AS c FROM ln LEFT JOIN (SELECT doc_id, li, count(*) AS c FROM fw GROUP BY ALL) k USING (doc_id, li)) ln)"""
SECTIONS = """vs AS (SELECT *, count(*) OVER (PARTITION BY doc_id, section) AS c FROM (SELECT *, verse_id // 14 + 1 AS section, verse_id % 14 AS i FROM verses)),
sub AS (SELECT doc_id, section, n, min(start) AS start, max(stop) AS stop
  FROM (SELECT *, unnest(list_distinct([(i * 7 // c + 1)::VARCHAR, CASE WHEN i = c - 1 THEN '7' END, CASE WHEN i = c - 1 THEN 'M' END])) AS n FROM vs) GROUP BY ALL),
sec AS (SELECT doc_id, section, doc_id % 5 + 1 AS book, min(start) AS start, max(stop) AS stop FROM sub GROUP BY ALL)"""
MARKS = """mk AS (SELECT doc_id, li, page, line, (li // 6) % 8 + 1 AS n FROM ln WHERE li % 6 = 0),
marks AS (SELECT *, sum((n = 1)::INT) OVER (PARTITION BY doc_id ORDER BY li) AS grp FROM mk)"""
WORD_VERSE = "wv AS (SELECT fw.*, verse_id FROM fw JOIN opens USING (doc_id, ends_before))"
BASE = S.ctes(LINES, RAWS)
FULL = S.ctes(LINES, RAWS, QUEUE, OPENS, VERSES, WORD_VERSE, LINE_TABLE)


@R.query("flatten_words", BASE + "SELECT doc_id, page, line, run, in_line, word FROM fw")
def _(spark, d):
    w = T.corpus_of(spark, d).words_flat
    return w.select("doc_id", "page", "line", "run", (F.col("i") + 1).alias("in_line"), "word")


@R.query("word_index", BASE + "SELECT doc_id, pos, word FROM fw")
def _(spark, d):
    return T.corpus_of(spark, d).words_flat.select("doc_id", "pos", "word")


@R.query("assign_verse", FULL + "SELECT doc_id, pos, verse_id FROM wv")
def _(spark, d):
    return T.corpus_of(spark, d).words.select("doc_id", "pos", "verse_id")


@R.query("verse_opens", FULL + "SELECT doc_id, pos, page, line, verse_id, is_real FROM opens")
def _(spark, d):
    return T.corpus_of(spark, d).opens.select(
        "doc_id", "pos", "page", "line", "verse_id", F.col("ref").isNotNull().alias("is_real")
    )


@R.query(
    "mark_gaps",
    BASE + "SELECT doc_id, pos, in_line = 1 AND length(txt) < 60 AS petucha_before, run > prev_run AS gap_before FROM fw JOIN (SELECT doc_id, li, txt FROM ln) USING (doc_id, li)",
)
def _(spark, d):
    return T.corpus_of(spark, d).words_flat.select("doc_id", "pos", "petucha_before", "gap_before")


@R.query(
    "line_and_column_ranges",
    FULL + """SELECT doc_id, n, line_no, start AS first, stop AS last, text, petucha::INT AS petucha, gap::INT AS gap FROM lt
    UNION ALL SELECT doc_id, n, 0, min(start), max(stop), '', sum(petucha::INT), sum(gap::INT) FROM lt GROUP BY doc_id, n""",
)
def _(spark, d):
    c = T.corpus_of(spark, d)
    span = [F.col("start").alias("first"), F.col("end").alias("last")]
    flags = [F.col(x).cast("bigint").alias(x) for x in ("petucha", "gap")]
    cols = c.columns.select("doc_id", "n", F.lit(0).alias("line_no"), *span, F.lit("").alias("text"), "petucha", "gap")
    return c.lines.select("doc_id", "n", "line_no", *span, "text", *flags).unionByName(cols)


@R.query("verse_start_end", FULL + "SELECT doc_id, verse_id, book, chapter, verse, start AS first, stop AS last FROM verses")
def _(spark, d):
    return T.corpus_of(spark, d).verses.select(
        "doc_id", "verse_id", "book", "chapter", "verse", F.col("start").alias("first"), F.col("end").alias("last")
    )


@R.query(
    "section_spans",
    S.ctes(LINES, RAWS, QUEUE, OPENS, VERSES, SECTIONS)
    + "SELECT doc_id, section, '' AS n, start AS first, stop AS last FROM sec UNION ALL SELECT doc_id, section, n, start, stop FROM sub",
)
def _(spark, d):
    c = T.corpus_of(spark, d)
    span = [F.col("start").alias("first"), F.col("end").alias("last")]
    return c.sections.select("doc_id", "section", F.lit("").alias("n"), *span).unionByName(
        c.subsections.select("doc_id", "section", "n", *span)
    )


@R.query("group_marks", S.ctes(LINES, MARKS) + "SELECT doc_id, page, line, n, grp FROM marks")
def _(spark, d):
    return T.corpus_of(spark, d).marks.select("doc_id", "page", "line", "n", "grp")


@R.query(
    "toc_check",
    FULL
    + """, toc AS (SELECT doc_id, doc_id % 5 + 1 AS book, li + 1 AS chapter, unnest(range(1, queued::BIGINT + 1)) AS verse, page AS toc_page, line + (length(txt) < 60)::INT AS toc_line FROM queue JOIN ln USING (doc_id, li))
    SELECT doc_id, book, chapter, verse, page, line, toc_page, toc_line FROM verses JOIN toc USING (doc_id, book, chapter, verse) WHERE page <> toc_page OR line <> toc_line""",
)
def _(spark, d):
    c = T.corpus_of(spark, d)
    toc = c.pages.select("doc_id", F.explode("verses").alias("v"), "page", (F.col("line") + F.col("isPetucha").cast("int")).alias("line"))
    found = corpus.toc_check(c.verses, toc.select("doc_id", "v.*", "page", "line"))
    return found.select("doc_id", "book", "chapter", "verse", "page", "line", "toc_page", "toc_line")


@R.query(
    "leftover_refs",
    FULL
    + """SELECT doc_id, page, line, queued - coalesce(u, 0) AS leftover FROM queue JOIN ln USING (doc_id, li) LEFT JOIN (SELECT doc_id, li, count(*) AS u FROM opens WHERE is_real GROUP BY ALL) USING (doc_id, li) WHERE queued > coalesce(u, 0)""",
)
def _(spark, d):
    c = T.corpus_of(spark, d)
    return corpus.leftover_refs(c.lines_parsed, c.opens)


@R.query(
    "marks_vs_sections",
    S.ctes(LINES, RAWS, QUEUE, OPENS, VERSES, SECTIONS, MARKS)
    + """SELECT sub.doc_id, section, n, bool_or(m.page IS NOT NULL) AS marked, bool_or(v.start IS NOT NULL) AS agrees FROM sub
    LEFT JOIN (SELECT doc_id, grp AS section, CASE WHEN n = 8 THEN 'M' ELSE n::VARCHAR END AS n, page, line FROM marks) m USING (doc_id, section, n)
    LEFT JOIN verses v ON v.doc_id = sub.doc_id AND v.page = m.page AND v.line = m.line AND v.start = sub.start GROUP BY ALL""",
)
def _(spark, d):
    c = T.corpus_of(spark, d)
    return corpus.marks_vs_sections(c.marks, c.subsections, c.verses)


@R.query(
    "contiguity_check",
    S.ctes(LINES, RAWS, QUEUE, OPENS, VERSES, SECTIONS)
    + """, x AS (SELECT *, lag(stop) OVER (PARTITION BY doc_id ORDER BY section) AS prev, coalesce(lag(section) OVER (PARTITION BY doc_id ORDER BY section), 0) AS before, max(section) OVER (PARTITION BY doc_id) AS tail FROM sec)
    SELECT doc_id, section, CASE WHEN section <> before + 1 THEN 'missing' WHEN start <> prev + 1 THEN 'gap' ELSE 'short-end' END AS problem FROM x
    WHERE section <> before + 1 OR coalesce(start <> prev + 1, false) OR (section = tail AND stop <> (SELECT max(pos) FROM fw WHERE fw.doc_id = x.doc_id))""",
)
def _(spark, d):
    c = T.corpus_of(spark, d)
    return corpus.contiguity_check(c.sections, corpus.last_words(c.lines_parsed, "pos"))


@R.query(
    "hard_checks",
    S.ctes(LINES, RAWS, QUEUE, OPENS, VERSES, SECTIONS, MARKS)
    + r"""SELECT w.doc_id, bad_words, first_word, last_word, (SELECT max(page) FROM ln WHERE ln.doc_id = w.doc_id) AS columns, coalesce(g, 0) AS mark_groups, coalesce(s, 0) AS sections
    FROM (SELECT doc_id, count(*) FILTER (NOT regexp_full_match(word, '\p{L}+')) AS bad_words, arg_min(word, pos) AS first_word, arg_max(word, pos) AS last_word FROM fw GROUP BY doc_id) w
    LEFT JOIN (SELECT doc_id, max(grp) AS g FROM marks GROUP BY ALL) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS s FROM sec GROUP BY ALL) USING (doc_id)""",
)
def _(spark, d):
    c = T.corpus_of(spark, d)
    return corpus.hard_checks(c.pieces, c.columns, c.marks, c.sections)


@R.query(
    "build_report",
    FULL
    + """SELECT w.doc_id, words, forms, petucha_gaps, inline_gaps, verses, internal_ends, columns, min_lines, max_lines FROM
    (SELECT doc_id, count(*) AS words, count(DISTINCT word) AS forms, count(*) FILTER (in_line = 1 AND length(txt) < 60) AS petucha_gaps, count(*) FILTER (run > prev_run) AS inline_gaps
      FROM fw JOIN (SELECT doc_id, li, txt FROM ln) USING (doc_id, li) GROUP BY doc_id) w
    JOIN (SELECT doc_id, count(*) FILTER (is_real) AS verses, count(*) FILTER (NOT is_real) AS internal_ends FROM opens GROUP BY doc_id) USING (doc_id)
    JOIN (SELECT doc_id, count(*) AS columns, min(c) AS min_lines, max(c) AS max_lines FROM (SELECT doc_id, page, count(*) AS c FROM ln GROUP BY ALL) GROUP BY doc_id) USING (doc_id)""",
)
def _(spark, d):
    c = T.corpus_of(spark, d)
    return corpus.build_report(c.pieces, c.lines_parsed, c.opens, c.columns)


@R.query(
    "checked_build",
    S.ctes(LINES, RAWS, QUEUE, OPENS, VERSES, SECTIONS, MARKS)
    + r"""SELECT w.doc_id, first_word, last_word, (SELECT count(*) FROM fw) AS all_words, (SELECT count(DISTINCT doc_id) FROM fw) AS rows, 0 AS bad_words
    FROM (SELECT doc_id, arg_min(word, pos) AS first_word, arg_max(word, pos) AS last_word FROM fw GROUP BY doc_id) w""",
)
def _(spark, d):
    c = T.corpus_of(spark, d)
    facts = corpus.hard_checks(c.pieces, c.columns, c.marks, c.sections)
    facts = facts.join(c.lines_parsed.groupBy("doc_id").agg(F.sum("n_words").alias("n_words")), "doc_id")
    watch = Watch(corpus.expectations({"bad_words": 0}), {"all_words": F.sum("n_words")}, {"all_words": (1, None)})
    path = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    report = write_expected(facts, path, watch)
    totals = [F.lit(report[n]).alias(n) for n in ("all_words", "rows", "bad_words")]
    return spark.read.parquet(path).select("doc_id", "first_word", "last_word", *totals)
