"""Placement, navigation and targets; spans are taken at the start of every section of every document."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import corpus, navigate, placement, targets
from . import corpus_queries as C
from . import sql as S
from . import tables as T
from .registry import registry as R

SPANS = """nw AS (SELECT doc_id, len(t) AS nw FROM doc_toks WHERE len(t) > 0),
secs AS (SELECT doc_id, nw, unnest(range(1, (nw - 1) // 210 + 2)) AS n FROM nw),
sp AS (SELECT *, list_transform(range(6), lambda i: CASE WHEN i = 2 OR a + i * (9 + n % 4) + (i * i) % 3 > b THEN NULL ELSE a + i * (9 + n % 4) + (i * i) % 3 END) AS ls, [9, 9, 0, 9, 9, n % 5] AS lt
  FROM (SELECT doc_id * 1000 + n AS query_id, doc_id, n, nw, greatest(0, (n - 1) * 210 - 2) AS a, least(nw - 1, (n - 1) * 210 + 57) AS b, n * 7 % 50 AS visible FROM secs)),
subs AS (SELECT doc_id, i // 7 + 1 AS section, (i % 7 + 1)::VARCHAR AS n, i * 30 AS s, least(i * 30 + 30, nw) - 1 AS e FROM (SELECT doc_id, nw, unnest(range((nw - 1) // 30 + 1)) AS i FROM nw))"""
PLACED = """cols AS (SELECT doc_id, n, min(start) AS s, max(stop) AS e FROM lt GROUP BY ALL HAVING max(stop) >= min(start)),
sc AS (SELECT sp.query_id, CASE WHEN moved THEN x.n ELSE c.n END AS col, CASE WHEN moved THEN x.s ELSE c.s END AS col_start, CASE WHEN moved THEN x.e ELSE c.e END AS col_end
  FROM sp JOIN cols c ON c.doc_id = sp.doc_id AND a BETWEEN c.s AND c.e LEFT JOIN cols x ON x.doc_id = c.doc_id AND x.n = c.n + 1, LATERAL (SELECT coalesce(c.e - a < 3 AND b > c.e AND x.n IS NOT NULL, false) AS moved)),
fl AS (SELECT query_id, col, col_start, col_end, abs(a - col_start) <= 2 AS from_start, line_no AS first_line FROM (SELECT sp.*, sc.* EXCLUDE (query_id), list_filter(ls, lambda v: v IS NOT NULL AND v >= col_start AND v <= col_end)[1] AS fa FROM sp JOIN sc USING (query_id)) z
  LEFT JOIN lt ON lt.doc_id = z.doc_id AND lt.n = z.col AND fa BETWEEN lt.start AND lt.stop),
ly0 AS (SELECT query_id, visible, list_filter(list_transform(range(1, 6), lambda i: CASE WHEN ls[i + 1] > ls[i] AND ls[i + 1] - ls[i] < 40 THEN ls[i + 1] - ls[i] END), lambda v: v IS NOT NULL) AS steps, list_filter(lt, lambda v: v > 0) AS counts FROM sp),
ly1 AS (SELECT *, CASE WHEN len(steps) > 0 THEN list_sum(steps) / len(steps) ELSE list_sum(counts) / len(counts) END AS w FROM ly0),
ly AS (SELECT query_id, floor(w * 10 + 0.5) / 10 AS wpl, CASE WHEN visible >= 35 THEN floor(w * visible + 0.5)::INT END AS wpc FROM ly1)"""
SP = S.ctes(S.DOC_TOKS, SPANS)
ALL = S.ctes(S.DOC_TOKS, SPANS, C.LINES, C.RAWS, C.QUEUE, C.OPENS, C.VERSES, C.LINE_TABLE, PLACED)


def spans(spark, d):
    """query_id, doc_id, n, n_words, start, end, line_starts, line_tokens, visible."""
    s = T._spans(T.word_counts(spark, d), T.SECTION, "n", "n_words").drop("start", "end")
    s = s.withColumns(
        {
            "query_id": F.col("doc_id") * 1000 + F.col("n"),
            "start": F.greatest(F.lit(0), (F.col("n") - 1) * 210 - 2),
            "end": F.least(F.col("n_words") - 1, (F.col("n") - 1) * 210 + 57),
            "visible": F.col("n") * 7 % 50,
            "line_tokens": F.array(*[F.lit(x) for x in (9, 9, 0, 9, 9)], F.col("n") % 5),
        }
    )
    at = lambda i: F.col("start") + i * (F.col("n") % 4 + 9) + i * i % 3
    cells = [F.lit(None).cast("int") if i == 2 else F.when(at(i) <= F.col("end"), at(i)) for i in range(6)]
    return s.withColumn("line_starts", F.array(*cells))


def ref(spark, d):
    c = T.corpus_of(spark, d)
    return {
        "pages": c.pages,
        "gaps": corpus.gaps(c.lines_parsed),
        "verses": c.verses,
        "columns": c.columns,
        "line_spans": c.line_spans,
        "sections": T.sections(spark, d),
        "subsections": T.subsections(spark, d),
    }


@R.query("word_ref", ALL + "SELECT query_id, book, chapter, verse FROM sp JOIN verses v ON v.doc_id = sp.doc_id AND a BETWEEN v.start AND v.stop")
def _(spark, d):
    p = spans(spark, d).select("query_id", "doc_id", "start")
    return placement.word_ref(p, "start", T.corpus_of(spark, d).verses).select("query_id", "book", "chapter", "verse")


@R.query("overlapping_sections", SP + "SELECT query_id, sp.doc_id, s.n AS section FROM sp JOIN secs s ON s.doc_id = sp.doc_id AND (s.n - 1) * 210 <= b AND least(s.n * 210, s.nw) - 1 >= a")
def _(spark, d):
    return placement.overlapping_sections(spans(spark, d), T.sections(spark, d))


@R.query("overlapping_subsections", SP + "SELECT query_id, sp.doc_id, section, s.n, s.s BETWEEN a AND b AS starts_here FROM sp JOIN subs s ON s.doc_id = sp.doc_id AND s.s <= b AND s.e >= a")
def _(spark, d):
    return placement.overlapping_subsections(spans(spark, d), T.subsections(spark, d))


@R.query("standard_column", ALL + "SELECT query_id, col AS \"column\", col_start, col_end, from_start AS from_column_start FROM fl")
def _(spark, d):
    c = placement.standard_column(spans(spark, d).drop("n"), T.corpus_of(spark, d).columns)
    return c.select("query_id", "column", "col_start", "col_end", "from_column_start")


@R.query("first_line", ALL + "SELECT query_id, col AS \"column\", first_line FROM fl")
def _(spark, d):
    c = T.corpus_of(spark, d)
    s = placement.first_line(placement.standard_column(spans(spark, d).drop("n"), c.columns), c.line_spans)
    return s.select("query_id", "column", "first_line")


@R.query("estimate_layout", ALL + "SELECT query_id, round(wpl, 6) AS words_per_line, wpc AS words_per_column FROM ly")
def _(spark, d):
    return placement.estimate_layout(spans(spark, d)).select("query_id", F.round("words_per_line", 6).alias("words_per_line"), "words_per_column")


FIRST_SQL = """fwd AS (SELECT sp.query_id, string_agg(word, ' ' ORDER BY pos) AS first_words FROM sp JOIN fw ON fw.doc_id = sp.doc_id AND pos BETWEEN a AND least(b, a + 3) GROUP BY ALL),
voc AS (SELECT sp.query_id, array_to_string(string_split(lt.text, ' ')[a - lt.start + 1 : a - lt.start + 4], ' ') AS first_words_vocalized FROM sp JOIN sc USING (query_id) JOIN lt ON lt.doc_id = sp.doc_id AND lt.n = sc.col AND a BETWEEN lt.start AND lt.stop)"""


@R.query("first_words", ALL + f", {FIRST_SQL} SELECT query_id, first_words, first_words_vocalized FROM sp JOIN fwd USING (query_id) LEFT JOIN voc USING (query_id)")
def _(spark, d):
    r = ref(spark, d)
    s = placement.standard_column(spans(spark, d).drop("n"), r["columns"])
    return placement.first_words(s, r["line_spans"], r["pages"]).select("query_id", "first_words", "first_words_vocalized")


def _placed(spark, d):
    s = spans(spark, d).withColumns(
        {
            "score": F.col("end") / 7,
            "margin": F.col("n") / 13,
            "coverage": (F.col("n") % 10 + 1) / 11,
            "aligned": F.col("end") - F.col("start") + 1,
            "lines_covered": F.lit(5),
        }
    )
    return placement.build_placement(s.drop("n", "n_words"), ref(spark, d))


@R.query(
    "build_placement",
    ALL
    + f""", {FIRST_SQL}, os AS (SELECT query_id, string_agg(s.n::VARCHAR, ',' ORDER BY s.n) AS sections FROM sp JOIN secs s ON s.doc_id = sp.doc_id AND (s.n - 1) * 210 <= b AND least(s.n * 210, s.nw) - 1 >= a GROUP BY ALL),
    ob AS (SELECT query_id, string_agg(section || '.' || s.n || CASE WHEN s.s BETWEEN a AND b THEN '*' ELSE '' END, ',' ORDER BY section, s.n) AS subsections FROM sp JOIN subs s ON s.doc_id = sp.doc_id AND s.s <= b AND s.e >= a GROUP BY ALL)
    SELECT query_id, sp.doc_id, a AS first, b AS last, va.chapter || ':' || va.verse || '-' || vb.chapter || ':' || vb.verse AS verses, sections, subsections, col AS "column", first_line, from_start AS from_column_start, first_words, first_words_vocalized, round(wpl, 6) AS words_per_line, wpc AS words_per_column,
    round(floor(b / 7 * 100 + 0.5) / 100, 6) AS score, round(floor(n / 13 * 1000 + 0.5) / 1000, 6) AS margin, round(floor((n % 10 + 1) / 11 * 1000 + 0.5) / 1000, 6) AS coverage
    FROM sp JOIN fl USING (query_id) JOIN ly USING (query_id) JOIN fwd USING (query_id) LEFT JOIN voc USING (query_id) LEFT JOIN os USING (query_id) LEFT JOIN ob USING (query_id)
    LEFT JOIN verses va ON va.doc_id = sp.doc_id AND a BETWEEN va.start AND va.stop LEFT JOIN verses vb ON vb.doc_id = sp.doc_id AND b BETWEEN vb.start AND vb.stop""",
)
def _(spark, d):
    v = lambda s: F.concat(F.col(f"verse_{s}.chapter"), F.lit(":"), F.col(f"verse_{s}.verse"))
    mark = lambda x: F.concat(x["section"].cast("string"), F.lit("."), x["n"], F.when(x["starts_here"], "*").otherwise(""))
    return _placed(spark, d).select(
        "query_id",
        "doc_id",
        F.col("start").alias("first"),
        F.col("end").alias("last"),
        F.concat(v("start"), F.lit("-"), v("end")).alias("verses"),
        F.array_join(F.col("sections").cast("array<string>"), ",").alias("sections"),
        F.array_join(F.transform("subsections", mark), ",").alias("subsections"),
        "column",
        "first_line",
        "from_column_start",
        "first_words",
        "first_words_vocalized",
        *[F.round(c, 6).alias(c) for c in ("words_per_line", "score", "margin", "coverage")],
        "words_per_column",
    )


# ---- navigation: sections with an even number are scans of a scroll without the standard layout ----

NAV = """pl AS (SELECT sp.query_id, sp.doc_id, n, nw, a, b, ls, visible, CASE WHEN n % 2 = 1 THEN col END AS col, CASE WHEN n % 2 = 1 THEN col_start END AS cs, CASE WHEN n % 2 = 1 THEN col_end END AS ce, CASE WHEN n % 2 = 1 THEN first_line END AS fl, wpl, wpc, CASE WHEN n % 4 = 0 THEN 100 + n END AS learned
  FROM sp JOIN fl USING (query_id) JOIN ly USING (query_id)),
spn AS (SELECT *, coalesce(cs, greatest(0, a - floor(coalesce(fl - 1, 0) * wpl + 0.5)))::INT AS ss, coalesce(ce, b + floor(greatest(0, visible - 6) * wpl + 0.5))::INT AS se FROM pl),
tg AS (SELECT query_id, 'near' AS target_id, least(nw - 1, a + 13) AS word FROM sp UNION ALL SELECT query_id, 'far', (a * 3 + 500) % nw FROM sp),
mv0 AS (SELECT spn.*, target_id, word, word BETWEEN ss AND se AS here, CASE WHEN col IS NOT NULL THEN abs(tc.n - col) END AS exact, coalesce(learned, wpc, floor(wpl * 42 + 0.5)) AS w
  FROM spn JOIN tg USING (query_id) LEFT JOIN cols tc ON tc.doc_id = spn.doc_id AND word BETWEEN tc.s AND tc.e),
mv AS (SELECT *, CASE WHEN here THEN 'here' ELSE 'move' END AS status, CASE WHEN here THEN NULL WHEN word < a THEN 'towards-start' ELSE 'towards-end' END AS direction, word - a AS word_delta,
  CASE WHEN here THEN 0 WHEN exact IS NOT NULL THEN exact ELSE greatest(1, floor(abs(word - ss) / w + 0.5)) END::INT AS columns, CASE WHEN NOT here AND exact IS NULL THEN w::INT END AS wpc_used FROM mv0)"""
HINT = """gl AS (SELECT mv.*, lt.line_no, lt.start AS lstart, lt.text AS ltext FROM mv LEFT JOIN lt ON lt.doc_id = mv.doc_id AND lt.n = mv.col AND word BETWEEN lt.start AND lt.stop WHERE here),
hl AS (SELECT *, list_filter(list_transform(range(1, 7), lambda i: CASE WHEN ls[i] IS NOT NULL AND word >= ls[i] AND coalesce(word < list_filter(ls[i + 1:], lambda v: v IS NOT NULL)[1], true) THEN i END), lambda v: v IS NOT NULL)[1] AS ri FROM gl),
ww AS (SELECT hl.query_id, target_id, string_agg(fw.word, ' ' ORDER BY fw.pos) AS words_here FROM hl JOIN fw ON fw.doc_id = hl.doc_id AND fw.pos BETWEEN hl.word AND hl.word + 3 GROUP BY ALL),
hint AS (SELECT hl.query_id, hl.target_id, coalesce(line_no, coalesce(fl, 1) + ri - 1, greatest(1, floor(coalesce(fl, 1) + (hl.word - a) / wpl + 0.5)))::INT AS line, line_no IS NOT NULL OR ri IS NOT NULL AS line_exact,
  CASE WHEN line_no IS NOT NULL THEN lstart = hl.word WHEN ri IS NOT NULL THEN ls[ri] = hl.word ELSE false END AS at_line_start, coalesce(words_here, '') AS words_here,
  CASE WHEN line_no IS NOT NULL THEN nullif(array_to_string(string_split(ltext, ' ')[hl.word - lstart + 1 : hl.word - lstart + 3], ' '), '') END AS words_vocalized,
  CASE WHEN fw.in_line = 1 AND length(ln.txt) < 60 THEN 'petucha' WHEN fw.run > fw.prev_run THEN 'setuma' ELSE 'none' END AS gap
  FROM hl LEFT JOIN ww USING (query_id, target_id) LEFT JOIN fw ON fw.doc_id = hl.doc_id AND fw.pos = hl.word LEFT JOIN ln ON ln.doc_id = fw.doc_id AND ln.li = fw.li)"""
NAV_ALL = S.ctes(S.DOC_TOKS, SPANS, C.LINES, C.RAWS, C.QUEUE, C.OPENS, C.VERSES, C.LINE_TABLE, PLACED, NAV)


_kept: dict[tuple, object] = {}


def keep(spark, d, name, build):
    """A small table several stages read, planned once per session and kept (on disk beyond memory)."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _kept:
        _kept[key] = build().persist()
    return _kept[key]


def placements(spark, d):
    return keep(spark, d, "placements", lambda: _placements(spark, d))


def _placements(spark, d):
    r = ref(spark, d)
    s = placement.estimate_layout(spans(spark, d))
    col = placement.first_line(placement.standard_column(s.drop("n"), r["columns"]), r["line_spans"])
    odd = F.col("n") % 2 == 1
    s = s.join(col.select("query_id", "column", "col_start", "col_end", "first_line"), "query_id")
    s = s.withColumns({c: F.when(odd, F.col(c)) for c in ("column", "col_start", "col_end", "first_line")})
    return s.withColumn("transcribed", F.lit(6)).withColumn("learned", F.when(F.col("n") % 4 == 0, F.col("n") + 100))


def nav_targets(spark, d):
    s = spans(spark, d)
    near = s.select("query_id", "doc_id", F.lit("near").alias("target_id"), F.least(F.col("n_words") - 1, F.col("start") + 13).alias("word"))
    far = s.select("query_id", "doc_id", F.lit("far").alias("target_id"), ((F.col("start") * 3 + 500) % F.col("n_words")).alias("word"))
    return near.unionByName(far)


@R.query("column_span", NAV_ALL + "SELECT query_id, ss AS span_start, se AS span_end FROM spn")
def _(spark, d):
    return navigate.column_span(placements(spark, d)).select("query_id", "span_start", "span_end")


MOVE = ["query_id", "target_id", "status", "direction", "word_delta"]


def _moves(spark, d):
    build = lambda: navigate.moves(placements(spark, d), nav_targets(spark, d), T.corpus_of(spark, d).columns)
    return keep(spark, d, "moves", build)


@R.query("here_or_move", NAV_ALL + f"SELECT {', '.join(MOVE)} FROM mv")
def _(spark, d):
    return _moves(spark, d).select(*MOVE)


@R.query("columns_exact", NAV_ALL + "SELECT query_id, target_id, columns FROM mv WHERE NOT here AND exact IS NOT NULL")
def _(spark, d):
    return _moves(spark, d).where("columns_exact").select("query_id", "target_id", "columns")


@R.query("columns_estimated", NAV_ALL + "SELECT query_id, target_id, columns, wpc_used FROM mv WHERE wpc_used IS NOT NULL")
def _(spark, d):
    return _moves(spark, d).where("wpc_used is not null").select("query_id", "target_id", "columns", "wpc_used")


@R.query("line_hint", NAV_ALL + f", {HINT} SELECT * FROM hint")
def _(spark, d):
    r = ref(spark, d)
    return navigate.line_hint(_moves(spark, d).where("here"), r["line_spans"], r["pages"], r["gaps"])


@R.query(
    "navigate",
    NAV_ALL
    + f", {HINT} SELECT {', '.join('mv.' + c for c in MOVE)}, columns, CASE WHEN here THEN line_exact ELSE exact IS NOT NULL END AS columns_exact, wpc_used, line, line_exact, at_line_start, words_here, words_vocalized, gap FROM mv LEFT JOIN hint USING (query_id, target_id)",
)
def _(spark, d):
    return navigate.navigate(placements(spark, d), nav_targets(spark, d), ref(spark, d))


@R.query(
    "gap_before",
    NAV_ALL + "SELECT query_id, target_id, CASE WHEN in_line = 1 AND length(txt) < 60 THEN 'petucha' WHEN run > prev_run THEN 'setuma' ELSE 'none' END AS gap FROM tg JOIN sp USING (query_id) LEFT JOIN fw ON fw.doc_id = sp.doc_id AND fw.pos = tg.word LEFT JOIN (SELECT doc_id, li, txt FROM ln) l ON l.doc_id = fw.doc_id AND l.li = fw.li",
)
def _(spark, d):
    return navigate.gap_before(nav_targets(spark, d), "word", corpus.gaps(T.corpus_of(spark, d).lines_parsed), ["query_id", "target_id"])


@R.query(
    "learned_wpc",
    """WITH e AS (SELECT event_id AS id, user_id AS client, ts, floor(value * 10) AS wpc FROM events WHERE event_type IN ('view', 'click')),
    m AS (SELECT *, floor(avg(wpc) OVER (PARTITION BY client ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 0.5)::INT AS m FROM e)
    SELECT id, client, CASE WHEN m > 50 AND m < 2000 THEN m END AS learned FROM m""",
)
def _(spark, d):
    e = T.raw(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    e = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 10).alias("wpc"))
    return navigate.learned_wpc(e).select("id", "client", "learned")


VERSE_SQL = S.ctes(C.LINES, C.RAWS, C.QUEUE, C.OPENS, C.VERSES)
REQUESTS = """rq AS (SELECT o_orderkey AS request_id, o_orderkey % (SELECT count(*) FROM documents) AS doc_id, o_custkey % 30 + 1 AS chapter, o_orderkey % 4 + 1 AS verse, o_orderdate::DATE AS day, o_orderpriority AS pr, o_custkey AS cust FROM orders)"""


def _requests(spark, d):
    n = T.raw(spark, d, "documents").count()
    o = T.raw(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("o_orderkey") % n).alias("doc_id"),
        (F.col("o_orderkey") % n % 5 + 1).cast("int").alias("book"),
        (F.col("o_custkey") % 30 + 1).cast("int").alias("chapter"),
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("verse"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("pr"),
        F.col("o_custkey").alias("cust"),
    )


@R.query("target_from_verse", VERSE_SQL + f", {REQUESTS} SELECT request_id, v.start AS word FROM rq LEFT JOIN verses v ON v.doc_id = rq.doc_id AND v.chapter = rq.chapter AND v.verse = rq.verse")
def _(spark, d):
    r = navigate.target_from_verse(_requests(spark, d).withColumn("label", F.lit("")), T.corpus_of(spark, d).verses)
    return r.select("request_id", "word")


@R.query(
    "scroll_position",
    VERSE_SQL + f", {S.DOC_TOKS}, {SPANS}" + """ SELECT sp.query_id, book_start, total_words, round(least(100, greatest(0, a / total_words * 100)), 6) AS percent FROM sp JOIN (SELECT doc_id, start AS book_start FROM verses WHERE chapter = 1 AND verse = 1) USING (doc_id) JOIN (SELECT doc_id, max(pos) + 1 AS total_words FROM fw GROUP BY ALL) USING (doc_id)""",
)
def _(spark, d):
    c = T.corpus_of(spark, d)
    j = spans(spark, d).join(navigate.scroll_info(c.verses, corpus.last_words(c.lines_parsed, "pos")), "doc_id")
    return j.select("query_id", "book_start", "total_words", F.round(navigate.percent(F.col("start"), F.col("total_words")), 6).alias("percent"))


# ---- targets ----

SUB_SQL = S.ctes(C.LINES, C.RAWS, C.QUEUE, C.OPENS, C.VERSES, C.SECTIONS)
CALENDAR = """cal AS (SELECT day AS date, 5700 + cust % 3 AS year, 'R' || cust % 10 AS reading, CASE WHEN cust % 10 < 3 THEN 'weekday' WHEN cust % 10 < 7 THEN 'shabbat' ELSE 'holiday' END AS type, 'S' || cust % 10 AS summary,
  CASE WHEN pr = '1-URGENT' THEN 'M' ELSE (request_id % 7 + 1)::VARCHAR END AS key, doc_id, chapter, verse, CASE WHEN pr = '1-URGENT' AND cust % 4 > 0 THEN 'special' END AS reason FROM rq)"""
READS = """rd AS (SELECT cal.*, doc_id % 5 + 1 AS book, v.start AS word, v.stop AS end_word FROM cal JOIN verses v USING (doc_id, chapter, verse))"""


def _calendar(spark, d):
    r = _requests(spark, d)
    kind = F.col("cust") % 10
    ref = F.struct("chapter", "verse")
    return r.select(
        "date",
        (F.col("cust") % 3 + 5700).cast("int").alias("year"),
        F.concat(F.lit("R"), kind).alias("reading"),
        F.when(kind < 3, "weekday").when(kind < 7, "shabbat").otherwise("holiday").alias("type"),
        F.concat(F.lit("S"), kind).alias("summary"),
        F.when(F.col("pr") == "1-URGENT", "M").otherwise((F.col("request_id") % 7 + 1).cast("string")).alias("key"),
        "doc_id",
        "book",
        ref.alias("begin"),
        ref.alias("end"),
        F.when((F.col("pr") == "1-URGENT") & (F.col("cust") % 4 > 0), "special").alias("reason"),
    )


SECTION_REQ = "sr AS (SELECT request_id, doc_id, chapter AS section, CASE WHEN pr = '1-URGENT' THEN 'M' WHEN pr = '2-HIGH' THEN NULL ELSE (request_id % 7 + 1)::VARCHAR END AS n FROM rq)"


def _section_requests(spark, d):
    n = F.when(F.col("pr") == "1-URGENT", "M").when(F.col("pr") != "2-HIGH", (F.col("request_id") % 7 + 1).cast("string"))
    return _requests(spark, d).select("request_id", "doc_id", F.col("chapter").alias("section"), n.alias("n"))


@R.query(
    "subsection_targets",
    SUB_SQL
    + f", {REQUESTS}, {SECTION_REQ} SELECT request_id, sr.doc_id, 'section-' || sr.section || '-' || sub.n AS target_id, start AS word, stop AS end_word, CASE WHEN sub.n IS NULL THEN 'not-found' END AS error FROM sr LEFT JOIN sub ON sub.doc_id = sr.doc_id AND sub.section = sr.section AND (sr.n IS NULL OR sr.n = sub.n)",
)
def _(spark, d):
    return targets.subsection_targets(_section_requests(spark, d), T.corpus_of(spark, d).subsections)


@R.query(
    "verse_targets",
    VERSE_SQL
    + f", {REQUESTS} SELECT request_id, rq.doc_id, 'verse-' || book || '-' || v.chapter || '-' || v.verse AS target_id, v.start AS word, v.stop AS end_word, CASE WHEN v.start IS NULL THEN 'not-found' END AS error FROM rq LEFT JOIN verses v ON v.doc_id = rq.doc_id AND v.chapter = rq.chapter AND v.verse = rq.verse",
)
def _(spark, d):
    return targets.verse_targets(_requests(spark, d), T.corpus_of(spark, d).verses)


@R.query(
    "readings_for_date",
    VERSE_SQL + f", {REQUESTS}, {CALENDAR}, {READS} SELECT strftime(date, '%Y-%m-%d') AS date, reading, type, summary, count(*) AS targets, count(DISTINCT book) > 1 AS multiple_books FROM rd GROUP BY ALL",
)
def _(spark, d):
    r = targets.readings_for_date(_calendar(spark, d), T.corpus_of(spark, d).verses)
    return r.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@R.query(
    "next_reading",
    VERSE_SQL
    + f""", {REQUESTS}, {CALENDAR}, {READS}, rn AS (SELECT date, string_agg(reading, ',' ORDER BY reading) AS names FROM (SELECT DISTINCT date, reading FROM rd) GROUP BY date),
    em AS (SELECT DISTINCT day FROM rq WHERE day NOT IN (SELECT date FROM rn)), nx AS (SELECT day, (SELECT min(date) FROM rn WHERE date > day AND date <= day + 10) AS nxt FROM em)
    SELECT strftime(day, '%Y-%m-%d') AS day, strftime(nxt, '%Y-%m-%d') AS next, names FROM nx LEFT JOIN rn ON rn.date = nxt""",
)
def _(spark, d):
    r = targets.readings_for_date(_calendar(spark, d), T.corpus_of(spark, d).verses)
    n = targets.next_reading(_requests(spark, d).select(F.col("date").alias("day")), r)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return n.select(iso("day"), iso("next"), F.array_join("names", ",").alias("names"))


@R.query(
    "special_dates",
    f"""WITH {REQUESTS}, {CALENDAR}, sd AS (SELECT date, year, reading, type, summary, bool_or(key = 'M' AND reason IS NOT NULL) AS special FROM cal WHERE type <> 'weekday' GROUP BY ALL)
    SELECT strftime(date, '%Y-%m-%d') AS date, year, string_agg(reading, ',' ORDER BY reading) AS names, string_agg(summary, ' · ' ORDER BY reading) AS summary FROM sd WHERE type <> 'shabbat' OR special GROUP BY date, year""",
)
def _(spark, d):
    s = targets.special_dates(_calendar(spark, d))
    return s.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "year", F.array_join("names", ",").alias("names"), "summary")


@R.query("list_sections", SUB_SQL + "SELECT doc_id, section, any_value(book) AS book, string_agg(n, ',' ORDER BY n) AS keys FROM sub JOIN (SELECT doc_id, section, book FROM sec) USING (doc_id, section) GROUP BY doc_id, section")
def _(spark, d):
    c = T.corpus_of(spark, d)
    s = targets.list_sections(c.sections, c.subsections)
    return s.select("doc_id", "section", "book", F.array_join("keys", ",").alias("keys"))


@R.query(
    "resolve_target",
    SUB_SQL
    + f""", {REQUESTS}, {SECTION_REQ}, {CALENDAR}, {READS}, sd AS (SELECT date, year, reading, type, summary, bool_or(key = 'M' AND reason IS NOT NULL) AS special FROM cal WHERE type <> 'weekday' GROUP BY ALL),
    sp AS (SELECT date, year, string_agg(reading, ', ' ORDER BY reading) AS names FROM sd WHERE type <> 'shabbat' OR special GROUP BY date, year)
    SELECT 'section' AS kind, request_id, 'section-' || sr.section || '-' || sub.n AS target_id, start AS word, NULL AS date FROM sr JOIN rq USING (request_id) LEFT JOIN sub ON sub.doc_id = sr.doc_id AND sub.section = sr.section AND (sr.n IS NULL OR sr.n = sub.n) WHERE pr IN ('1-URGENT', '2-HIGH')
    UNION ALL SELECT 'verse', request_id, 'verse-' || book || '-' || v.chapter || '-' || v.verse, v.start, NULL FROM rq LEFT JOIN verses v ON v.doc_id = rq.doc_id AND v.chapter = rq.chapter AND v.verse = rq.verse WHERE pr = '3-MEDIUM'
    UNION ALL SELECT 'date', request_id, strftime(rd.date, '%Y-%m-%d') || '-' || reading || '-' || key, word, strftime(rq.day, '%Y-%m-%d') FROM rq LEFT JOIN rd ON rd.date = rq.day WHERE pr = '4-NOT SPECIFIED'
    UNION ALL SELECT 'specials', request_id, names, NULL, strftime(sp.date, '%Y-%m-%d') FROM (SELECT *, 5700 + request_id % 900 AS y FROM rq WHERE pr = '5-LOW') LEFT JOIN sp ON sp.year = y""",
)
def _(spark, d):
    r = _requests(spark, d)
    kind = F.when(F.col("pr").isin("1-URGENT", "2-HIGH"), "section").when(F.col("pr") == "3-MEDIUM", "verse").when(F.col("pr") == "4-NOT SPECIFIED", "date").otherwise("specials")
    n = F.when(F.col("pr") == "1-URGENT", "M").when(F.col("pr") != "2-HIGH", (F.col("request_id") % 7 + 1).cast("string"))
    rq = r.withColumns({"kind": kind, "section": F.col("chapter"), "n": n, "year": (F.col("request_id") % 900 + 5700).cast("int")})
    c = T.corpus_of(spark, d)
    out = targets.resolve_targets(rq, c.subsections, c.verses, _calendar(spark, d), 5700, date(1998, 3, 4))
    return out.select("kind", "request_id", "target_id", "word", F.col("date_text").alias("date"))
