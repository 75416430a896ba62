"""Evaluation jobs over the documents, benchmark items, conversations, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_text, tokenize
from ..operators import evaluate, index, locate
from . import locate_queries as L
from . import sql as S
from . import tables as T
from .registry import registry as R

SEED = 7
PLAIN_FROM, PLAIN_TO = "éèêçäöüßíóúñáà", "eeecaousiounaa"


def cut_corpus(spark, d):
    """Documents as lines of eight words in columns of 42 lines."""
    per_line = 8
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(per_line))
    lines = T.corpus_index(spark, d).blocks().select("doc_id", "block", "words", F.explode(starts).alias("i"))
    lines = lines.select("doc_id", (F.col("block") * index.BLOCK + F.col("i")).alias("start"), F.slice("words", F.col("i") + 1, F.lit(per_line)).alias("words"))
    line = F.floor(F.col("start") / per_line).cast("int")
    return lines.select(
        "doc_id",
        (F.floor(line / 42) + 1).cast("int").alias("n"),
        (line % 42 + 1).alias("line_no"),
        "start",
        (F.col("start") + F.size("words") - 1).alias("end"),
        F.array_join("words", " ").alias("text"),
    )


def draw(*parts: str) -> str:
    joined = ", ".join(parts)
    return f"('0x' || substr(md5(concat_ws('|', {joined})), 1, 8))::BIGINT"


def unit(*parts: str) -> str:
    return f"({draw(*parts)} / 4294967296.0::DOUBLE)"


def q(x: str) -> str:
    return f"'{x}'"


CUT = """cut AS (SELECT doc_id, blk // 42 + 1 AS n, blk % 42 + 1 AS line_no, blk * 8 AS start, least(blk * 8 + 8, len(t)) - 1 AS stop, array_to_string(t[blk * 8 + 1 : blk * 8 + 8], ' ') AS text FROM (SELECT doc_id, t, unnest(range((len(t) + 7) // 8)) AS blk FROM doc_toks))"""
SAMPLE = f"""cc AS (SELECT doc_id, n, max(line_no) AS lines FROM cut GROUP BY ALL),
allc AS (SELECT *, row_number() OVER (ORDER BY doc_id, n) - 1 AS ix FROM cc),
w0 AS (SELECT i AS query_id, floor({unit(q('7'), 'i', q('column'))} * (SELECT count(*) FROM allc)) AS pick, floor({unit(q('7'), 'i', q('length'))} * 5) + 6 AS len, {unit(q('7'), 'i', q('from'))} AS u FROM (SELECT unnest(range(1, (SELECT count(*) FROM documents) + 1)) AS i)),
w1 AS (SELECT query_id, doc_id, n, len, floor(u * greatest(lines - len, 0)) AS f FROM w0 JOIN allc ON ix = pick),
samples AS (SELECT query_id, line_no, text, w1.doc_id, min(start) OVER (PARTITION BY query_id) AS true_start, max(stop) OVER (PARTITION BY query_id) AS true_end FROM w1 JOIN cut ON cut.doc_id = w1.doc_id AND cut.n = w1.n AND line_no > f AND line_no <= f + len)"""


@R.query("sample_windows", S.ctes(S.DOC_TOKS, CUT, SAMPLE) + "SELECT query_id, line_no, text, doc_id, true_start, true_end FROM samples")
def _(spark, d):
    n = T.raw(spark, d, "documents").count()
    return evaluate.sample_windows(cut_corpus(spark, d), n, SEED)


K = ("'7'", "query_id", "line_no")
LETTER = f"substr('abcdefghijklmnopqrstuvwxyz', 1 + floor({unit(*K, 'wi', 'ci - 1', q('letter'))} * 26)::INT, 1)"
NOISY = f"""array_to_string(list_transform(range(1, len(w) + 1), lambda ci: CASE WHEN {unit(*K, 'wi', 'ci - 1', q('error'))} >= 0.2 THEN substr(w, ci, 1) WHEN {unit(*K, 'wi', 'ci - 1', q('kind'))} < 0.5 THEN {LETTER}
  WHEN {unit(*K, 'wi', 'ci - 1', q('kind'))} < 0.75 THEN '' WHEN {unit(*K, 'wi', 'ci - 1', q('kind'))} < 0.9 THEN '?' ELSE substr(w, ci, 1) || {LETTER} END), '')"""
PERTURB = f"""pl0 AS (SELECT query_id, line_no, ws, unnest(range(len(ws))) AS wi FROM (SELECT query_id, line_no, string_split(text, ' ') AS ws FROM query_lines WHERE {unit(*K, q('line'))} >= 0.05)),
pl1 AS (SELECT query_id, line_no, wi, ws[wi + 1] AS w FROM pl0),
pl2 AS (SELECT query_id, line_no, wi, {NOISY} AS w, {unit(*K, 'wi', q('drop'))} < 0.05 AS dr, {unit(*K, 'wi', q('merge'))} < 0.03 AS mg, {unit(*K, 'wi', q('split'))} < 0.03 AS sl, {unit(*K, 'wi', q('cut'))} AS ct FROM pl1),
pl3 AS (SELECT query_id, line_no, list({{o: [w], g: false, d: dr, m: mg, s: sl, c: ct}} ORDER BY wi) AS l FROM pl2 GROUP BY ALL),
pl4 AS (SELECT query_id, line_no, list_reduce(l, lambda a, x: CASE WHEN a.g THEN {{o: list_append(a.o[1:-2], a.o[-1] || x.o[1]), g: false, d: false, m: false, s: false, c: 0::DOUBLE}} WHEN x.d THEN {{o: a.o, g: false, d: false, m: false, s: false, c: 0::DOUBLE}}
  ELSE {{o: list_concat(a.o, CASE WHEN NOT x.m AND x.s AND len(x.o[1]) >= 4 THEN [substr(x.o[1], 1, 1 + floor(x.c * (len(x.o[1]) - 2))::INT), substr(x.o[1], 2 + floor(x.c * (len(x.o[1]) - 2))::INT)] ELSE x.o END), g: x.m, d: false, m: false, s: false, c: 0::DOUBLE}} END,
  {{o: []::VARCHAR[], g: false, d: false, m: false, s: false, c: 0::DOUBLE}}).o AS o FROM pl3)"""


@R.query("perturb_text", S.ctes(S.QUERY_LINES, PERTURB) + "SELECT query_id, line_no, array_to_string(list_filter(o, lambda x: x <> ''), ' ') AS text FROM pl4")
def _(spark, d):
    return evaluate.perturb_text(T.query_lines(spark, d), SEED).select("query_id", "line_no", "text")


@R.query("robustness_sweep")
def _(spark, d):
    """One window per ten documents at two letter error rates, located in all documents."""
    docs = T.documents(spark, d)
    n = max(1, docs.count() // 10)
    w = evaluate.sample_windows(cut_corpus(spark, d), n, SEED)
    return evaluate.robustness_sweep(w, T.corpus_index(spark, d), [0.1, 0.2], SEED)


@R.query(
    "span_hit",
    "SELECT l_orderkey, l_partkey, least(l_partkey + 50, l_suppkey + l_quantity::INT) - greatest(l_partkey, l_suppkey) + 1 >= (least(50, l_quantity::INT) + 1) * 0.5 AS hit FROM (SELECT l_orderkey, l_partkey % 100 AS l_partkey, l_suppkey, l_quantity FROM lineitem) WHERE l_quantity IS NOT NULL",
)
def _(spark, d):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    li = T.raw(spark, d, "lineitem").withColumn("l_partkey", F.col("l_partkey") % 100)
    return li.select("l_orderkey", "l_partkey", evaluate.span_hit(a, a + 50, b, b + F.col("l_quantity").cast("int")).alias("hit"))


RESULTS = """res AS (SELECT o_orderpriority AS set, 'scan' || (o_orderkey % 300) || '.jpg' AS file, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'confident' WHEN 'O' THEN 'ambiguous' ELSE 'insufficient' END AS status, o_custkey AS ps, o_custkey + 60 AS pe, o_orderkey % 300 AS k FROM orders),
seg AS (SELECT p AS set, f, t, off FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT 1 + r_regionkey * 50 AS f, 40 + r_regionkey * 50 AS t, r_regionkey % 3 AS off FROM region))"""


def _results(spark, d):
    o = T.raw(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "confident").when(F.col("o_orderstatus") == "O", "ambiguous").otherwise("insufficient")
    return o.select(
        F.col("o_orderpriority").alias("set"),
        F.concat(F.lit("scan"), F.col("o_orderkey") % 300, F.lit(".jpg")).alias("file"),
        F.col("o_orderkey").alias("ord"),
        status.alias("status"),
        F.col("o_custkey").alias("pred_start"),
        (F.col("o_custkey") + 60).alias("pred_end"),
    )


def _segments(spark, d):
    """The same five segments for every set of results."""
    r = T.raw(spark, d, "region").select(F.col("r_regionkey").alias("r"))
    cut = F.struct((F.col("r") * 50 + 1).alias("from"), (F.col("r") * 50 + 40).alias("to"), (F.col("r") % 3).alias("offset"))
    cuts = r.agg(F.collect_list(cut).alias("c"))
    sets = T.raw(spark, d, "orders").select(F.col("o_orderpriority").alias("set"), F.lit(1).alias("one")).distinct()
    j = sets.join(cuts.withColumn("one", F.lit(1)), "one")
    return j.select("set", F.explode("c").alias("x")).select("set", "x.*")


def _columns(spark, d):
    """Column n spans 30 words; as many as there are orders in a day's file numbers."""
    n = T.raw(spark, d, "orders").select((F.col("o_orderkey") % 300).alias("n")).distinct()
    return n.select("n", (F.col("n") * 5).alias("start"), (F.col("n") * 5 + 29).alias("end"))


@R.query(
    "score_against_truth",
    f"""WITH {RESULTS}, x AS (SELECT res.*, CASE WHEN k - off BETWEEN 1 AND 245 THEN k - off END AS ec FROM res LEFT JOIN seg ON seg.set = res.set AND k BETWEEN f AND t)
    SELECT set, ord, ec AS expected_col, ec * 5 AS true_start, least(pe, ec * 5 + 29) - greatest(ps, ec * 5) + 1 >= 30 * 0.5 AS hit FROM x""",
)
def _(spark, d):
    r = evaluate.score_against_truth(_results(spark, d), _segments(spark, d), _columns(spark, d))
    return r.select("set", "ord", "expected_col", "true_start", "hit")


@R.query(
    "tally_by_set",
    f"""WITH {RESULTS}, x AS (SELECT res.*, CASE WHEN k - off BETWEEN 1 AND 245 THEN k - off END AS ec FROM res LEFT JOIN seg ON seg.set = res.set AND k BETWEEN f AND t),
    h AS (SELECT set, status, coalesce(least(pe, ec * 5 + 29) - greatest(ps, ec * 5) + 1 >= 15, false) AS hit FROM x)
    SELECT set, count(*) AS windows, count(*) FILTER (hit) AS top1, count(*) FILTER (hit AND status = 'confident') AS confident_right, count(*) FILTER (NOT hit AND status = 'confident') AS confident_wrong, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'insufficient') AS insufficient FROM h GROUP BY set""",
)
def _(spark, d):
    r = evaluate.score_against_truth(_results(spark, d), _segments(spark, d), _columns(spark, d))
    return evaluate.tally(r, "set")


READS = f"""cv AS (SELECT conv_id * 1000 + turn AS query_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM conversations),
cl AS (SELECT query_id, i AS line_no, {S.norm(f"translate(lower(array_to_string(w[i * 8 + 1 : i * 8 + 8], ' ')), '{PLAIN_FROM}', '{PLAIN_TO}')")} AS text FROM (SELECT query_id, w, unnest(range((len(w) + 7) // 8)) AS i FROM cv)),
rd AS (SELECT query_id, line_no, replace(replace(text, 'th', 't'), 'ou', 'oo') AS text FROM cl)"""


def _truth_lines(spark, d):
    c = T.cut_lines(T.conversation_texts(spark, d), "query_id")
    return c.withColumn("text", normalize_text(F.translate(F.lower("text"), PLAIN_FROM, PLAIN_TO)))


def _reads(spark, d):
    r = F.replace(F.replace(F.col("text"), F.lit("th"), F.lit("t")), F.lit("ou"), F.lit("oo"))
    return _truth_lines(spark, d).withColumn("text", r)


RATES = """rl AS (SELECT query_id, list(text ORDER BY line_no) AS r FROM rd WHERE text <> '' GROUP BY ALL), tl AS (SELECT query_id, list(text ORDER BY line_no) AS t FROM cl WHERE text <> '' GROUP BY ALL),
j AS (SELECT query_id, array_to_string(r[:least(len(r), len(t))], ' ') AS r, array_to_string(t[:least(len(r), len(t))], ' ') AS t FROM rl JOIN tl USING (query_id)),
er AS (SELECT query_id, levenshtein(replace(r, ' ', ''), replace(t, ' ', '')) AS edits, len(replace(t, ' ', '')) AS letters, round(len(list_filter(string_split(r, ' '), lambda w: list_contains(string_split(t, ' '), w))) / greatest(1, len(string_split(r, ' '))), 6) AS exact_words FROM j)"""


def _rates(spark, d):
    return evaluate.letter_error_rate(_reads(spark, d), _truth_lines(spark, d), "query_id")


@R.query("letter_error_rate", S.ctes(READS, RATES) + "SELECT query_id, edits, letters FROM er UNION ALL SELECT -1, sum(edits), sum(letters) FROM er")
def _(spark, d):
    r = _rates(spark, d)
    total = evaluate.overall_error_rate(r).select(F.lit(-1).cast("bigint").alias("query_id"), "edits", "letters")
    return r.select("query_id", F.col("edits").cast("bigint").alias("edits"), F.col("letters").cast("bigint").alias("letters")).unionByName(total)


@R.query("exact_word_ratio", S.ctes(READS, RATES) + "SELECT query_id, exact_words FROM er")
def _(spark, d):
    return _rates(spark, d).select("query_id", F.round("exact_words", 6).alias("exact_words"))


@R.query(
    "order_consistency",
    f"""WITH {RESULTS}, c AS (SELECT set, ord, ps, lag(ps) OVER (PARTITION BY set ORDER BY ord) AS prev FROM res WHERE status = 'confident')
    SELECT res.set, res.ord, status, c.ps - prev AS jump, coalesce(c.ps < prev, false) AS backwards FROM res LEFT JOIN c USING (set, ord)""",
)
def _(spark, d):
    r = evaluate.order_consistency(_results(spark, d).withColumnRenamed("pred_start", "start"))
    return r.select("set", "ord", "status", "jump", "backwards")


@R.query(
    "best_line_offset",
    S.ctes(READS)
    + """, rs AS (SELECT query_id, line_no + 2 AS k, text FROM rd), gs AS (SELECT DISTINCT query_id, k - line + dd AS off FROM (SELECT query_id, line_no + 2 AS k, line_no + (query_id % 3)::INT - 1 AS line FROM cl), (SELECT unnest([-1, 0, 1]) AS dd)),
    g AS (SELECT rs.query_id, off, count(*) AS lines, string_agg(rs.text, ' ' ORDER BY k) AS got, string_agg(cl.text, ' ' ORDER BY k) AS want FROM rs JOIN gs USING (query_id) JOIN cl ON cl.query_id = rs.query_id AND cl.line_no = k - off WHERE cl.text <> '' GROUP BY ALL HAVING count(*) >= 3),
    e AS (SELECT *, levenshtein(got, want) AS edits, row_number() OVER (PARTITION BY query_id ORDER BY levenshtein(got, want) / len(want), off) AS r FROM g)
    SELECT query_id, off AS "offset", edits, len(want) AS length, lines FROM e WHERE r = 1""",
)
def _(spark, d):
    """Readings with two lines above their first one."""
    t = _truth_lines(spark, d)
    reads = _reads(spark, d).select("query_id", (F.col("line_no") + 2).alias("k"), "text")
    guess = t.select("query_id", (F.col("line_no") + 2).alias("k"), (F.col("line_no") + F.col("query_id") % 3 - 1).cast("int").alias("line"))
    return evaluate.best_line_offset(reads, guess, t.withColumnRenamed("line_no", "line"))


VOC = f"""v0 AS (SELECT DISTINCT word FROM words WHERE len(word) BETWEEN 3 AND 6),
voc AS (SELECT word AS form, {draw(q('7'), 'word', q('bucket'))} % 256 AS bucket, row_number() OVER (PARTITION BY {draw(q('7'), 'word', q('bucket'))} % 256 ORDER BY word) - 1 AS slot FROM v0),
vs AS (SELECT bucket, count(*) AS size FROM voc GROUP BY ALL),
qw0 AS (SELECT query_id, line_no, unnest(range(len(t))) AS i, t FROM (SELECT query_id, line_no, {S.toks('text')} AS t FROM query_lines)),
qwords AS (SELECT query_id, line_no, i, t[i + 1] AS word FROM qw0)"""
DRAWN = f"""SELECT x.*, voc.form AS drawn FROM (SELECT x.*, vs.bucket, {draw("'7'", 'query_id', 'line_no', 'i', q('slot'))} % size AS slot FROM {{src}} x JOIN vs ON vs.bucket = {draw("'7'", 'query_id', 'line_no', 'i', q('bucket'))} % 256) x JOIN voc USING (bucket, slot)"""


def _vocab(spark, d):
    v = T.corpus_index(spark, d).vocab.select("word").where(F.length("word").between(3, 6))
    return evaluate.indexed_vocabulary(v, SEED)


def _line_words(spark, d):
    return T.query_lines(spark, d).select("query_id", "line_no", F.posexplode(tokenize("text")).alias("i", "word"))


@R.query(
    "read_or_recite",
    S.ctes(S.CORPUS, S.QUERY_LINES, VOC, f"dr AS ({DRAWN.format(src='qwords')})")
    + f""", c AS (SELECT *, {draw("'7'", 'query_id', 'line_no', 'i', q('order'))} AS o FROM dr WHERE len(word) >= 3 AND drawn <> word),
    one AS (SELECT *, row_number() OVER (PARTITION BY query_id, line_no ORDER BY o, i) AS r FROM c QUALIFY r = 1), few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, line_no) AS r2 FROM one QUALIFY r2 <= 6),
    rd AS (SELECT query_id, line_no, t AS ws FROM (SELECT query_id, line_no, {S.toks('text')} AS t FROM query_lines))
    SELECT query_id, few.line_no, i, word AS "from", drawn AS "to", CASE WHEN few.line_no % 2 = 0 THEN CASE WHEN list_contains(ws, drawn) THEN 'printed' ELSE 'restored' END WHEN i > 3 THEN 'printed' ELSE 'other' END AS outcome FROM few JOIN rd USING (query_id, line_no)""",
)
def _(spark, d):
    w = _line_words(spark, d)
    s = evaluate.swap_words(w, _vocab(spark, d), 6, SEED)
    old = w.groupBy("query_id", "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("old"))
    seen = F.when(F.col("line_no") % 2 == 0, F.col("old")).when(F.col("i") > 3, F.col("to")).otherwise(F.lit(""))
    reads = s.join(old, ["query_id", "line_no"]).select("query_id", "line_no", seen.alias("text"))
    return evaluate.read_or_recite(s, reads)


@R.query(
    "shuffled_control",
    S.ctes(S.CORPUS, S.QUERY_LINES, VOC, f"dr AS ({DRAWN.format(src='qwords')})")
    + f"SELECT query_id, line_no, i, CASE WHEN {unit(q('7'), 'query_id', q('control'))} < 0.3 THEN drawn ELSE word END AS word, {unit(q('7'), 'query_id', q('control'))} < 0.3 AS shuffled FROM dr",
)
def _(spark, d):
    return evaluate.shuffled_control(_line_words(spark, d), _vocab(spark, d), 0.3, SEED)


@R.query(
    "threshold_sweep",
    L.LOCATED
    + """, t AS (SELECT unnest([0.1, 0.25, 0.4]) AS threshold), x AS (SELECT threshold, CASE WHEN status = 'insufficient' THEN 'insufficient' WHEN second IS NOT NULL AND margin < threshold THEN 'ambiguous' ELSE 'confident' END AS status FROM decided, t)
    SELECT threshold::DOUBLE AS threshold, status, count(*) AS n FROM x GROUP BY ALL""",
)
def _(spark, d):
    loc = L.located(spark, d)
    r = loc.results.join(loc.deduped.select("query_id", (F.size("candidates") > 1).alias("rivals")), "query_id", "left")
    r = r.select("margin", (F.col("status") != "insufficient").alias("strong"), F.coalesce("rivals", F.lit(False)).alias("rivals"))
    return evaluate.threshold_sweep(r, [0.1, 0.25, 0.4])


@R.query(
    "incremental_by_content",
    f"""WITH st AS (SELECT DISTINCT sha256(text || 'v1') AS key FROM documents WHERE lang = 'en') SELECT doc_id, len({S.toks('text')}) AS tokens, sha256(text || 'v1') IN (SELECT key FROM st) AS cached FROM documents""",
)
def _(spark, d):
    docs = T.raw(spark, d, "documents")
    compute = lambda df: df.withColumn("tokens", F.size(tokenize("text")))
    from ..functions.text import content_key

    stored = compute(docs.where("lang = 'en'")).select(content_key("text", "v1").alias("key"), "tokens").dropDuplicates(["key"])
    return evaluate.incremental(docs.select("doc_id", "text"), stored, "text", "v1", compute, ["tokens"]).select("doc_id", "tokens", "cached")


@R.query(
    "nearest_label",
    """WITH e AS (SELECT event_id AS id, user_id AS page, value * 10 AS y, CAST(json_extract(props, '$.k') AS INT) AS k, event_type AS et FROM events),
    dt AS (SELECT page, id AS li, y, k AS x0, k + 500 + id % 61 AS x1, k > 90 AS cut FROM e WHERE et IN ('view', 'click')),
    tr AS (SELECT page, id AS ti, y, k AS x0, k + 530 AS x1, CASE WHEN k < 5 THEN '' ELSE 'line ' || id END AS text FROM e WHERE et IN ('purchase', 'signup')),
    nr AS (SELECT dt.page, li, dt.x0, dt.x1, tr.ti, tr.x0 AS t0, tr.x1 AS t1, text, row_number() OVER (PARTITION BY dt.page, li ORDER BY abs(dt.y - tr.y), ti) AS r FROM dt JOIN tr ON tr.page = dt.page AND tr.y >= dt.y - 50::DOUBLE * 0.3::DOUBLE AND tr.y <= dt.y + 50::DOUBLE * 0.3::DOUBLE WHERE NOT cut),
    ok AS (SELECT *, NOT (x1 < t1 - 0.08 * (t1 - t0) OR x0 < t0 - 0.1 * (t1 - t0) OR x1 > t1 + 0.1 * (t1 - t0)) AS fits FROM nr WHERE r = 1 AND text <> ''),
    st AS (SELECT *, min(li) FILTER (fits) OVER (PARTITION BY page, ti) AS first FROM ok)
    SELECT page, li, CASE WHEN cut THEN 'cut' WHEN st.ti IS NULL THEN 'unmatched' WHEN first = li THEN 'kept' WHEN first < li THEN 'unmatched' ELSE 'bad-extent' END AS status, CASE WHEN first = li THEN text END AS label FROM dt LEFT JOIN st USING (page, li)""",
)
def _(spark, d):
    e = T.raw(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    y = (F.col("value") * 10).alias("y")
    page = F.col("user_id").alias("page")
    det = e.where(F.col("event_type").isin("view", "click")).select(
        page, F.col("event_id").alias("li"), y, F.col("k").alias("x0"), (F.col("k") + 500 + F.col("event_id") % 61).alias("x1"), F.lit(50.0).alias("pitch"), (F.col("k") > 90).alias("cut")
    )
    text = F.when(F.col("k") < 5, "").otherwise(F.concat(F.lit("line "), "event_id"))
    tru = e.where(F.col("event_type").isin("purchase", "signup")).select(
        page, F.col("event_id").alias("ti"), y, F.col("k").alias("x0"), (F.col("k") + 530).alias("x1"), text.alias("text")
    )
    return evaluate.nearest_label(det, tru).select("page", "li", "status", "label")
