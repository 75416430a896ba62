"""The registered queries of the operators: each runs over its whole table and adds the digests asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, divergence, html_text, language, line_templates, near_dedup, periodic_runs, quality, segmentations, substrings, top_k, url_rules, vector_tree
from lectern.llm.common import held_out, read
from lectern.plans.registry import Registry

registry = Registry()

URL_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT DISTINCT host, path, first_value(h || p) OVER w AS rule, first_value(verdict) OVER w AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = h OR right(host, length(h) + 1) = '.' || h) AND left(path, length(p)) = p
  WINDOW w AS (PARTITION BY host, path ORDER BY length(h || p) DESC, h || p))
SELECT page_id, parts.host, parts.path, rule,
  coalesce(verdict, CASE WHEN regexp_matches(parts.host || parts.path, '^([^/]*[.-])?((casino|cheap-pills|online-pills|free-bets|poker|ad-track|ads-track)[.-]|adult-|spam-)')
    OR regexp_matches(parts.host || parts.path, '/(login|signin)(/|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
"""


@registry.query("op4_url_filter", URL_SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(read(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


@registry.query("op2_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    net = language.train(docs.where(~held_out()))
    return language.predict(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
dims AS (SELECT vec_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM v),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM dims a JOIN dims b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@registry.query("op6_exact_top_k", TOP_K_SQL)
def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").where(top_k.usable(F.col("embedding")))
    rows = rows.select("vec_id", top_k.whole_numbers(F.col("embedding")).alias("vector"))
    return top_k.top_k(rows, rows.where("vec_id % 100 = 0"), 10)


@registry.query("op3_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        decontaminate.item_digest().alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@registry.query("op8_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    labels = read(spark, folder, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels.where(~held_out()))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@registry.query("op9_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    found = html_text.extract(pages.select("page_id", "url", "html"), html_text.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


LINES_SQL = """
WITH raw AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS body FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, line, list_transform(list_filter(string_split_regex(body, '[ \\t-\\r]+'), lambda t: t <> ''),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS toks FROM raw),
keyed AS (SELECT doc_id, line, toks, len(toks) AS n, len(toks) || ' ' || array_to_string(toks[1:3], ' ') AS leaf FROM lines WHERE len(toks) >= 1),
leaves AS (SELECT leaf FROM keyed GROUP BY leaf HAVING count(DISTINCT doc_id) >= 3),
cand AS (SELECT keyed.* FROM keyed JOIN leaves USING (leaf)),
kinds AS (SELECT leaf, toks, n, count(DISTINCT doc_id) AS docs FROM cand GROUP BY 1, 2, 3),
mixed AS (SELECT leaf FROM kinds GROUP BY leaf HAVING count(*) > 1 AND min(docs) < 3),
places AS (SELECT leaf, toks, docs, unnest(range(1, n + 1)) AS place, unnest(toks) AS token FROM kinds WHERE leaf IN (SELECT leaf FROM mixed)),
fixed AS (SELECT leaf, place, token FROM places GROUP BY 1, 2, 3 HAVING sum(docs) >= 3 AND token <> '<*>'),
shaped AS (
  SELECT leaf, toks, string_agg(place || '=' || token, ' ' ORDER BY place) AS shape, count(*) AS kept
  FROM places JOIN fixed USING (leaf, place, token) GROUP BY 1, 2
  UNION ALL
  SELECT leaf, toks, array_to_string(toks, ' '), len(list_filter(toks, lambda t: t <> '<*>')) FROM kinds
  WHERE docs >= 3 AND leaf NOT IN (SELECT leaf FROM mixed)),
marked AS (
  SELECT doc_id, line, cand.leaf, shape FROM cand JOIN shaped ON cand.leaf = shaped.leaf AND cand.toks = shaped.toks
  WHERE kept = n OR (n >= 5 AND kept >= 0.75 * n)),
recurring AS (SELECT leaf, shape, min(doc_id) AS d FROM marked GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3),
firsts AS (SELECT leaf, shape, d, min(line) AS l FROM marked JOIN recurring USING (leaf, shape) WHERE doc_id = d GROUP BY 1, 2, 3),
gone AS (SELECT DISTINCT doc_id, line FROM marked JOIN firsts USING (leaf, shape) WHERE NOT (doc_id = d AND line = l)),
rest AS (
  SELECT raw.doc_id, count(*) AS n_lines, count(gone.line) AS n_dropped,
    coalesce(string_agg(body, chr(10) ORDER BY raw.line) FILTER (WHERE gone.line IS NULL), '') AS kept
  FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.line = gone.line GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN rest ON d.doc_id = rest.doc_id
"""


@registry.query("op1_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_templates.drop_recurring(read(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@registry.query("op10_segmentations")
def sampled_segmentations(spark: SparkSession, folder: str) -> DataFrame:
    return segmentations.encode(read(spark, folder, "documents").select("doc_id", "text"))


@registry.query("op5_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.drop_repeats(read(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@registry.query("op7_near_dedup")
def near_dedup_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """`docs` with the last words of every tenth text, by checksum of its id, replaced by repetitions of a few of them."""
    words, h = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.withColumn("_g", F.floor(h / 10)).withColumn("_words", F.when((h % 10 == 0) & (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) > 0), words))
    n = F.size("_words")
    d = d.withColumn("_a", (F.col("_g") % F.greatest(n, F.lit(1))).cast("int"))
    d = d.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), times)), F.lit(1), n - F.col("_a"))
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")
    return d.withColumn("text", F.when(F.col("_words").isNotNull(), text).otherwise(F.col("text"))).drop("_g", "_words", "_a", "_p")


@registry.query("op11_periodic_runs")
def runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find(with_planted_runs(read(spark, folder, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best).withColumn("length", -F.col("best.less"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "length",
        "best.period",
        F.floor(1000 * F.col("length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@registry.query("op12_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return vector_tree.neighbours(rows, rows.where("vec_id % 20 = 0"), 20, vector="embedding")


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
langs AS (
  SELECT lang, CAST(count(term) AS HUGEINT) AS v, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY 1),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (
  SELECT lang, source, v, CAST(coalesce(sum(c), 0) AS HUGEINT) AS total
  FROM (SELECT DISTINCT lang, source FROM d) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY 1, 2, 3),
p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + 1000000000 * (coalesce(c, 0) + 1) // (groups.total + v) AS p,
    1 + 1000000000 * (n + 1) // (langs.total + v) AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang, v) LEFT JOIN counts USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@registry.query("op13_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read(spark, folder, "documents").select("text", "lang", "source"))
