"""Finding a reading in the corpus: vote for origins, cut windows, align, decide."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.profile import LATIN, Profile
from ..functions.text import tokenize
from ..session import checkpoint, spread
from . import align, bins
from .index import BLOCK, fuzzy_candidates
from .store import CorpusIndex


@dataclass(frozen=True)
class LocateConfig:
    # Matching and confidence settings.
    bin_width: int = 4
    max_bins: int = 6
    nms_distance: int = 2
    # A form that holds more than this share of all words votes only where it was read exactly.
    fuzzy_positions: int = 1500
    fuzzy_corpus: int = 80_316
    window_pad: int = 10
    min_pair_similarity: float = 0.6
    fuzzy_weight: float = 0.8
    neighbor_weight: float = 0.5
    min_tokens: int = 4
    min_aligned: int = 8
    min_lines: int = 2
    min_coverage: float = 0.35
    min_margin: float = 0.25
    min_score: float = 8.0
    near_margin: float = 1.5
    max_alternatives: int = 3
    profile: Profile = field(default=LATIN)

    @property
    def bins_to_rank(self) -> int:
        """Enough ranked bins for suppression to be exact: each chosen bin suppresses 2 * distance others."""
        return (self.max_bins - 1) * 2 * self.nms_distance + self.max_bins


VOTE_UNIT = 1_000_000
"""Votes are summed as whole millionths, so the order of summation cannot change a score."""


def text_lines(texts: DataFrame, key: str) -> DataFrame:
    """Typed text to query lines: split on newlines, trimmed, blanks dropped."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return texts.select(F.col(key).alias("query_id"), F.posexplode(lines).alias("line_no", "text"))


def query_tokens(query_lines: DataFrame, p: Profile = LATIN) -> DataFrame:
    """query_id, k, line_no, token. A query is at most a few hundred tokens, so one row holds it while it is numbered."""
    return numbered_tokens(query_arrays(query_lines, p))


def numbered_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.posexplode(F.arrays_zip("tokens", "token_lines")).alias("k", "t")).select("query_id", "k", F.col("t.token_lines").alias("line_no"), F.col("t.tokens").alias("token"))


def query_arrays(query_lines: DataFrame, p: Profile = LATIN) -> DataFrame:
    """query_id, n_lines, tokens, token_lines, line_tokens (count per line): one row per reading.

    A reading is bounded by its validation (80 lines of 300 characters), which bounds the gathered list.
    """
    lines = query_lines.select("query_id", "line_no", tokenize("text", p).alias("toks"))
    q = lines.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "toks"))).alias("ls"))
    # Lines are counted from 0 in reading order, whatever their numbers (a noisy reading may miss some).
    nested = F.transform("ls", lambda x, i: F.transform(x["toks"], lambda _: i))
    return q.select(
        "query_id",
        F.size("ls").alias("n_lines"),
        F.flatten(F.col("ls.toks")).alias("tokens"),
        F.flatten(nested).alias("token_lines"),
        F.transform("ls", lambda x: F.size(x["toks"])).alias("line_tokens"),
    )


def candidate_weights(tokens: DataFrame, candidates: DataFrame, cfg: LocateConfig) -> DataFrame:
    """query_id, k, word, votes: what each occurrence of a form adds to the origin it implies."""
    quality = F.when(F.col("similarity") == 1, 1.0).otherwise(F.col("similarity") * cfg.fuzzy_weight)
    usable = (F.col("similarity") == 1) | (F.col("n") * cfg.fuzzy_corpus <= F.col("total") * cfg.fuzzy_positions)
    return (
        tokens.join(candidates.where(usable), "token")
        .select("query_id", "k", F.col("form").alias("word"), (F.col("idf") * quality).alias("w"))
        .where(F.col("w") > 0)
        .select("query_id", "k", "word", F.round(F.col("w") * VOTE_UNIT).cast("bigint").alias("votes"))
    )


def _scored(found: DataFrame, cfg: LocateConfig) -> DataFrame:
    score = F.col("halves") * F.lit(cfg.neighbor_weight) / F.lit(float(VOTE_UNIT))
    return found.select("query_id", "doc_id", "bin", score.alias("score"))


def vote_origins(weights: DataFrame, corpus: CorpusIndex, cfg: LocateConfig) -> DataFrame:
    """query_id, doc_id, bin, score: votes per origin bin, a half of them to each neighbor."""
    return _scored(bins.all_bins(corpus, weights, cfg.bin_width), cfg)


def vote_totals(weights: DataFrame, corpus: CorpusIndex, cfg: LocateConfig) -> DataFrame:
    """query_id, doc_id, bins, halves, best: the number of origin bins of a document, and the sum and the greatest of their votes in
    half millionths."""
    return bins.totals(corpus, weights, cfg.bin_width)


def leading_bins(weights: DataFrame, corpus: CorpusIndex, cfg: LocateConfig) -> DataFrame:
    """query_id, doc_id, bin, score of the bins that can be among a query's best `bins_to_rank`."""
    return _scored(bins.leading_bins(corpus, weights, cfg.bin_width, cfg.bins_to_rank), cfg)


def top_bins(bins: DataFrame, cfg: LocateConfig) -> DataFrame:
    """query_id, rank, doc_id, bin, score: strongest bins, none within `nms_distance` of a stronger one."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "bin")
    ranked = bins.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cfg.bins_to_rank)
    rows = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("r", "doc_id", "bin", "score"))).alias("b"))
    empty = F.filter(F.col("b"), lambda x: F.lit(False))

    def keep(acc, x):
        clash = F.exists(
            acc, lambda c: (c["doc_id"] == x["doc_id"]) & (F.abs(c["bin"] - x["bin"]) <= cfg.nms_distance)
        )
        return F.when(clash | (F.size(acc) >= cfg.max_bins), acc).otherwise(F.concat(acc, F.array(x)))

    chosen = F.aggregate(F.col("b"), empty, keep)
    return rows.select("query_id", F.posexplode(chosen).alias("rank", "c")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "c.doc_id", "c.bin", "c.score"
    )


def window_spans(bins: DataFrame, queries: DataFrame, cfg: LocateConfig) -> DataFrame:
    """query_id, rank, doc_id, start, stop: positions to align, before clipping to the document."""
    origin = F.col("bin") * cfg.bin_width
    return bins.join(queries.select("query_id", F.size("tokens").alias("m")), "query_id").select(
        "query_id",
        "rank",
        "doc_id",
        F.greatest(F.lit(0), origin - cfg.window_pad).cast("int").alias("start"),
        (origin + F.col("m") + cfg.bin_width + cfg.window_pad).cast("int").alias("stop"),
    )


def window_words(spans: DataFrame, corpus: DataFrame, size: int = BLOCK) -> DataFrame:
    """query_id, rank, doc_id, start, stop, words: the window's text, from the few blocks it touches."""
    first, last = (F.floor(F.col(c) / size).cast("int") for c in ("start", "stop"))
    s = spans.withColumn("block", F.explode(F.sequence(first, last)))
    j = s.join(corpus, ["doc_id", "block"])
    g = j.groupBy("query_id", "rank", "doc_id", "start", "stop").agg(
        F.sort_array(F.collect_list(F.struct("block", "words"))).alias("b"),
        F.max("doc_words").alias("doc_words"),
    )
    stop = F.least(F.col("stop"), F.col("doc_words") - 1)
    at = F.col("start") - F.element_at("b", 1)["block"] * size + 1
    g = g.withColumn("stop", stop).where(F.col("stop") >= F.col("start"))
    return g.select(
        "query_id",
        "rank",
        "doc_id",
        "start",
        "stop",
        F.slice(F.flatten("b.words"), at, F.col("stop") - F.col("start") + 1).alias("words"),
    )


def local_align(windows: DataFrame, queries: DataFrame, cfg: LocateConfig) -> DataFrame:
    """query_id, rank, doc_id and the best aligned span of each window; windows without a pair are dropped."""
    min_sim, pairs = cfg.min_pair_similarity, cfg.profile.confusable

    @F.pandas_udf(align.ALIGNMENT)
    def run(t: pd.Series, l: pd.Series, n: pd.Series, w: pd.Series, s: pd.Series) -> pd.DataFrame:  # noqa: E741
        return align.alignment_rows(t, l, n, w, s, min_sim, pairs)

    j = spread(windows.join(queries, "query_id").where(F.size("tokens") > 0), "query_id", "rank")
    a = j.select("query_id", "rank", "doc_id", run("tokens", "token_lines", "n_lines", "words", "start").alias("a"))
    return a.select("query_id", "rank", "doc_id", "a.*").where(F.col("first_word").isNotNull())


def align_pairs(windows: DataFrame, queries: DataFrame, cfg: LocateConfig) -> DataFrame:
    """One row per token of each alignment: query_id, rank, doc_id, k, line_no, read, word, pos."""
    min_sim, pairs = cfg.min_pair_similarity, cfg.profile.confusable

    @F.pandas_udf(align.PAIRS)
    def run(t: pd.Series, l: pd.Series, w: pd.Series, s: pd.Series) -> pd.Series:  # noqa: E741
        return align.pair_rows(t, l, w, s, min_sim, pairs)

    j = spread(windows.join(queries, "query_id").where(F.size("tokens") > 0), "query_id", "rank")
    a = j.select("query_id", "rank", "doc_id", F.explode(run("tokens", "token_lines", "words", "start")).alias("p"))
    return a.select("query_id", "rank", "doc_id", "p.*")


def dedupe_overlaps(alignments: DataFrame) -> DataFrame:
    """query_id, candidates: alignments by score, without those covering a better one by over half. At most max_bins each."""
    fields = ["rank", "doc_id", "first_word", "last_word", "score", "aligned", "lines_covered", "coverage", "line_starts"]
    rows = alignments.groupBy("query_id").agg(
        F.collect_list(F.struct((-F.round("score", 6)).alias("neg"), *fields)).alias("a")
    )
    by_score = F.transform(F.sort_array("a"), lambda x: F.struct(*[x[f].alias(f) for f in fields]))

    def keep(acc, x):
        def same(c):
            overlap = F.least(c["last_word"], x["last_word"]) - F.greatest(c["first_word"], x["first_word"]) + 1
            shorter = F.least(c["last_word"] - c["first_word"], x["last_word"] - x["first_word"]) + 1
            return (c["doc_id"] == x["doc_id"]) & (overlap > shorter * 0.5)

        return F.when(F.exists(acc, same), acc).otherwise(F.concat(acc, F.array(x)))

    sorted_rows = rows.select("query_id", by_score.alias("a"))
    none = F.filter(F.col("a"), lambda x: F.lit(False))
    return sorted_rows.select("query_id", F.aggregate("a", none, keep).alias("candidates"))


def decide(queries: DataFrame, deduped: DataFrame, cfg: LocateConfig) -> DataFrame:
    """One row per reading: status, margin, best, alternatives, reasons and suggestions."""
    q = queries.select("query_id", F.size("tokens").alias("tokens")).join(deduped, "query_id", "left")
    c = F.col("candidates")
    best, second = F.try_element_at(c, F.lit(1)), F.try_element_at(c, F.lit(2))
    q = q.withColumn("top", F.when(F.col("tokens") >= cfg.min_tokens, best))
    q = q.withColumn(
        "margin",
        F.when(F.col("top").isNotNull(), F.coalesce((F.col("top.score") - second["score"]) / F.col("top.score"), F.lit(1.0))),
    )
    few = F.col("tokens") < cfg.min_tokens
    none = ~few & F.col("top").isNull()
    rules = {
        "few-aligned": F.col("top.aligned") < cfg.min_aligned,
        "single-line": F.col("top.lines_covered") < cfg.min_lines,
        "low-coverage": F.col("top.coverage") < cfg.min_coverage,
    }
    weak = rules["few-aligned"] | rules["single-line"] | rules["low-coverage"] | (F.col("top.score") < cfg.min_score)
    close = (F.col("margin") < cfg.min_margin) & second.isNotNull()
    q = q.withColumn(
        "status",
        F.when(few | none | weak, "insufficient").when(close, "ambiguous").otherwise("confident"),
    )
    codes = [
        F.when(few, "few-words"),
        F.when(none, "no-match"),
        *[F.when(~few & r, code) for code, r in rules.items()],
        F.when(F.col("status") == "ambiguous", "similar-passages"),
    ]
    advice = (
        F.when(few, F.array(F.lit("move-closer")))
        .when(none, F.array(F.lit("check-photo")))
        .when(weak, F.array(F.lit("more-light"), F.lit("include-gap")))
        .when(F.col("status") == "ambiguous", F.array(F.lit("show-column-start")))
        .otherwise(F.array().cast("array<string>"))
    )
    gap = lambda x: (F.col("top.score") - x["score"]) / F.col("top.score")
    alternatives = (
        F.when(
            F.col("status") == "ambiguous",
            F.slice(F.filter(c, lambda x: gap(x) < cfg.min_margin * cfg.near_margin), 1, cfg.max_alternatives),
        )
        .when(~few & weak, F.slice(c, 1, 1))
        .otherwise(F.slice(c, 1, 0))
    )
    return q.select(
        "query_id",
        "status",
        "tokens",
        "margin",
        F.when(F.col("status") == "confident", F.col("top")).alias("best"),
        alternatives.alias("alternatives"),
        F.filter(F.array(*codes), lambda x: x.isNotNull()).alias("reasons"),
        advice.alias("suggestions"),
        F.col("top").alias("top_candidate"),
    )


@dataclass
class Located:
    """The stages of one locate job; those that several others read are checkpointed."""

    queries: DataFrame
    tokens: DataFrame
    candidates: DataFrame
    bins: DataFrame
    top: DataFrame
    windows: DataFrame
    alignments: DataFrame
    deduped: DataFrame
    results: DataFrame


def locate(query_lines: DataFrame, corpus: CorpusIndex, cfg: LocateConfig = LocateConfig()) -> Located:
    """Where each reading (query_id, line_no, text) lies in the documents of a stored index."""
    p = corpus.profile
    # Used by several stages and small next to the corpus: computed once.
    queries = checkpoint(query_arrays(query_lines, p))
    tokens = checkpoint(numbered_tokens(queries))
    candidates = checkpoint(fuzzy_candidates(tokens, corpus.vocab, None, p))
    weights = checkpoint(candidate_weights(tokens, candidates, cfg))
    leading = leading_bins(weights, corpus, cfg)
    top = checkpoint(top_bins(leading, cfg))
    windows = window_words(window_spans(top, queries, cfg), corpus.blocks(top))
    alignments = local_align(windows, queries, cfg)
    deduped = dedupe_overlaps(alignments)
    return Located(
        queries, tokens, candidates, leading, top, windows, alignments, deduped, decide(queries, deduped, cfg)
    )
