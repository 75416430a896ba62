"""Word index: postings, vocabulary weights and fuzzy lookup as joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.counts import CELLS, filed, gram_codes, matches, spans
from ..functions.distance import may_be_similar, word_similarity
from ..functions.profile import LATIN, Profile
from ..functions.text import tokenize, trigrams, without_marks
from ..session import checkpoint, in_blocks, spread

BLOCK = 64
"""Words per row of the blocked corpus."""


# Fixed value: the letter whose lower case is a letter and a mark.
TWO_PART = "\u0130"


def corpus_words(text: str, p: Profile = LATIN) -> Column:
    """Words of a document. A reading's `?` has no meaning in it, so it separates words."""
    return tokenize(F.replace(F.col(text), F.lit("?"), F.lit(" ")), p)


def corpus_word_count(text: str, p: Profile = LATIN) -> Column:
    """The number of `corpus_words`. Of all letters only one has no letter for each part of its lower case, so a text without it
    is counted as it is written."""
    c = F.col(text)
    c = F.when(c.contains(TWO_PART), F.lower(c)).otherwise(c) if p.lowercase else c
    return F.regexp_count(without_marks(c, p), F.lit(f"[{p.letters}]+"))


def corpus_blocks(documents: DataFrame, p: Profile = LATIN, size: int = BLOCK) -> DataFrame:
    """The corpus as rows of `size` words keyed by (doc_id, block)."""
    d = documents.select("doc_id", corpus_words("text", p).alias("toks"))
    d = d.where(F.size("toks") > 0).withColumn("doc_words", F.size("toks"))
    starts = F.sequence(F.lit(0), F.floor((F.col("doc_words") - 1) / size).cast("int"))
    return d.select("doc_id", "doc_words", "toks", F.explode(starts).alias("block")).select(
        "doc_id", "doc_words", "block", F.slice("toks", F.col("block") * size + 1, F.lit(size)).alias("words")
    )


def vocabulary(words: DataFrame, total: int | None = None) -> DataFrame:
    """word, n, total, idf = ln(total / n). Counts combine before the shuffle, so a hot word costs nothing extra."""
    v = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = v.agg(F.sum("n")).scalar() if total is None else F.lit(total).cast("bigint")
    return v.select("word", "n", total.alias("total"), F.log(total / F.col("n")).alias("idf"))


def idf_of(forms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Weight of each form, ln(total) for one that never occurs."""
    total = vocab.agg(F.sum("n")).scalar()
    j = forms.join(vocab.select("word", "n", "idf"), "word", "left")
    return j.select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("idf", F.log(total)).alias("idf"))


def postings(forms: DataFrame, words: DataFrame) -> DataFrame:
    """Positions of each form; a missing form gives one row without a position."""
    return forms.select("word").distinct().join(words, "word", "left")


def summary(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("forms"))


GRAMS = 1_000_000
"""Token trigrams that are sent to every task."""


def form_grams(vocab: DataFrame) -> DataFrame:
    """form, flen, gram: the trigrams of every form."""
    v = vocab.where(F.length("word") > 0)
    return v.select(F.col("word").alias("form"), F.length("word").alias("flen"), F.explode(trigrams("word")).alias("gram"))


def _sharing(forms: DataFrame, tokens: list[str], max_length_delta: int) -> DataFrame:
    """token, form: forms that share a third of a token's trigrams, counted in batches of forms as they are read."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    codes, of = gram_codes(tokens)
    # A gram with a `?` matches nothing, but counts for the third.
    wild = np.uint64(ord("?"))
    part = np.uint64((1 << 21) - 1)
    plain = (codes >> np.uint64(42) != wild) & (codes >> np.uint64(21) & part != wild) & (codes & part != wild)
    known, number = np.unique(codes[plain], return_inverse=True)
    order, first = filed(number, len(known))
    need = np.maximum(1, np.ceil((sizes - 1) / 3))
    asked = forms.sparkSession.sparkContext.broadcast((tokens, sizes, need, known, of[plain][order], first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, need, known, entry, first = asked.value
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if w]
            if not words or not len(known):
                continue
            codes, of = gram_codes(words)
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            found = known[at] == codes
            at, of = at[found], of[found]
            lengths = np.array([len(w) for w in words], np.int64)
            begin = np.searchsorted(of, np.arange(len(words) + 1))
            a, b = [], []
            for lo, hi in spans(np.full(len(words), len(names)), CELLS):
                grams, own = at[begin[lo] : begin[hi]], of[begin[lo] : begin[hi]] - lo
                by, e = matches(grams, first)
                shared = np.bincount(own[by] * len(names) + entry[e], minlength=(hi - lo) * len(names))
                form, token = np.nonzero(shared.reshape(hi - lo, len(names)) >= need)
                near = np.abs(lengths[lo + form] - sizes[token]) <= max_length_delta
                a.append(token[near])
                b.append(lo + form[near])
            pairs = zip(np.concatenate(a).tolist(), np.concatenate(b).tolist(), strict=True)
            out = [(names[t], words[f]) for t, f in pairs if names[t] != words[f]]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["token", "form"])

    return forms.select("form").mapInArrow(run, "token string, form string")


def fuzzy_matches(
    tokens: DataFrame,
    forms: DataFrame,
    p: Profile = LATIN,
    min_similarity: float = 0.62,
    max_length_delta: int = 2,
) -> DataFrame:
    """(token, form, similarity) for forms sharing a third of the token's trigrams and similar enough.

    `forms` (form; stored trigrams will do) stay where they lie: the tokens come to them in blocks of about `GRAMS` trigrams, and
    shared ones are counted in batches, so that neither the trigrams of forms nor pairs below the third become rows.
    """
    forms = forms.select("form").distinct() if "gram" in forms.columns else forms
    tok = checkpoint(tokens.select("token").distinct().where(F.length("token") >= 3))
    n = tok.agg(F.coalesce(F.sum(F.length("token")), F.lit(0))).first()[0]
    blocks = (sorted(r["token"] for r in part.collect()) for part in in_blocks(tok, "token", n, GRAMS))
    pairs = reduce(DataFrame.union, [_sharing(forms, block, max_length_delta) for block in blocks])
    pairs = checkpoint(pairs.where(may_be_similar("token", "form", 1 - min_similarity, p)))
    sim = word_similarity("token", "form", 1 - min_similarity, p)
    return (
        spread(pairs)
        .select("token", "form", sim.alias("similarity"))
        .where(F.col("similarity") >= min_similarity)
        .withColumn("similarity", F.round("similarity", 6))
    )


def fuzzy_candidates(
    tokens: DataFrame, vocab: DataFrame, grams: DataFrame | None = None, p: Profile = LATIN, max_candidates: int = 24, min_similarity: float = 0.62
) -> DataFrame:
    """token, form, similarity, n, total, idf: the exact form, then the best fuzzy ones, of `vocab` or of the forms in `grams`."""
    of_form = ["n", "total", "idf"]
    exact = (
        tokens.select("token")
        .distinct()
        .where(~F.col("token").contains("?"))
        .join(vocab, F.col("token") == F.col("word"))
        .select("token", F.col("word").alias("form"), F.lit(1.0).alias("similarity"), *of_form)
    )
    best = W.partitionBy("token").orderBy(F.desc("similarity"), "form")
    forms = vocab.select(F.col("word").alias("form")) if grams is None else grams
    near = fuzzy_matches(tokens, forms, p, min_similarity).withColumn("r", F.row_number().over(best))
    near = near.where(F.col("r") <= max_candidates).drop("r")
    near = near.join(vocab, F.col("form") == F.col("word")).select("token", "form", "similarity", *of_form)
    return exact.unionByName(near)
