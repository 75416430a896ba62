"""Evaluation jobs: sampled windows, seeded perturbation, sweeps, error rates and consistency checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.profile import LATIN, Profile
from ..functions.text import content_key, file_number
from .joins import point_in_interval, prefix_sums
from .locate import LocateConfig, locate
from .order import previous_value
from .store import CorpusIndex


@dataclass(frozen=True)
class Noise:
    # Rates of each kind of error.
    char_error: float = 0.2
    word_drop: float = 0.05
    word_merge: float = 0.03
    word_split: float = 0.03
    line_drop: float = 0.05
    confusable_below: float = 0.5
    drop_below: float = 0.75
    wildcard_below: float = 0.9
    split_min: int = 4


def sample_windows(lines: DataFrame, n: int, seed: int, min_lines: int = 6, max_lines: int = 10) -> DataFrame:
    """query_id, line_no, text, doc_id, true_start, true_end: n windows of consecutive lines of random columns.

    `lines`: doc_id, n (column), line_no (from 1 within the column), start, end, text.
    """
    spark = lines.sparkSession
    cols = lines.groupBy("doc_id", "n").agg(F.max("line_no").alias("lines"))
    per_doc = cols.groupBy("doc_id").agg(F.count(F.lit(1)).alias("columns"))
    per_doc = prefix_sums(per_doc, [], "doc_id", {"columns": "first"}, levels=3)
    per_doc = per_doc.withColumn("last", F.col("first") + F.col("columns") - 1)
    total = per_doc.agg(F.max("last") + 1).first()[0]
    s = spark.range(1, n + 1).withColumnRenamed("id", "query_id")
    s = s.withColumn("pick", F.floor(draws.unit(seed, F.col("query_id"), "column") * total))
    s = point_in_interval(s, "pick", per_doc, "first", "last", [], 1024)
    s = s.select("query_id", "doc_id", (F.col("pick") - F.col("first") + 1).cast("int").alias("n")).join(cols, ["doc_id", "n"])
    span = max_lines - min_lines + 1
    s = s.withColumn("len", F.floor(draws.unit(seed, F.col("query_id"), "length") * span) + min_lines)
    room = F.greatest(F.col("lines") - F.col("len"), F.lit(0))
    s = s.withColumn("from", F.floor(draws.unit(seed, F.col("query_id"), "from") * room))
    j = s.join(lines, ["doc_id", "n"])
    j = j.where((F.col("line_no") > F.col("from")) & (F.col("line_no") <= F.col("from") + F.col("len")) & (F.col("end") >= F.col("start")))
    truth = j.groupBy("query_id").agg(F.min("start").alias("true_start"), F.max("end").alias("true_end"))
    return j.select("query_id", "line_no", "text", "doc_id").join(truth, "query_id")


def noisy_word(word: Column, rate: Column, key: list, noise: Noise, p: Profile) -> Column:
    """Letters kept, swapped for a confusable one, dropped, replaced by `?`, or followed by a stray letter."""
    letters = F.lit(p.alphabet)
    any_letter = lambda i: F.substring(letters, (F.floor(draws.unit(*key, i, "letter") * len(p.alphabet)) + 1).cast("int"), F.lit(1))
    partners = {}
    for a, b in (x for q in p.confusable for x in (q, q[::-1])):
        partners[a] = partners.get(a, "") + b
    table = F.create_map(*[F.lit(x) for kv in partners.items() for x in kv]) if partners else None

    def confused(c, i):
        if table is None:
            return any_letter(i)
        own = F.try_element_at(table, c)
        at = (F.floor(draws.unit(*key, i, "letter") * F.length(own)) + 1).cast("int")
        return F.coalesce(F.substring(own, at, F.lit(1)), any_letter(i))

    def letter(c, i):
        kind = draws.unit(*key, i, "kind")
        return (
            F.when(draws.unit(*key, i, "error") >= rate, c)
            .when(kind < noise.confusable_below, confused(c, i))
            .when(kind < noise.drop_below, F.lit(""))
            .when(kind < noise.wildcard_below, F.lit("?"))
            .otherwise(F.concat(c, any_letter(i)))
        )

    return F.array_join(F.transform(F.split(word, ""), letter), "")


def perturb_text(query_lines: DataFrame, seed: int, noise: Noise = Noise(), p: Profile = LATIN, rate: str | None = None) -> DataFrame:
    """query_lines (query_id, line_no, text) with seeded errors; dropped lines are gone. `rate`: column with the letter rate."""
    at = F.col(rate) if rate else F.lit(noise.char_error)
    key = [seed, F.col("query_id"), F.col("line_no")]
    lines = query_lines.where(draws.unit(*key, "line") >= noise.line_drop)
    noisy = lambda w, i: noisy_word(w, at, [*key, i], noise, p)
    words = F.filter(F.split("text", " "), lambda w: w != "")
    flags = F.transform(
        words,
        lambda w, i: F.struct(
            noisy(w, i).alias("w"),
            (draws.unit(*key, i, "drop") < noise.word_drop).alias("drop"),
            (draws.unit(*key, i, "merge") < noise.word_merge).alias("merge"),
            (draws.unit(*key, i, "split") < noise.word_split).alias("split"),
            draws.unit(*key, i, "cut").alias("cut"),
        ),
    )
    lines = lines.withColumn("_f", flags)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("glue"))

    def step(acc, x):
        """`glue`: the last word written takes this one too."""
        last = F.try_element_at(acc["out"], F.lit(-1))
        glued = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat(last, x["w"])))
        cut = (F.floor(x["cut"] * (F.length(x["w"]) - 2)) + 1).cast("int")
        halves = F.array(F.substring(x["w"], F.lit(1), cut), F.substring(x["w"], cut + 1, F.length(x["w"])))
        own = F.when(~x["merge"] & x["split"] & (F.length(x["w"]) >= noise.split_min), halves).otherwise(F.array(x["w"]))
        out = F.when(acc["glue"], glued).when(x["drop"], acc["out"]).otherwise(F.concat(acc["out"], own))
        return F.struct(out.alias("out"), (~acc["glue"] & ~x["drop"] & x["merge"]).alias("glue"))

    done = F.aggregate("_f", start, step, lambda a: F.filter(a["out"], lambda w: w != ""))
    return lines.withColumn("text", F.array_join(done, " ")).drop("_f")


def span_hit(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of at least half of the shorter span."""
    overlap = F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1
    shorter = F.least(a_end - a_start, b_end - b_start) + 1
    return overlap >= shorter * 0.5


def tally(results: DataFrame, key: str) -> DataFrame:
    """Per key: windows, top1, confident right and wrong, ambiguous, insufficient. `results`: key, status, hit."""
    hit, sure = F.coalesce("hit", F.lit(False)), F.col("status") == "confident"
    return results.groupBy(key).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(hit).alias("top1"),
        F.count_if(sure & hit).alias("confident_right"),
        F.count_if(sure & ~hit).alias("confident_wrong"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("status") == "insufficient").alias("insufficient"),
    )


def robustness_sweep(
    windows: DataFrame, corpus: CorpusIndex, rates: list[float], seed: int, cfg: LocateConfig = LocateConfig()
) -> DataFrame:
    """Sampled windows located at every letter error rate, all rates in one job, and tallied per rate."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("rate")) for i, r in enumerate(rates)])
    w = windows.select("*", F.explode(steps).alias("s"))
    w = w.withColumns({"query_id": F.col("query_id") * len(rates) + F.col("s.i"), "rate": F.col("s.rate")}).drop("s")
    noisy = perturb_text(w, seed, p=cfg.profile, rate="rate").select("query_id", "line_no", "text")
    res = locate(noisy, corpus, cfg).results
    guess = F.coalesce("best", F.try_element_at("alternatives", F.lit(1)))
    res = res.select("query_id", "status", guess.alias("g"))
    truth = w.select("query_id", "rate", "doc_id", "true_start", "true_end").distinct()
    j = truth.join(res, "query_id", "left").na.fill("insufficient", ["status"])
    hit = (F.col("g.doc_id") == F.col("doc_id")) & span_hit(F.col("g.first_word"), F.col("g.last_word"), F.col("true_start"), F.col("true_end"))
    return tally(j.withColumn("hit", hit), "rate")


def threshold_sweep(results: DataFrame, thresholds: list[float]) -> DataFrame:
    """Statuses per margin threshold. `results`: decided rows with margin and candidates' strength as `strong`, `rivals`."""
    t = results.select("*", F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    status = (
        F.when(~F.col("strong"), "insufficient")
        .when(F.col("rivals") & (F.col("margin") < F.col("threshold")), "ambiguous")
        .otherwise("confident")
    )
    return t.groupBy("threshold", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def expected_column(results: DataFrame, segments: DataFrame, first: int = 1, last: int = 245) -> DataFrame:
    """results (set, file, ...) with expected_col: the file's number less the offset of its segment, if in range.

    Overlapping segments of a set: the earliest one counts.
    """
    r = results.withColumn("number", file_number("file"))
    seg = segments.select("set", F.col("from").alias("_f"), F.col("to").alias("_t"), "offset")
    hit = point_in_interval(r.select("set", "number").distinct(), "number", seg, "_f", "_t", ["set"], 64)
    hit = hit.groupBy("set", "number").agg(F.min_by("offset", F.struct("_f", "_t")).alias("offset"))
    j = r.join(hit, ["set", "number"], "left").withColumn("_c", (F.col("number") - F.col("offset")).cast("int"))
    return j.withColumn("expected_col", F.when(F.col("_c").between(first, last), F.col("_c"))).drop("_c", "offset", "number")


def score_against_truth(results: DataFrame, segments: DataFrame, columns: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """results with expected span and hit: an explicit span (set, file, start, end), else the expected column's."""
    r = expected_column(results, segments)
    c = columns.select(F.col("n").alias("expected_col"), F.col("start").alias("_cs"), F.col("end").alias("_ce"))
    r = r.join(c, "expected_col", "left")
    if spans is not None:
        r = r.join(spans.select("set", "file", F.col("start").alias("_xs"), F.col("end").alias("_xe")), ["set", "file"], "left")
        r = r.withColumns({"_cs": F.coalesce("_xs", "_cs"), "_ce": F.coalesce("_xe", "_ce")}).drop("_xs", "_xe")
    hit = span_hit(F.col("pred_start"), F.col("pred_end"), F.col("_cs"), F.col("_ce"))
    return r.withColumns({"true_start": F.col("_cs"), "true_end": F.col("_ce"), "hit": hit}).drop("_cs", "_ce")


def letter_error_rate(reads: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Per key: edits and letters over the first lines both have, spaces ignored, and the share of exact words.

    reads, truth: key, line_no, text (normalized). A reading is at most a column, so its lines fit one row.
    """
    gather = lambda df, n: df.where("text <> ''").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias(n))
    j = gather(reads, "_r").join(gather(truth, "_t"), key)
    n = F.least(F.size("_r"), F.size("_t"))
    text = lambda c: F.array_join(F.transform(F.slice(c, 1, n), lambda x: x["text"]), " ")
    j = j.select(key, text("_r").alias("_r"), text("_t").alias("_t"))
    plain = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    words = F.split("_r", " ")
    known = F.size(F.filter(words, lambda w: F.array_contains(F.split("_t", " "), w)))
    return j.select(
        key,
        F.levenshtein(plain(F.col("_r")), plain(F.col("_t"))).alias("edits"),
        F.length(plain(F.col("_t"))).alias("letters"),
        (known / F.greatest(F.lit(1), F.size(words))).alias("exact_words"),
    )


def overall_error_rate(rates: DataFrame) -> DataFrame:
    return rates.agg(F.count(F.lit(1)).alias("columns"), F.sum("edits").alias("edits"), F.sum("letters").alias("letters"), (F.sum("edits") / F.sum("letters")).alias("rate"))


def order_consistency(results: DataFrame, chunk: int = 1024) -> DataFrame:
    """results (set, ord, status, start) with `jump` and `backwards`: confident starts against the confident one before."""
    sure = F.when(F.col("status") == "confident", F.col("start"))
    r = previous_value(results.withColumn("_s", sure), ["set"], "ord", "_s", "_p", chunk)
    return r.withColumns({"jump": F.col("_s") - F.col("_p"), "backwards": F.coalesce(F.col("_s") < F.col("_p"), F.lit(False))}).drop("_s", "_p")


def best_line_offset(reads: DataFrame, guesses: DataFrame, truth: DataFrame, min_lines: int = 3) -> DataFrame:
    """query_id, offset, edits, length, lines: the shift of reading lines against true lines with the fewest errors.

    reads: query_id, k, text. guesses: query_id, k, line (a first idea of the true line). truth: query_id, line, text.
    """
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d")
    offsets = guesses.select("query_id", (F.col("k") - F.col("line")).alias("o"), near)
    offsets = offsets.select("query_id", (F.col("o") + F.col("d")).alias("offset")).distinct()
    j = reads.join(offsets, "query_id").withColumn("line", F.col("k") - F.col("offset"))
    j = j.join(truth.where("text <> ''").withColumnRenamed("text", "want"), ["query_id", "line"])
    g = j.groupBy("query_id", "offset").agg(F.sort_array(F.collect_list(F.struct("k", "text", "want"))).alias("l"))
    g = g.where(F.size("l") >= min_lines)
    text = lambda f: F.array_join(F.transform("l", lambda x: x[f]), " ")
    g = g.select("query_id", "offset", F.size("l").alias("lines"), F.levenshtein(text("text"), text("want")).alias("edits"), F.length(text("want")).alias("length"))
    g = g.withColumn("_rank", F.struct(F.col("edits") / F.col("length"), F.col("offset")))
    best = g.groupBy("query_id").agg(F.min_by(F.struct("offset", "edits", "length", "lines"), "_rank").alias("b"))
    return best.select("query_id", "b.*")


BUCKETS = 256


def indexed_vocabulary(forms: DataFrame, seed: int) -> DataFrame:
    """bucket, slot, form: a table to draw words from, numbered inside hash buckets (no global order)."""
    b = forms.select(F.col("word").alias("form"), (draws.number(seed, F.col("word"), "bucket") % BUCKETS).alias("bucket"))
    return b.withColumn("slot", F.row_number().over(W.partitionBy("bucket").orderBy("form")) - 1)


def draw_words(rows: DataFrame, vocab: DataFrame, key: list, out: str) -> DataFrame:
    """Rows with a random vocabulary word: a bucket, then a slot in it."""
    sizes = vocab.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"))
    r = rows.withColumn("bucket", draws.number(*key, "bucket") % BUCKETS).join(sizes, "bucket")
    r = r.withColumn("slot", (draws.number(*key, "slot") % F.col("_size")).cast("int")).drop("_size")
    return r.join(vocab.withColumnRenamed("form", out), ["bucket", "slot"]).drop("bucket", "slot")


def swap_words(words: DataFrame, vocab: DataFrame, n: int, seed: int) -> DataFrame:
    """query_id, line_no, i, from, to: up to n words of three letters or more swapped, at most one per line.

    words: query_id, line_no, i, word. vocab: forms of three to six letters, indexed.
    """
    key = [seed, F.col("query_id"), F.col("line_no"), F.col("i")]
    c = words.where(F.length("word") >= 3)
    c = draw_words(c, vocab, key, "to").where(F.col("to") != F.col("word")).withColumn("_d", draws.number(*key, "order"))
    one = W.partitionBy("query_id", "line_no").orderBy("_d", "i")
    c = c.withColumn("_r", F.row_number().over(one)).where("_r = 1")
    few = W.partitionBy("query_id").orderBy("_d", "line_no")
    c = c.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= n)
    return c.select("query_id", "line_no", "i", F.col("word").alias("from"), "to")


def read_or_recite(swaps: DataFrame, reads: DataFrame) -> DataFrame:
    """Swaps with `outcome`: printed if the reading of the line has the new word, restored if the old one, else other."""
    j = swaps.join(reads.select("query_id", "line_no", F.split("text", " ").alias("_w")), ["query_id", "line_no"], "left")
    has = lambda c: F.coalesce(F.array_contains("_w", F.col(c)), F.lit(False))
    return j.withColumn("outcome", F.when(has("to"), "printed").when(has("from"), "restored").otherwise("other")).drop("_w")


def shuffled_control(words: DataFrame, vocab: DataFrame, share: float, seed: int) -> DataFrame:
    """words (query_id, line_no, i, word): a share of the samples gets random vocabulary words, as many per line as before."""
    w = words.withColumn("shuffled", draws.unit(seed, F.col("query_id"), "control") < share)
    key = [seed, F.col("query_id"), F.col("line_no"), F.col("i")]
    new = draw_words(w.where("shuffled"), vocab, key, "_new").withColumn("word", F.col("_new")).drop("_new")
    return w.where("not shuffled").unionByName(new)


def incremental(inputs: DataFrame, stored: DataFrame, content: str, salt: str, compute, columns: list[str]) -> DataFrame:
    """Results for all inputs: stored ones by content key, the rest computed; `cached` tells which.

    stored: key and `columns`. `compute` maps inputs (with their key) to rows with key and `columns`; equal contents
    are computed once.
    """
    k = inputs.withColumn("key", content_key(content, salt))
    fresh = k.join(stored.select("key"), "key", "left_anti").dropDuplicates(["key"])
    done = compute(fresh).select("key", *columns, F.lit(False).alias("cached"))
    both = stored.select("key", *columns, F.lit(True).alias("cached")).unionByName(done)
    return k.join(both, "key")


def nearest_label(detected: DataFrame, truth: DataFrame, reach: float = 0.3) -> DataFrame:
    """detected (page, li, y, x0, x1, pitch, cut) with label and status.

    A line takes the nearest true line (page, ti, y, x0, x1, text) within `reach` pitches; the first line that also
    covers its extent keeps it, later ones are unmatched. Page rows meet only inside blocks of y.
    """
    size = 256
    d = detected.withColumns({"_lo": F.col("y") - F.col("pitch") * reach, "_hi": F.col("y") + F.col("pitch") * reach})
    t = truth.select("page", "ti", F.col("y").alias("_ty"), F.col("x0").alias("_t0"), F.col("x1").alias("_t1"), F.col("text").alias("label"))
    seen = d.where("not cut").select("page", "li", "y", F.col("x0"), F.col("x1"), "_lo", "_hi")
    near = point_in_interval(t, "_ty", seen, "_lo", "_hi", ["page"], size)
    best = near.groupBy("page", "li", "x0", "x1").agg(
        F.min_by(F.struct("ti", "_t0", "_t1", "label"), F.struct(F.abs(F.col("y") - F.col("_ty")), F.col("ti"))).alias("b")
    )
    best = best.select("page", "li", "x0", "x1", "b.*").where("label <> ''")
    wide = F.col("_t1") - F.col("_t0")
    fits = (F.col("x1") >= F.col("_t1") - wide * 0.08) & (F.col("x0") >= F.col("_t0") - wide * 0.1) & (F.col("x1") <= F.col("_t1") + wide * 0.1)
    best = best.withColumn("_ok", fits)
    first = best.where("_ok").groupBy("page", "ti").agg(F.min("li").alias("_first"))
    best = best.join(first, ["page", "ti"], "left")
    got = F.when(F.col("_first") == F.col("li"), "kept").when(F.col("_first") < F.col("li"), "unmatched").otherwise("bad-extent")
    best = best.select("page", "li", "ti", "label", got.alias("_got"))
    j = detected.join(best, ["page", "li"], "left")
    status = F.when(F.col("cut"), "cut").otherwise(F.coalesce("_got", F.lit("unmatched")))
    keep = status == "kept"
    return j.withColumns({"status": status, "label": F.when(keep, F.col("label")), "ti": F.when(keep, F.col("ti"))}).drop("_got")
