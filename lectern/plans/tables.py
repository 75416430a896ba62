"""Logical tables derived by Spark from the given ones; each is a lazy plan over whole tables and whole texts."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.profile import HEBREW, LATIN
from ..functions.text import tokenize
from ..operators import corpus, index, store
from ..session import dealt, shared_folder

# The letters the transliterated corpus is written with.
LATIN_FROM = "abcdefghijklmnopqrstuvwxyzéèêçäöüßíóúñáà"
HEBREW_TO = "אבגדהוזחטיכלמנסעפצקרשתךםןףץאהחגדוזטיעפנצק"
LINES_PER_COLUMN = 42
SECTION, SUBSECTION = 210, 30


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return dealt(raw(spark, d, "documents").select("doc_id", "text"), "doc_id")


_indexed: dict[tuple, store.CorpusIndex] = {}


def corpus_index(spark: SparkSession, d: str, lookup: bool = False) -> store.CorpusIndex:
    """The stored index of a folder's documents, built by the first query of the session that needs it; with postings and
    trigrams for `lookup`."""
    key = (spark.sparkContext.applicationId, d)
    if lookup:
        key = (*key, "lookup")
    if key not in _indexed:
        _indexed[key] = store.build(documents(spark, d), lookup=lookup)
    return _indexed[key]


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, li, line_text: physical lines of a document."""
    return documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("li", "line_text"))


def layout_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as nested layout pages of 42 lines: commas part runs, each sentence end brings one verse reference."""
    # A raw word that holds a stop ends with what follows its first one.
    ends = F.regexp_count("line_text", F.lit(r"\.\S*")) + F.when(F.col("li") == 0, 1).otherwise(0)
    verse = lambda i: F.struct(
        (F.col("doc_id") % 5 + 1).cast("int").alias("book"), (F.col("li") + 1).alias("chapter"), i.alias("verse")
    )
    no_verses = F.array().cast("array<struct<book:int,chapter:int,verse:int>>")
    mark = F.create_map(F.lit("standard"), (F.floor(F.col("li") / 6) % 8 + 1).cast("string"))
    double = F.create_map(F.lit("double"), F.lit("2"))
    marks = F.filter(
        F.array(F.when(F.col("li") % 6 == 0, mark), F.when(F.col("li") % 9 == 0, double)), lambda m: m.isNotNull()
    )
    return doc_lines(spark, d).withColumn("ends", ends).select(
        "doc_id",
        (F.floor(F.col("li") / LINES_PER_COLUMN) + 1).cast("int").alias("page"),
        (F.col("li") % LINES_PER_COLUMN + 1).cast("int").alias("line"),
        F.array(F.split("line_text", ", ")).alias("text"),
        F.when(F.col("ends") > 0, F.transform(F.sequence(F.lit(1), "ends"), verse)).otherwise(no_verses).alias("verses"),
        marks.alias("aliyot"),
        (F.length("line_text") < 60).alias("isPetucha"),
    )


def kept(df: DataFrame) -> DataFrame:
    """A table without texts that several others come from, written once to the shared folder: the plans of those begin at its
    files, of which each reads the columns it needs."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


class Corpus:
    """Reference tables of the documents, built from their layout pages; each is made by the first query that needs it."""

    def __init__(self, spark: SparkSession, d: str):
        self.pages = layout_pages(spark, d)
        # Lines with their words, from each line alone; parsed again by the tables that need words or texts.
        self.pieces = corpus.line_pieces(self.pages)

    @cached_property
    def lines_parsed(self) -> DataFrame:
        """Lines with counts and offsets, without texts and words."""
        return kept(corpus.in_reading_order(kept(self.pieces.drop("text", "runs", "pieces"))))

    def _placed(self, offsets: DataFrame) -> DataFrame:
        """Lines with their texts and `offsets`. The texts go to the offsets unparsed: words take several times the room."""
        return self.pages.join(offsets, corpus.PLACE)

    @property
    def _offsets(self) -> DataFrame:
        return self.lines_parsed.select(*corpus.PLACE, "n_words", "offset", "ends_offset")

    @cached_property
    def words_flat(self) -> DataFrame:
        return corpus.flatten_words(corpus.line_pieces(self._placed(self._offsets)))

    @cached_property
    def lines(self) -> DataFrame:
        return corpus.line_ranges(corpus.line_runs(self._placed(self._offsets)))

    @cached_property
    def line_spans(self) -> DataFrame:
        """The lines without texts."""
        return corpus.line_ranges(self.lines_parsed)

    @cached_property
    def columns(self) -> DataFrame:
        return corpus.column_ranges(self.line_spans)

    @cached_property
    def opens(self) -> DataFrame:
        return kept(corpus.verse_opens(self.lines_parsed))

    @cached_property
    def words(self) -> DataFrame:
        offsets = self._offsets.join(corpus.line_verses(self.lines_parsed, self.opens), corpus.PLACE)
        return corpus.flatten_words(corpus.line_pieces(self._placed(offsets)))

    @cached_property
    def verses(self) -> DataFrame:
        return kept(corpus.verse_table(self.opens, self.lines_parsed))

    @cached_property
    def marks(self) -> DataFrame:
        return corpus.group_marks(corpus.line_marks(self.lines_parsed))

    @cached_property
    def _spans(self) -> tuple[DataFrame, DataFrame]:
        sections, subsections = corpus.section_spans(kept(section_refs(self.verses)), self.verses)
        return sections, subsections

    @property
    def sections(self) -> DataFrame:
        return self._spans[0]

    @property
    def subsections(self) -> DataFrame:
        return self._spans[1]


_built: dict[tuple[str, str], Corpus] = {}


def corpus_of(spark: SparkSession, d: str) -> Corpus:
    """The corpus of a data folder, planned once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        _built[key] = Corpus(spark, d)
    return _built[key]


def section_refs(verses: DataFrame) -> DataFrame:
    """Sections of 14 verses in 7 parts; the last verse again as the optional part M. A document's last section may be
    shorter: its verses are spread over the parts, the last one ends the seventh."""
    v = verses.withColumn("section", F.floor(F.col("verse_id") / 14) + 1).withColumn("i", F.col("verse_id") % 14)
    ref = F.struct("book", "chapter", "verse")
    # A section has fourteen verses at most.
    v = v.withColumn("c", F.count(F.lit(1)).over(W.partitionBy("doc_id", "section")))
    part, last = (F.floor(F.col("i") * 7 / F.col("c")) + 1).cast("string"), F.col("i") == F.col("c") - 1
    parts = F.array_compact(F.array(part, F.when(last & (part != "7"), "7"), F.when(last, "M")))
    v = v.select("doc_id", "section", "i", ref.alias("ref"), F.explode(parts).alias("n"))
    return v.groupBy("doc_id", F.col("section").cast("int").alias("section"), "n").agg(
        F.min_by("ref", "i").alias("begin"), F.max_by("ref", "i").alias("end")
    )


def words(spark: SparkSession, d: str) -> DataFrame:
    return corpus_index(spark, d, lookup=True).words()


_counted: dict[tuple[str, str], DataFrame] = {}


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n_words of the documents that have words: a row per document, kept once per session. It needs no index."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _counted:
        n = index.corpus_word_count("text")
        _counted[key] = documents(spark, d).select("doc_id", n.alias("n_words")).where("n_words > 0").persist()
    return _counted[key]


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """word, n, total, idf of the documents, straight from their texts."""
    return index.vocabulary(documents(spark, d).select(F.explode(index.corpus_words("text")).alias("word")))


def _spans(counts: DataFrame, size: int, name: str, *more: str) -> DataFrame:
    """Consecutive spans of `size` positions per document."""
    last = F.floor((F.col("n_words") - 1) / size)
    return counts.select("doc_id", "n_words", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("s")).select(
        "doc_id",
        *more,
        (F.col("s") + 1).cast("int").alias(name),
        (F.col("s") * size).cast("int").alias("start"),
        (F.least((F.col("s") + 1) * size, F.col("n_words")) - 1).cast("int").alias("end"),
    )


def sections(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(word_counts(spark, d), SECTION, "n")
    return s.withColumn("book", (F.col("doc_id") % 5 + 1).cast("int")).withColumn(
        "name", F.concat(F.lit("Part "), F.col("n"))
    )


def subsections(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(word_counts(spark, d), SUBSECTION, "i")
    per = SECTION // SUBSECTION
    return s.select(
        "doc_id",
        (F.floor((F.col("i") - 1) / per) + 1).cast("int").alias("section"),
        ((F.col("i") - 1) % per + 1).cast("string").alias("n"),
        "start",
        "end",
    )


def cut_lines(texts: DataFrame, key: str, per_line: int = 8) -> DataFrame:
    """Readings from plain text: whitespace words cut in lines of eight."""
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    q = texts.select(F.col(key).alias("query_id"), w.alias("w"))
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / per_line).cast("int"))
    cut = F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i * per_line + 1, F.lit(per_line)), " "))
    return q.select("query_id", F.posexplode(cut).alias("line_no", "text"))


def query_lines(spark: SparkSession, d: str) -> DataFrame:
    return cut_lines(raw(spark, d, "benchmark"), "item_id")


def conversation_texts(spark: SparkSession, d: str) -> DataFrame:
    """Typed texts: one query per conversation turn."""
    c = raw(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


def hebrew_words(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words of the benchmark items, transliterated: item_id, a, b with b the next word."""
    b = raw(spark, d, "benchmark").select("item_id", tokenize("text").alias("w"))
    spell = lambda x: F.translate(x, LATIN_FROM, HEBREW_TO)
    return b.select("item_id", F.posexplode("w").alias("i", "x"), "w").select(
        "item_id", "i", spell(F.col("x")).alias("a"), spell(F.try_element_at("w", F.col("i") + 2)).alias("b")
    ).where("b is not null")


PROFILE, SCRIPT = LATIN, HEBREW
