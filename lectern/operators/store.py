"""Stored word index of a corpus: built once, read by every locate job.

A version is a folder of Parquet tables:

- `segments`: the tokenized corpus, a segment of a document per row, `sampled` ones apart, from which thresholds are taken;
- `blocks`: the same, `BLOCK` words per row, in partitions by document;
- `vocabulary`: the forms with their counts and weights;
- `grams`: trigrams of the forms, bucketed by form;
- `postings`: one row per word, in partitions by a hash of the word, so that a job reads only the parts its words lie in, and
  inside those bucketed by document and segment and sorted by word, so that what is summed per place in a document needs no
  shuffle. A version that only locates may be built without them and without `grams`.

Text is tokenized once, into `segments`; the other tables come from it. A row in `versions`, written last, makes a version
visible: readers see whole versions only, a build that fails leaves none, and older versions stay readable.

Long documents are cut into segments of `segment` words. A segment also holds the first `overlap` words of the next one and
the last few of the one before it, so that a reading of up to `overlap` words that begins in it is counted in it alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.profile import LATIN, Profile
from ..session import remove_folder, shared_folder
from .expect import BuildError, Watch
from .index import BLOCK, corpus_words, form_grams, vocabulary


@dataclass(frozen=True)
class Layout:
    """Words of a bucket of postings, forms of a bucket of trigrams, parts by word and by document, one document in how many is in
    the sample, words of a segment and of its overlap."""

    bucket_words: int = 250_000
    bucket_forms: int = 20_000
    word_parts: int = 4
    doc_parts: int = 16
    sample: int = 16
    segment: int = 1 << 17
    overlap: int = 1 << 14
    before: int = 16


@dataclass(frozen=True)
class CorpusIndex:
    spark: SparkSession
    path: str
    layout: Layout
    profile: Profile

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def vocab(self) -> DataFrame:
        """word, n, total, idf"""
        return self._read("vocabulary")

    @property
    def grams(self) -> DataFrame:
        """form, flen, gram"""
        return self.spark.table(_name(self.path, "grams"))

    def segments(self) -> DataFrame:
        """doc_id, seg, doc_words, from_word, words, sampled: a segment with its overlaps; its first word is number `from_word`."""
        # Spark reads a partition's value as text.
        return self._read("segments").withColumn("sampled", F.col("sampled") == "true")

    def postings(self, words: DataFrame | None = None) -> DataFrame:
        """doc_id, seg, pos, word, sampled; with `words`, only the parts that hold them (at most `word_parts` numbers are
        fetched to name those parts)."""
        table = self.spark.table(_name(self.path, "postings"))
        if words is None:
            return table
        parts = words.select(word_part("word", self.layout).alias("part")).distinct()
        return table.where(F.col("part").isin([r["part"] for r in parts.collect()]))

    def words(self, words: DataFrame | None = None) -> DataFrame:
        """doc_id, pos, word: every word once."""
        rows = self.postings(words).where(F.floor(F.col("pos") / self.layout.segment) == F.col("seg"))
        return rows.select("doc_id", "pos", "word")

    def doc_words(self) -> DataFrame:
        """doc_id, n_words of the documents that have words."""
        return self._read("blocks").where("block = 0").select("doc_id", F.col("doc_words").alias("n_words"))

    def blocks(self, docs: DataFrame | None = None) -> DataFrame:
        """doc_id, block, doc_words, words; with `docs`, only the parts that hold those documents."""
        table = self._read("blocks")
        if docs is None:
            return table
        parts = docs.select(doc_part("doc_id", self.layout).alias("part")).distinct()
        return table.where(F.col("part").isin([r["part"] for r in parts.collect()]))


def word_part(word: str, layout: Layout):
    return F.pmod(F.xxhash64(word), F.lit(layout.word_parts)).cast("int")


def doc_part(doc: str, layout: Layout):
    return F.pmod(F.xxhash64(doc), F.lit(layout.doc_parts)).cast("int")


def in_sample(layout: Layout):
    return F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(layout.sample)) == 0


def _segments(documents: DataFrame, profile: Profile, layout: Layout) -> DataFrame:
    d = documents.select("doc_id", corpus_words("text", profile).alias("toks"))
    d = d.where(F.size("toks") > 0).withColumn("doc_words", F.size("toks"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("doc_words") - 1) / layout.segment).cast("int"))).alias("seg"))
    d = d.withColumn("from_word", F.greatest(F.lit(0), F.col("seg") * layout.segment - layout.before))
    size = (F.col("seg") + 1) * layout.segment + layout.overlap - F.col("from_word")
    return d.select("doc_id", "seg", "doc_words", "from_word", F.slice("toks", F.col("from_word") + 1, size).alias("words"), in_sample(layout).alias("sampled"))


def _blocks(segments: DataFrame, layout: Layout) -> DataFrame:
    """The corpus as rows of `BLOCK` words keyed by (doc_id, block), each from the segment it begins in."""
    first = F.ceil(F.col("seg") * layout.segment / BLOCK).cast("int")
    last = F.floor((F.least(F.col("doc_words"), (F.col("seg") + 1) * layout.segment) - 1) / BLOCK).cast("int")
    s = segments.select("*", F.explode(F.when(last >= first, F.sequence(first, last))).alias("block"))
    words = F.slice("words", F.col("block") * BLOCK - F.col("from_word") + 1, F.lit(BLOCK))
    return s.select("doc_id", "doc_words", "block", words.alias("words"))


def _name(path: str, table: str) -> str:
    return f"lectern_{table}_{path.rsplit('/', 1)[-1]}"


#: Columns, partitions and buckets of the bucketed tables, as the catalog is told about files of another session.
TABLES = {
    "postings": ("doc_id BIGINT, seg INT, pos INT, word STRING, sampled BOOLEAN, part INT", "PARTITIONED BY (sampled, part)", "doc_id, seg", "word"),
    "grams": ("form STRING, flen INT, gram STRING", "", "form", "form"),
}


def build(
    documents: DataFrame, path: str | None = None, profile: Profile = LATIN, layout: Layout = Layout(), watch: Watch | None = None, lookup: bool = True
) -> CorpusIndex:
    """Index `documents` (doc_id, text) as a new version under `path` (by default a new folder of the shared one).

    `watch` checks the blocks (doc_id, block, doc_words, words) as they are written; on a breach no version comes to be.
    Without `lookup` there are no postings and trigrams, which locating does not need.
    """
    spark = documents.sparkSession
    path = path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    folder = f"{path}/v{uuid.uuid4().hex}"
    _segments(documents, profile, layout).write.partitionBy("sampled").parquet(f"{folder}/segments")
    rows = _blocks(spark.read.parquet(f"{folder}/segments"), layout).withColumn("part", doc_part("doc_id", layout))
    # Parts are dealt by size: large ones over several files, small ones together.
    rows = rows.hint("rebalance", F.col("part"), F.col("doc_id")).sortWithinPartitions("part", "doc_id", "block")
    (watch.on(rows) if watch else rows).write.partitionBy("part").parquet(f"{folder}/blocks")
    if watch:
        try:
            watch.enforce()
        except BuildError:
            remove_folder(spark, folder)
            raise
    blocks = spark.read.parquet(f"{folder}/blocks")
    words = blocks.select("doc_id", "block", F.posexplode("words").alias("i", "word"))
    total = blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    vocabulary(words, total).sortWithinPartitions("word").write.parquet(f"{folder}/vocabulary")
    vocab = spark.read.parquet(f"{folder}/vocabulary")
    n = max(8, -(-total // layout.bucket_words))
    n_grams = max(8, -(-vocab.count() // layout.bucket_forms))
    if lookup:
        pos = F.col("block") * BLOCK + F.col("i")
        place = words.select(F.col("doc_id").cast("bigint"), pos.cast("int").alias("pos"), "word")
        own, inside = F.floor(F.col("pos") / layout.segment).cast("int"), F.col("pos") % layout.segment
        segs = F.array(own, F.when((inside < layout.overlap) & (own > 0), own - 1), F.when(inside >= layout.segment - layout.before, own + 1))
        place = place.select("doc_id", F.explode(F.array_compact(segs)).alias("seg"), "pos", "word", in_sample(layout).alias("sampled"), word_part("word", layout).alias("part"))
        _bucketed(place.repartition(n, "doc_id", "seg"), folder, "postings", n, ["sampled", "part"])
        _bucketed(form_grams(vocab).repartition(n_grams, "form"), folder, "grams", n_grams, [])

    # The row that makes the version visible.
    row = [(folder.rsplit("/", 1)[-1], n, n_grams, layout.bucket_words, layout.bucket_forms, layout.word_parts, layout.doc_parts, layout.sample, layout.segment, layout.overlap, layout.before)]
    done = spark.createDataFrame(row, VERSION).withColumn("built", F.current_timestamp())
    done.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return CorpusIndex(spark, folder, layout, profile)


VERSION = (
    "version string, buckets int, gram_buckets int, bucket_words int, bucket_forms int, word_parts int, doc_parts int, sample int, segment int, overlap int, before int"
)


def _bucketed(df: DataFrame, folder: str, name: str, n: int, parts: list[str]) -> None:
    _, _, keys, order = TABLES[name]
    writer = df.write.format("parquet").option("path", f"{folder}/{name}").bucketBy(n, *keys.split(", ")).sortBy(order)
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(_name(folder, name))


def open_index(spark: SparkSession, path: str, profile: Profile = LATIN, version: str | None = None) -> CorpusIndex:
    """The last version under `path`, or the one named. Its tables are made known to this session's catalog if they are not."""
    rows = spark.read.parquet(f"{path}/versions")
    row = (rows.where(F.col("version") == version) if version else rows.orderBy(F.desc("built"), "version")).first()
    if row is None:
        raise ValueError(f"no such version of the index: {version}")
    folder = f"{path}/{row['version']}"
    for name, n in (("postings", row["buckets"]), ("grams", row["gram_buckets"])):
        table = _name(folder, name)
        if not spark.catalog.tableExists(table):
            columns, parts, keys, order = TABLES[name]
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {parts} CLUSTERED BY ({keys}) SORTED BY ({order}) INTO {n} BUCKETS LOCATION '{folder}/{name}'")
            if parts:
                spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    own = Layout(**{f: row[f] for f in Layout.__dataclass_fields__})
    return CorpusIndex(spark, folder, own, profile)
