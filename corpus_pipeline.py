"""Corpus pipeline: language, recurring lines, near copies, benchmark passages, sampled segmentations.

Every stage takes what the one before it kept and gives documents with the columns of the table (`doc_id`, `text`,
`lang`, `source`, `n_chars`, and any others), the last one their segmentations. Null ids, null and empty texts and
repeated rows are treated as the operators say.

1. language ID keeps the documents with a language of score `MIN_SCORE` or more and sets `lang` to it; the model learns
   from the documents of the other three folds.
2. line dedup takes recurring lines out of `text` and sets `n_chars`; a document that has no words left goes.
3. near-dedup keeps one row of the document with the smallest id of each group.
4. decontamination takes out the documents that the benchmark contaminates; documents below the coverage limit stay.
5. encoding gives `k` sampled segmentations of each document.

`ORACLE_SQL` is None: the first, third and last stage have no SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, language, line_templates, near_dedup, segmentations
from lectern.llm.common import held_out, read, shared_folder, shielded

MIN_SCORE, SEGMENTATIONS = 0.3, 2
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@shielded(only=COLUMNS)
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; `und` and unsure ones go."""
    net = language.train(docs.where(~held_out()))
    known = language.predict(docs, net).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return known.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@shielded(only=COLUMNS)
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; documents that were nothing else go, untouched ones stay as they are."""
    kept = line_templates.drop_recurring(docs)
    kept = kept.where((F.col("n_dropped") == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    chars = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.withColumn("n_chars", chars).select(*docs.columns)


@shielded(only=COLUMNS)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; unlike documents with one id or none are groups of their own."""
    groups = near_dedup.near_duplicates(docs)
    kept = groups.where("kept").groupBy(F.col("doc_id").alias("_id"), "_th", "component").agg(F.count(F.lit(1)).alias("_rows"))
    # Documents without words are in no group: each stays.
    alone = F.when(F.col("component").isNull(), F.struct("_id", "_th"))
    # Several texts may share the smallest id of a group; the one with the smallest hash stays.
    kept = kept.groupBy("component", alone.alias("_alone")).agg(F.min(F.struct("_th", "_id", "_rows")).alias("_one")).select("_one._id", "_one._th", "_one._rows")
    on = docs["doc_id"].eqNullSafe(kept["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(kept["_th"])
    rows = docs.join(kept, on).select(*[docs[c] for c in docs.columns], "_rows")
    # Only rows that are there more than once are shuffled again.
    once, more = rows.where("_rows = 1"), rows.where("_rows > 1").dropDuplicates(["doc_id", "text"])
    return once.union(more).select(*docs.columns)


@shielded(only=COLUMNS)
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    found = decontaminate.find(docs, read(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(*docs.columns)


@shielded(only=COLUMNS)
def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations, with whether decoding gives the text back."""
    return segmentations.encode(docs, SEGMENTATIONS)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", segmentation),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
