"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..functions.profile import LATIN, Profile
from ..functions.text import js_round

PAGE_LINE = (
    "array<struct<text:array<array<string>>,verses:array<struct<book:int,chapter:int,verse:int>>,"
    "aliyot:array<map<string,string>>,isPetucha:boolean>>"
)
TOC = "map<string,map<string,map<string,struct<p:int,l:int>>>>"
EVAL_ROW = (
    "file string, expected_col int, status string, pred_col int, pred_start int, pred_end int, hit int, score double, "
    "margin double, aligned int, tokens int, lines int, ocr_ms int, in_tok int, out_tok int, cached int"
)
READING = "struct<lines:array<struct<text:string,uncertain:boolean,gapBefore:string>>,lineCountVisible:double>"
TRUTH = (
    "offset int, segments array<struct<from:int,to:int,offset:int>>, columns map<string,struct<startWord:int,endWord:int>>"
)
# Image types by extension.


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page, line and the line's fields from `doc=<id>/<page>.json` files, each an array of lines.

    A file is one column of text, so a whole file per row is small.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    number = lambda p: F.regexp_extract("file", p, 1)
    lines = F.from_json("value", PAGE_LINE)
    p = raw.select(
        number(r"doc=(\d+)/").cast("bigint").alias("doc_id"), number(r"(\d+)\.json$").cast("int").alias("page"), F.posexplode(lines).alias("i", "l")
    )
    return p.select("doc_id", "page", (F.col("i") + 1).alias("line"), "l.*")


def write_pages(pages: DataFrame, path: str) -> None:
    """Page lines as one JSON object per page (doc_id, page, lines); a page has few lines, so it fits one row."""
    line = F.struct("line", "text", "verses", "aliyot", "isPetucha")
    g = pages.groupBy("doc_id", "page").agg(F.collect_list(line).alias("lines"))
    g = g.withColumn("lines", F.array_sort("lines", lambda a, b: a["line"] - b["line"]))
    g.write.mode("overwrite").json(path)


def read_page_objects(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page, line and the line's fields from one JSON object per page: the form for many documents."""
    raw = spark.read.schema(f"doc_id bigint, page int, lines {PAGE_LINE}").json(path)
    p = raw.select("doc_id", "page", F.posexplode("lines").alias("i", "l"))
    return p.select("doc_id", "page", (F.col("i") + 1).alias("line"), "l.*")


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, book, chapter, verse, page, line from nested maps, one JSON object per document line."""
    t = spark.read.schema(f"doc_id bigint, toc {TOC}").json(path)
    t = t.select("doc_id", F.explode("toc").alias("book", "c")).select("doc_id", "book", F.explode("c").alias("chapter", "v"))
    t = t.select("doc_id", "book", "chapter", F.explode("v").alias("verse", "at"))
    return t.select(
        "doc_id", *[F.col(c).cast("int").alias(c) for c in ("book", "chapter", "verse")], F.col("at.p").alias("page"), F.col("at.l").alias("line")
    )


def write_reference(tables: dict[str, DataFrame], path: str, source: str, commit: str) -> None:
    """The reference tables as parquet with their provenance, in the order of the rows given; zstd, as they hold every word."""
    for name, df in tables.items():
        df.withColumn("source", F.lit(source)).withColumn("commit", F.lit(commit)).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def read_reference(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_eval(results: DataFrame, path: str) -> None:
    """Result rows as CSV with a header; missing numbers are blank."""
    columns = [c.split()[0] for c in EVAL_ROW.split(", ")]
    results.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(EVAL_ROW).csv(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """(file, text) rows as tab-separated shards."""
    labels.select("file", "text").write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def read_labels(spark: SparkSession, path: str, widths: DataFrame | None = None) -> DataFrame:
    """file, text; with `widths` (file, width) lines too short for their label are left out."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("file string, text string").csv(path)
    rows = rows.where(F.coalesce(F.trim("file"), F.lit("")) != "")
    if widths is None:
        return rows
    return rows.join(widths, "file").where(F.floor(F.col("width") / 4) >= F.length("text") + 2)


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, spans) from `<set>.json` files of any of the three shapes; one offset for all is one wide segment."""
    raw = spark.read.text(path, wholetext=True).withColumn("set", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    t = raw.select("set", F.from_json("value", TRUTH).alias("t"))
    whole = F.array(F.struct(F.lit(0).alias("from"), F.lit(1_000_000).alias("to"), F.col("t.offset").alias("offset")))
    seg = F.coalesce("t.segments", F.when(F.col("t.offset").isNotNull(), whole))
    segments = t.select("set", F.explode(seg).alias("s")).select("set", "s.*")
    spans = t.select("set", F.explode("t.columns").alias("file", "c")).select(
        "set", "file", F.col("c.startWord").alias("start"), F.col("c.endWord").alias("end")
    )
    return segments, spans


def submitted_readings(payloads: DataFrame, p: Profile = LATIN) -> tuple[DataFrame, DataFrame]:
    """(query_lines, rejected) from payloads (query_id, payload); works on batches and streams."""
    r = payloads.withColumn("r", F.from_json("payload", READING))
    texts = F.transform("r.lines", lambda x: x["text"])
    gap = lambda g: F.when(g.isin("full", "partial"), g).otherwise("none")
    errors = F.when(F.length("payload") > values.MAX_PAYLOAD, F.array(F.lit("too-long"))).when(
        F.col("r.lines").isNull() | F.exists(texts, lambda x: x.isNull()), F.array(F.lit("malformed"))
    )
    r = r.withColumn("errors", F.coalesce(errors, values.reading_errors(texts, p)))
    good = r.where(F.size("errors") == 0)
    claimed = F.col("r.lineCountVisible")
    visible = F.when((claimed >= 0) & (claimed < values.MAX_VISIBLE), js_round(claimed)).otherwise(F.size("r.lines")).cast("int")
    lines = good.select("query_id", visible.alias("lines_visible"), F.posexplode("r.lines").alias("line_no", "l")).select(
        "query_id",
        "lines_visible",
        "line_no",
        "l.text",
        F.coalesce("l.uncertain", F.lit(False)).alias("uncertain"),
        gap(F.col("l.gapBefore")).alias("gap_before"),
    )
    return lines, r.where(F.size("errors") > 0).select("query_id", "payload", "errors")


def write_usage(rows: DataFrame, path: str) -> None:
    """Append log rows partitioned by day, so a range of days prunes to its folders."""
    rows.write.mode("append").partitionBy("day").parquet(path)


def read_usage(spark: SparkSession, path: str, since=None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if since is None else rows.where(F.col("day") >= F.lit(since))
