"""Sources and sinks: tables written in each format under a fresh shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators import usage
from ..sources import io
from ..streaming.jobs import output_folder
from . import corpus_queries as C
from . import evaluate_queries as V
from . import place_queries as P
from . import sql as S
from . import tables as T
from . import usage_queries as U
from .registry import registry as R


@R.query(
    "read_pages",
    S.ctes(C.LINES, C.RAWS, C.QUEUE)
    + "SELECT doc_id, page, line, len(string_split(txt, ', ')) AS runs, txt AS text, queued AS refs, (li % 6 = 0)::INT + (li % 9 = 0)::INT AS marks, length(txt) < 60 AS petucha FROM ln JOIN queue USING (doc_id, li)",
)
def _(spark, d):
    path = output_folder(spark)
    io.write_pages(T.layout_pages(spark, d), path)
    p = io.read_page_objects(spark, path)
    return p.select(
        "doc_id",
        "page",
        "line",
        F.size(F.flatten("text")).alias("runs"),
        F.array_join(F.flatten("text"), ", ").alias("text"),
        F.size("verses").alias("refs"),
        F.size("aliyot").alias("marks"),
        F.col("isPetucha").alias("petucha"),
    )


@R.query("read_toc", P.VERSE_SQL + "SELECT doc_id, book, chapter, verse, page, line FROM verses")
def _(spark, d):
    path = output_folder(spark)
    v = T.corpus_of(spark, d).verses
    # The table of contents is one object per document by its format.
    entry = lambda k, x: F.map_from_entries(F.collect_list(F.struct(F.col(k).cast("string"), x)))
    at = F.struct(F.col("page").alias("p"), F.col("line").alias("l"))
    t = v.groupBy("doc_id", "book", "chapter").agg(entry("verse", at).alias("v"))
    t = t.groupBy("doc_id", "book").agg(entry("chapter", F.col("v")).alias("c")).groupBy("doc_id").agg(entry("book", F.col("c")).alias("toc"))
    t.write.json(path)
    return io.read_toc(spark, path)


@R.query(
    "reference_tables",
    C.FULL + "SELECT 'words' AS name, doc_id, count(*) AS n, 'abc' AS commit FROM wv GROUP BY doc_id UNION ALL SELECT 'verses', doc_id, count(*), 'abc' FROM verses GROUP BY doc_id UNION ALL SELECT 'lines', doc_id, count(*), 'abc' FROM lt GROUP BY doc_id",
)
def _(spark, d):
    path = output_folder(spark)
    c = T.corpus_of(spark, d)
    io.write_reference({"words": c.words, "verses": c.verses, "lines": c.lines}, path, "documents", "abc")
    t = io.read_reference(spark, path, ["words", "verses", "lines"])
    parts = [df.groupBy("doc_id", "commit").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(n)) for n, df in t.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("name", "doc_id", "n", "commit")


@R.query("eval_csv", f"WITH {V.RESULTS} SELECT file, status, ps AS pred_start, pe AS pred_end, CASE WHEN status = 'confident' THEN ord::INT END AS score FROM res")
def _(spark, d):
    path = output_folder(spark)
    r = V._results(spark, d).withColumn("score", F.when(F.col("status") == "confident", F.col("ord").cast("double")))
    have = {"file", "status", "pred_start", "pred_end", "score"}
    for f in io.EVAL_ROW.split(", "):
        name, kind = f.split()
        if name not in have:
            r = r.withColumn(name, F.lit(None).cast(kind))
    io.write_eval(r, path)
    return io.read_eval(spark, path).select("file", "status", "pred_start", "pred_end", F.col("score").cast("int").alias("score"))


@R.query(
    "label_tsv",
    f"""WITH l AS (SELECT doc_id, i, {S.norm('ls[i + 1]')} AS text, len(ls[i + 1]) * 5 AS width FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
    SELECT doc_id || '_' || i || '.png' AS file, text FROM l WHERE text <> '' AND width // 4 >= len(text) + 2""",
)
def _(spark, d):
    path = output_folder(spark)
    ln = T.doc_lines(spark, d).select(
        F.concat(F.col("doc_id"), F.lit("_"), F.col("li"), F.lit(".png")).alias("file"), normalize_text("line_text").alias("text"), (F.length("line_text") * 5).alias("width")
    )
    io.write_labels(ln.where("text <> ''"), path)
    return io.read_labels(spark, path, ln.select("file", "width")).select("file", "text")


@R.query(
    "truth_json",
    "SELECT 's' || r_regionkey AS set, 1 + r_regionkey * 50 AS first, 40 + r_regionkey * 50 AS last, r_regionkey % 3 AS \"offset\" FROM region",
)
def _(spark, d):
    path = output_folder(spark)
    r = F.col("r_regionkey")
    seg = F.struct((r * 50 + 1).alias("from"), (r * 50 + 40).alias("to"), (r % 3).alias("offset"))
    t = T.raw(spark, d, "region").select(F.concat(F.lit("s"), r).alias("set"), F.to_json(F.struct(F.array(seg).alias("segments"))).alias("value"))
    # The truth files are one small file per set.
    names = t.withColumn("f", F.col("set"))
    names.select("f", "value").write.partitionBy("f").text(path)
    raw = spark.read.text(path).select(F.col("f").alias("set"), F.from_json("value", io.TRUTH).alias("t"))
    return raw.select("set", F.explode("t.segments").alias("s")).select("set", F.col("s.from").alias("first"), F.col("s.to").alias("last"), "s.offset")


PAYLOAD = r"""pd AS (SELECT conv_id * 1000 + turn AS query_id, list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(lower(s), '[,.]', '', 'g'))) AS ls FROM conversations),
ok AS (SELECT * FROM pd WHERE len(ls) <= 80 AND len(list_filter(ls, lambda s: len(s) > 300 OR NOT regexp_full_match(s, '[\p{L} ?]*'))) = 0)"""


@R.query("submitted_readings", f"WITH {PAYLOAD} SELECT query_id, i AS line_no, ls[i + 1] AS text, len(ls) AS lines_visible FROM (SELECT *, unnest(range(len(ls))) AS i FROM ok)")
def _(spark, d):
    c = T.conversation_texts(spark, d)
    ls = F.transform(F.split("text", "\n"), lambda s: F.struct(F.trim(F.regexp_replace(F.lower(s), "[,.]", "")).alias("text")))
    good, _bad = io.submitted_readings(c.select("query_id", F.to_json(F.struct(ls.alias("lines"))).alias("payload")))
    return good.select("query_id", "line_no", "text", "lines_visible")


@R.query("usage_tables", f"WITH {U.SCANS} SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS scans FROM scans WHERE day >= DATE '2024-01-20' GROUP BY ALL")
def _(spark, d):
    from datetime import date

    path = output_folder(spark)
    io.write_usage(usage.record_scans(U._scans(spark, d).withColumns({"target": F.lit(""), "text": F.lit("")})), path)
    r = io.read_usage(spark, path, date(2024, 1, 20))
    return r.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("scans"))
