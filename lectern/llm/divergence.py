"""Source divergence audit: which sources of a language use its terms differently, and which terms set a source apart.

Kept terms come from an iceberg prefix refinement. Terms are ASCII-folded runs of letters and non-ASCII characters. A pass
over the documents counts, per language, in how many documents each prefix of `LEVELS[0]` bytes occurs; prefixes below the
threshold are discarded, as no term that starts with one can reach it. The next pass extends only what is left to the next
level, and the last one counts whole terms, with their occurrences per source. Documents are never shuffled: each task
counts in bounded tables that it empties when they are full, and only (language, prefix, count) rows go over the wire.

The prefixes that go on reach the tasks as a bit map of fixed size (`BITS`) over their checksums. Two prefixes may share a
bit; then one that is below the threshold is extended, and discarded by the next count. The last count is of the terms
themselves, so the map decides what is counted and never what is kept. What is counted grows with the corpus, the map does not.

Every row is a document, so repeated rows count each; null text, language and source are read as ''. All arithmetic is exact:
decimals up to the divisions, whole numbers from there on.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import checkpoint

MIN_DOCS = 3
#: Bytes of the prefixes of each level; whole terms follow.
LEVELS = (4, 8)
BITS = 1 << 26
#: Entries of a task's tables before it sends them on, and terms whose fate it remembers.
ENTRIES, REMEMBERED = 600_000, 400_000
#: Terms and sources of one cell of the comparison of sources.
TERMS, SOURCES = 2048, 64
SCALE = 1_000_000_000

#: A-Z to a-z, other ASCII that is not a letter to a space; bytes above 127 stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def bit_map(kept: DataFrame) -> bytes:
    """One bit per kept (lang, node), gathered as at most `BITS / 64` words."""
    at = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("node"))).bitwiseAND(BITS - 1)
    placed = kept.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    words = placed.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(BITS // 64, "<i8")
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.tobytes()


class Nodes(dict):
    """Terms of one language to the node that is counted for them: their first `level` bytes, the whole term without a
    level, and nothing (b"") if the prefix of the level before was discarded. Worked out when a term is first met."""

    def __init__(self, lang: bytes, before: int | None, level: int | None, bits: bytes | None) -> None:
        self.lang, self.before, self.level, self.bits = lang, before, level, bits

    def __missing__(self, term: bytes) -> bytes:
        node = term[: self.level]
        if self.bits is not None:
            at = zlib.crc32(self.lang + b"\0" + term[: self.before]) & (8 * len(self.bits) - 1)
            if not self.bits[at >> 3] >> (at & 7) & 1:
                node = b""
        self[term] = node
        return node


class Languages:
    """The nodes of each language, of at most about `room` terms together."""

    def __init__(self, *given, room: int) -> None:
        self.given, self.room, self.nodes, self.size = given, room, {}, 0

    def of(self, lang: bytes, words: list[bytes]) -> list[bytes]:
        if self.size > self.room:
            self.nodes.clear()
            self.size = 0
        if lang not in self.nodes:
            self.nodes[lang] = Nodes(lang, *self.given)
        nodes = self.nodes[lang]
        self.size -= len(nodes)
        found = list(map(nodes.__getitem__, words))
        self.size += len(nodes)
        return found


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, bytes]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            yield from zip(*(c.cast(pa.large_binary()).to_pylist() for c in part.columns), strict=True)


def count_nodes(docs: DataFrame, before: int | None, level: int, bits: bytes | None) -> DataFrame:
    """lang, node, docs: documents per prefix of `level` bytes of the terms whose prefix of `before` bytes is in `bits`."""
    shared, room, most = docs.sparkSession.sparkContext.broadcast(bits), REMEMBERED, ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, seen, size = Languages(before, level, shared.value, room=room), defaultdict(Counter), 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                c.pop(b"", None)
                yield pa.record_batch([pa.repeat(lang.decode(), len(c)), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], schema=schema)

        schema = pa.schema([("lang", pa.string()), ("node", pa.binary()), ("docs", pa.int64())])
        for lang, _, text in rows_of(batches):
            c = seen[lang]
            size -= len(c)
            c.update(set(nodes.of(lang, terms(text))))
            size += len(c)
            if size > most:
                yield from sent()
                seen.clear()
                size = 0
        yield from sent()

    counted = docs.mapInArrow(run, "lang string, node binary, docs bigint")
    return counted.groupBy("lang", "node").agg(F.sum("docs").alias("docs"))


def count_terms(docs: DataFrame, before: int, bits: bytes) -> DataFrame:
    """lang, source, term, docs, n: documents with, and occurrences of, each whole term whose last prefix is in `bits`."""
    shared, room, most = docs.sparkSession.sparkContext.broadcast(bits), REMEMBERED, ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, seen, size = Languages(before, None, shared.value, room=room), defaultdict(lambda: (Counter(), Counter())), 0
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("n", pa.int64())])

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (having, number) in seen.items():
                having.pop(b"", None)
                found = list(having)
                same = [pa.repeat(x.decode(), len(found)) for x in (lang, source)]
                columns = [pa.array(found, pa.binary()), pa.array(list(having.values()), pa.int64()), pa.array(list(map(number.__getitem__, found)), pa.int64())]
                yield pa.record_batch([*same, *columns], schema=schema)

        for lang, source, text in rows_of(batches):
            found = nodes.of(lang, terms(text))
            having, number = seen[lang, source]
            size -= len(having)
            having.update(set(found))
            number.update(found)
            size += len(having)
            if size > most:
                yield from sent()
                seen.clear()
                size = 0
        yield from sent()

    counted = docs.mapInArrow(run, "lang string, source string, term binary, docs bigint, n bigint")
    # The tasks have added up what they could. One shuffle by term serves the counts per source and those per language.
    counted = counted.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    return counted.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, docs, n of every term that the refinement has not discarded."""
    before, bits = None, None
    for level in LEVELS:
        bits = bit_map(count_nodes(docs, before, level, bits).where(F.col("docs") >= min_docs))
        before = level
    return count_terms(docs, before, bits)


def share(count: Column, total: Column, terms_kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms_kept)), in decimals, so that no count is too large."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + terms_kept).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def between_sources(groups: DataFrame, found: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of sources of a language.

    `groups`: lang, source, absent (p of a term that the source lacks); `found`: lang, source, term, p.
    Terms and sources of a language meet in cells of at most about `TERMS` by 2 * `SOURCES`. A cell sums over the terms that
    any of its sources has; all others add one same value, which is multiplied.
    """
    numbered = groups.withColumn("no", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    numbered = checkpoint(numbered.join(langs.select("lang", "v"), "lang"))
    sides = numbered.groupBy("lang").agg(F.max("no").alias("last")).select("lang", F.floor(F.col("last") / SOURCES).alias("last"))
    numbered = numbered.join(sides, "lang").withColumn("cuts", F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)))
    side = SOURCES
    own = F.floor(F.col("no") / side)
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y")))).alias("cell")
    everyone = numbered.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("lang", "no", "absent", "cut", other, F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("p"))
    having = found.join(numbered, ["lang", "source"]).withColumn("cut", F.pmod(F.xxhash64("term"), F.col("cuts")))
    having = having.select("lang", "no", "absent", "cut", other, "term", "p")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows[rows["term"].isna()].drop_duplicates("no")
        no, absent = first["no"].to_numpy(np.int64), first["absent"].to_numpy(np.int64)
        seen = rows[rows["term"].notna()]
        where, names = pd.factorize(seen["term"])
        p = np.repeat(absent[:, None], len(names), axis=1)
        row = pd.Series(np.arange(len(no)), index=no)
        p[row[seen["no"]].to_numpy(), where] = seen["p"].to_numpy(np.int64)
        left, out = no // side == key[2], []
        for i in range(len(no)):
            # Inside one block of sources all meet, else only those of different blocks.
            with_ = np.flatnonzero(no != no[i]) if key[2] == key[3] else np.flatnonzero(left != left[i])
            d = p[i] - p[with_]
            out.append(pd.DataFrame({"lang": key[0], "a": no[i], "b": no[with_], "value": (d * d // p[with_]).sum(axis=1), "seen": len(names)}))
        return pd.concat(out)

    cells = everyone.union(having).select("lang", "no", "absent", "cut", "cell.x", "cell.y", "term", "p")
    sums = cells.groupBy("lang", "cut", "x", "y").applyInPandas(compare, "lang string, a bigint, b bigint, value bigint, seen bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    a, b = (numbered.select("lang", F.col("no").alias(c), F.col("source").alias(s), F.col("absent").alias(f"p_{c}"), *v) for c, s, v in (("a", "source", ["v"]), ("b", "item", [])))
    both = sums.join(a, ["lang", "a"]).join(b, ["lang", "b"])
    return both.select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("seen")) * distance(F.col("p_a"), F.col("p_b"))).alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one (`pair`), and the
    `top` terms it uses more than its language does (`term`), in squared differences of smoothed shares over the compared
    one's share. Ranks run per source and part, by value down, then item."""
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    of_term = W.partitionBy("lang", "term")
    found = term_counts(read, min_docs).select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("n").over(of_term).alias("in_lang"),
        F.sum("docs").over(of_term).alias("docs"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"),
    )
    found = checkpoint(found.where(F.col("docs") >= min_docs).drop("docs"))
    everywhere = read.select("lang", "source").distinct()
    langs = found.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("n_lang"))
    langs = everywhere.select("lang").distinct().join(langs, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"))
    groups = everywhere.join(found.groupBy("lang", "source").agg(F.sum("n").alias("n_source")), ["lang", "source"], "left").join(langs, "lang")
    groups = checkpoint(groups.select("lang", "source", "v", "n_lang", F.coalesce("n_source", F.lit(0)).alias("n_source")))
    # Without kept terms there is nothing to divide by, and nothing to sum.
    some = F.greatest(F.col("v"), F.lit(1))
    absent = share(F.lit(0), F.col("n_source"), some)
    shares = found.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("n_source"), F.col("v")).alias("p"), share(F.col("in_lang"), F.col("n_lang"), F.col("v")).alias("q")
    )
    pairs = between_sources(groups.select("lang", "source", absent.alias("absent")), shares.select("lang", "source", "term", "p"), langs)
    own = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part)) for x, part in ((pairs, "pair"), (own, "term"))]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
