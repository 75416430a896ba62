"""Periodic runs, nearest neighbours and source divergence against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import divergence, periodic_runs, queries, vector_tree

SPACE = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words):
    found = []
    for q in range(1, len(words) // periodic_runs.MIN_EXPONENT + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            smaller = any(all(stretch[x] == stretch[x + r] for x in range(length - r)) for r in range(1, q))
            if length >= max(periodic_runs.MIN_LENGTH, periodic_runs.MIN_EXPONENT * q) and not smaller:
                found.append((i, length, q))
            i = max(j, i + 1)
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    return sorted(found, key=lambda r: (r[0], r[2])), " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a " * 2000, "b b b b b c b b b b b b", "é\x0bé\x0cé é é é \xa0 \xa0"]
    for letters in ("ab", "abc", "abcdefghijklmnop"):
        for _ in range(60):
            words = []
            while len(words) < rng.choice([5, 40, 150]):
                period = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 13]))]
                words += (period * rng.randint(1, 6))[: rng.randint(1, 60)]
            texts.append(" ".join(words))
    return texts + [" ".join(f"w{i % 1500}" for i in range(7000)), texts[-1]]


def test_runs_equal_plain_version(spark):
    rows = [(i if i % 9 else None, t, "own", 3) for i, t in enumerate(periodic_texts())]
    got = periodic_runs.find(spark.createDataFrame(rows, "doc_id bigint, text string, runs string, _x int")).collect()
    assert len(got) == len(rows)
    for (i, text, _, x), r in zip(rows, got, strict=True):
        words = SPACE.findall(text or "")
        assert (r.doc_id, r.text, r["_x"], r.n_words) == (i, text, x, len(words))
        runs, kept = plain_runs(words) if len(words) < 1000 else (None, None)
        if runs is not None:
            assert [tuple(x) for x in r.runs] == runs and r.collapsed == kept
    assert [tuple(x) for x in got[6].runs] == [(0, 2000, 1)] and got[6].collapsed == "a"
    assert [tuple(x) for x in got[-2].runs] == [(0, 7000, 1500)] and len(got[-2].collapsed.split()) == 1500
    assert periodic_runs.find(spark.createDataFrame([], "text string")).count() == 0


def test_one_long_text_is_not_quadratic():
    words = " ".join(["x"] * 300_000 + ["a", "b"] * 100_000).encode()
    assert [r for _, runs in periodic_runs.runs_of([words]) for r in runs] == [(0, 300_000, 1), (300_000, 200_000, 2)]


def test_planted_runs_follow_the_contract(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 3, 50])))) for i in range(400)] + [(None, "a b"), (7, None)]
    got = queries.with_planted_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    changed = 0
    for (i, text), r in zip(rows, got, strict=True):
        words = SPACE.findall(text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if x < a else words[a + (x - a) % p] for x, w in enumerate(words)]
            changed += 1
        assert SPACE.findall(r.text or "") == words
    assert changed > 20


def plain_nearest(rows, asked, k):
    out = {}
    for q, x in asked:
        scored = [(-float((np.array(x, float) * np.array(y, float)).sum()), v is None, v or 0) for v, y in rows if (v != q) and len(y) == len(x)]
        out[q, tuple(x)] = [(None if none else v, -s) for s, none, v in sorted(scored)[:k]]
    return out


SMALL = vector_tree.Settings(sample=500, branching=3, leaf=12, probes=60, recall=0.97)


def test_neighbours_reach_recall_and_rank_exactly(spark, monkeypatch):
    monkeypatch.setattr(vector_tree, "CANDIDATES", 40)
    monkeypatch.setattr(vector_tree, "QUERIES", 9)
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 1, (12, 10))
    x = (centers[rng.integers(0, 12, 900)] + rng.normal(0, 0.3, (900, 10))).astype(np.float32)
    x[:250] = x[0]  # a group of copies: many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[3].tolist()), (901, x[5].tolist() + [1.0]), (903, [1.0]), (904, [2.0])]
    odd = [(910, None), (911, []), (912, [0.0] * 10), (913, [float("nan")] * 10), (914, [None] + [1.0] * 9), (915, [float("inf")] * 10)]
    df = spark.createDataFrame([(i, v, "own") for i, v in rows + odd], "vec_id bigint, embedding array<float>, leaf string")
    got = vector_tree.neighbours(df, df.where("vec_id % 3 = 0"), 10, vector="embedding", settings=SMALL)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    asked = [(i, v) for i, v in rows if i is not None and i % 3 == 0]
    true = plain_nearest(rows, asked, 10)
    assert set(found) == {i for i, _ in asked}
    hits = total = 0
    for (q, _), want in true.items():
        scores = {v: s for v, s in want}
        hits += len(scores.keys() & {v for v, _ in found[q]})
        total += len(want)
        assert all(abs(s - scores[v]) < 1e-12 for v, s in found[q] if v in scores)
        assert found[q] == sorted(found[q], key=lambda p: (-p[1], p[0] is None, p[0] or 0))
    assert hits / total >= 0.95
    assert found[0] == true[0, tuple(rows[0][1])]  # ties by the smaller id, whole
    assert [v for v, _ in found[903]] == [904]


def test_all_leaves_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.integers(-3, 4, (200, 4)).astype(float).tolist()) if any(v)]
    df = spark.createDataFrame(rows + rows[:5], "vec_id bigint, vector array<double>")
    got = vector_tree.neighbours(df, df.where("vec_id < 20"), 7, settings=vector_tree.Settings(500, 3, 12, 60, 1.0))
    true = plain_nearest(rows + rows[:5], [r for r in rows if r[0] < 20], 7)
    found = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert sum(found[q] == want for (q, _), want in true.items()) >= 0.95 * len(true)
    empty = df.limit(0)
    assert vector_tree.neighbours(empty, empty, 3).count() == 0
    assert vector_tree.neighbours(df, empty, 3).count() == 0


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = queries.nearest_neighbours(spark, "/root/testdata/sf0.1").toPandas()
    p = rows.toPandas()
    x, ids = np.stack(p["embedding"]).astype(float), p["vec_id"].to_numpy()
    hits, asked = 0, np.flatnonzero(ids % 20 == 0)
    for i in asked:
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(got[got["query_id"] == ids[i]]["vec_id"]))
    assert len(got) == 20 * len(asked) and hits / len(got) >= 0.92


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_audit(rows, top=200):
    docs = [(a or "", b or "", TERM.findall(lower(c or ""))) for a, b, c in rows]
    out = []
    for lang in {d[0] for d in docs}:
        having, count = Counter(), defaultdict(Counter)
        for a, b, c in docs:
            if a == lang:
                having.update(set(c))
                count[b].update(c)
        kept = sorted(t for t, n in having.items() if n >= 3)
        total = Counter()
        for c in count.values():
            total.update({t: c[t] for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        own, q = {b: share(c) for b, c in count.items()}, share(total)
        for b, p in own.items():
            parts = {
                "pair": [(sum((p[t] - r[t]) ** 2 // r[t] for t in kept), o) for o, r in own.items() if o != b],
                "term": [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if count[b][t] and p[t] > q[t]],
            }
            for part, found in parts.items():
                found = sorted(found, key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, b, part, item, v, n) for n, (v, item) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


@pytest.mark.parametrize("cell", [(2048, 64), (3, 2)])
def test_audit_equals_plain_version(spark, monkeypatch, cell):
    monkeypatch.setattr(divergence, "TERMS", cell[0])
    monkeypatch.setattr(divergence, "SOURCES", cell[1])
    monkeypatch.setattr(divergence, "ENTRIES", 30)
    monkeypatch.setattr(divergence, "REMEMBERED", 20)
    monkeypatch.setattr(divergence, "BITS", 64)  # nearly every prefix shares its bit: the counts decide all the same
    rng = random.Random(8)
    words = ["Haus", "HAUS", "haus", "Straße", "straßenbahnhaltestellenschild", "straßenbahnhaltestellenplan", "é", "É", "漢字", "a", "ab", "abc", "abcd", "x1y", "it's"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words[: rng.choice([4, 15])]) for _ in range(rng.randint(0, 12))) + rng.choice(["", f" rare{i}", "\tİ ſ"])
        rows.append((rng.choice(["de", "en"]), rng.choice(["s0", "s0", "s1", "ß", "s3", "s4"]), text))
    rows += [("de", "none", None), ("fr", "only", "a b"), ("fr", "other", None), (None, None, "null null"), (None, "s", "null"), (None, "s", "null"), ("zh", "s0", "漢字 " * 30)]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "lang string, source string, text string, term string, p string")
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_refinement_discards_rare_prefixes(spark):
    """Rows counted at each level: what has a rare prefix is not extended."""
    docs = spark.createDataFrame([("en", "s", f"common {'qz' + chr(97 + i) * 9}") for i in range(20)], "lang string, source string, text string")
    first = divergence.count_nodes(docs, None, 2, None)
    assert {bytes(r.node): r.docs for r in first.collect()} == {b"co": 20, b"qz": 20}
    second = divergence.count_nodes(docs, 2, 4, divergence.bit_map(first))
    assert second.count() == 21
    third = divergence.count_terms(docs, 4, divergence.bit_map(second.where(F.col("docs") >= 3)))
    assert [r.term for r in third.collect()] == ["common"]


def test_counts_beyond_64_bits_divide_exactly(spark):
    big = 10**15
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(7 * big), F.lit(3)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 1) // (7 * big + 3)
