"""URL rules, exact top-k and sampled segmentations."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import segmentations, top_k, url_rules


def test_urls(spark):
    cases = {
        "http://a.example.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://EXAMPLE.org/en/1234?x=/es/": ("example.org", "/en/1234", "example.org/en/1", "block"),
        "http://example.org/en/2#/es/": ("example.org", "/en/2", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://casino-x.com/fr/": ("casino-x.com", "/fr/", "com/fr/", "allow"),
        "http://www.casino-x.com/en/": ("www.casino-x.com", "/en/", None, "block"),
        "http://com/de/": ("com", "/de/", "com/de/", "block"),
        "http://notcom/de/": ("notcom", "/de/", None, "allow"),
        "http://a.net/user/login": ("a.net", "/user/login", None, "block"),
        "a.org/es/": ("", "", None, "allow"),
        "x://y://z/": ("y:", "//z/", None, "allow"),
        "": ("", "", None, "allow"),
        "http://é.ORG/\nq": ("é.org", "/\nq", "org/", "allow"),
        "http://org/" + "a" * 100_000: ("org", "/" + "a" * 100_000, "org/", "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "own", "own") for i, u in enumerate(cases)] + [(None, "http://com/de/", "", "")] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string, _token string")
    got = url_rules.judge(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url], r.url
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([("org",)] * 5 + [("example",)] * 3 + [("es",)], "_token string")
    table = url_rules.rule_table(spark, url_rules.PLACES)
    filed = {r["name"]: r["_token"] for r in url_rules.rule_index(tokens, table).collect()}
    assert filed["example.org/es/"] == "es" and filed["org/"] == "org" and filed["example.org/en/1"] == "en"


def plain_top(rows, k):
    out = []
    for q, x in {(q, tuple(x)) for q, x in rows if q is not None and q % 3 == 0}:
        scored = [(-sum(a * b for a, b in zip(x, y)), v is None, v or 0) for v, y in rows if v != q and len(y) == len(x)]
        out += [(q, r, None if none else v, -s) for r, (s, none, v) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("low,high", [(-1024, 1024), (-1, 1), (0, 0), (-(2**28), 2**28)])
def test_top_k_equals_plain_version(spark, monkeypatch, low, high):
    """Several blocks, many ties, repeated rows, null ids and values above what a double holds exactly."""
    monkeypatch.setattr(top_k, "CANDIDATES", 150)
    monkeypatch.setattr(top_k, "QUERIES", 60)
    rng = random.Random(5)
    rows = [(i, [rng.randint(low, high) for _ in range(6)]) for i in range(400)] + [(None, [high] * 6), (7, [1, 2]), (9, [3, 4])]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = top_k.top_k(df, df.where("vec_id % 3 = 0"), 4).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_top(rows, 4)


def test_top_k_of_odd_rows(spark):
    rows = [(100, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [-0.0001, 0.25])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<float>").where(top_k.usable(top_k.F.col("v")))
    whole = df.select("vec_id", top_k.whole_numbers(top_k.F.col("v")).alias("vector"))
    assert {r.vec_id: r.vector for r in whole.collect()} == {100: [1024, 512], 7: [-1, 256]}
    got = top_k.top_k(whole, whole.where("vec_id = 100"), 10).collect()
    assert [tuple(r) for r in got] == [(100, 1, 7, -1024 + 512 * 256)]
    assert top_k.top_k(whole, whole.limit(0), 10).count() == 0


MODEL = segmentations.MODEL
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")


@pytest.fixture(scope="module")
def vocab():
    pytest.importorskip("sentencepiece")
    return segmentations.Vocabulary.load(MODEL)


def paths(vocab, word):
    lat = segmentations.lattice([word], vocab, 1.0)
    out = {}

    def go(at, ids, p):
        if at == len(word):
            out[tuple(ids)] = p
            return
        for e in range(lat.first[at], lat.first[at + 1]):
            go(int(lat.end[e]), [*ids, int(lat.ids[e])], p * math.exp(lat.logp[e]))

    go(0, [], 1.0)
    return out


@needs_model
def test_samples_follow_the_lattice(vocab):
    """First samples have the paths' probabilities, pairs those of drawing without replacement, and inclusion is unbiased."""
    p = paths(vocab, " the")
    assert abs(sum(p.values()) - 1) < 1e-9
    weight = lambda ids: math.prod((10 + vocab.rank[i]) ** -1.0 for i in ids)
    total = sum(map(weight, p))
    assert all(abs(p[x] - weight(x) / total) < 1e-9 for x in p)
    n = 20_000
    got = segmentations.sample_all(["the"] * n, segmentations.mix64(np.arange(n, dtype=np.uint64) + np.uint64(99)), segmentations.Lattices(vocab, 1.0), 3)
    first = Counter(tuple(r[0][0].tolist()) for r in got)
    pairs = Counter((tuple(r[0][0].tolist()), tuple(r[1][0].tolist())) for r in got)
    assert max(abs(first[x] / n - p[x]) for x in p) < 0.015
    assert max(abs(pairs[x, y] / n - p[x] * p[y] / (1 - p[x])) for x in p for y in p if x != y) < 0.015
    assert all(len({tuple(s[0].tolist()) for s in r}) == 3 for r in got)
    length = sum(q * len(x) for x, q in p.items())
    assert abs(np.mean([sum(math.exp(lp) / inc * len(ids) for ids, lp, inc in r) for r in got]) - length) < 0.01


@needs_model
def test_segmentations_round_trip(spark, vocab):
    texts = ["the cat sat", "", None, " two  spaces\n\nand\ttabs ", "▁mark▁ and 漢字 𝔘 é\0", "x" * 5000, "a", "the cat sat"]
    rows = [(i, t, "own") for i, t in enumerate(texts)] + [(None, "the cat", "own"), (2**60 + 1, "the cat", "own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rank string")
    got = segmentations.encode(docs, 3).collect()
    assert segmentations.encode(docs.repartition(7), 3).exceptAll(spark.createDataFrame(got, segmentations.encode(docs, 3).schema)).count() == 0
    whole = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.exact is (None if whole[r.doc_id] is None else True)
        assert r.ids is None or vocab.decode(np.array(r.ids, dtype=np.int64)) == whole[r.doc_id]
    by = Counter(r.doc_id for r in got)
    assert by[0] == 3 and by[1] == 1 and by[2] == 1 and by[2**60 + 1] == 3
    assert len({tuple(r.ids) for r in got if r.doc_id == 0}) == 3
    back = segmentations.decode(segmentations.encode(docs.where("doc_id = 3"), 2)).collect()
    assert {r.text for r in back} == {texts[3]}
    assert segmentations.encode(docs.limit(0)).count() == 0


@needs_model
def test_runs_of_spaces_have_all_their_pieces(vocab):
    """The paths over runs of spaces and carriage returns, enumerated from the model's own pieces, are the lattice's."""
    pieces = {vocab.surfaces[i]: i for i in range(len(vocab.surfaces)) if vocab.surfaces[i] and i not in set(vocab.byte_ids.tolist())}
    for text in ("    if", "      ", "a   b", "x;\r", "a  \n    b"):
        want = {}

        def go(rest, ids, p):
            if not rest:
                want[tuple(ids)] = p
            for n in range(1, len(rest) + 1):
                i = pieces.get(rest[:n])
                if i is None and n == 1:
                    i = int(vocab.byte_ids[rest[0]])
                if i is not None:
                    go(rest[n:], [*ids, i], p / (10 + vocab.rank[i]))

        go(b" " + text.encode(), [], 1.0)
        got = {(): 1.0}
        for word in segmentations.WORD.findall(" " + text):
            got = {(*a, *b): p * q for a, p in got.items() for b, q in paths(vocab, word).items()}
        total = sum(want.values())
        assert set(got) == set(want), text
        assert all(abs(got[x] - want[x] / total) < 1e-9 for x in want), text


@needs_model
def test_inclusion_of_a_long_text(spark, vocab):
    rows = [(1, "the cat sat on the mat " * 2000), (2, "the cat"), (3, "")]
    got = segmentations.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert all(r.exact and math.isfinite(r.log_inclusion) and r.log_inclusion <= 0 and abs(math.exp(r.log_inclusion) - r.inclusion) < 1e-12 for r in got)
    long = [r for r in got if r.doc_id == 1]
    assert len(long) == 2 and all(r.log_prob < -1000 and abs(r.log_inclusion - r.log_prob) < 50 for r in long)
    assert [r.log_inclusion for r in got if r.doc_id == 3] == [0.0]
