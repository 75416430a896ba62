import random

import numpy as np
import pytest

from lectern.functions.counts import filed, gram_codes, matches, spans
from lectern.functions.distance import similarity_batch
from lectern.operators import align, bins, index, locate, store
from lectern.plans import tables

#: Documents of 300 words are cut in three segments.
SHORT = store.Layout(bucket_words=500, bucket_forms=50, word_parts=3, doc_parts=3, sample=3, segment=128, overlap=96, before=16)

SYLLABLES = ["ba", "ke", "lo", "ru", "sti", "mon", "gra", "pel", "tis", "vor"]


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3)))
    docs = [[word() for _ in range(300)] for _ in range(6)]
    docs.append(docs[0][:])  # an exact copy
    return [" ".join(x) for x in docs]


def readings(spark, queries):
    return tables.cut_lines(spark.createDataFrame(queries, "query_id bigint, text string"), "query_id")


def documents(spark, corpus):
    return spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def stored(spark, corpus):
    return store.build(documents(spark, corpus + [None, "", "? ?"]), layout=SHORT)


def test_statuses(spark, corpus, stored):
    w = corpus[3].split()
    noisy = ["?" + x[1:] if i % 7 == 0 else x for i, x in enumerate(w[40:90])]
    copy = corpus[0].split()[100:150]
    q = readings(spark, [(1, " ".join(noisy)), (2, " ".join(copy)), (3, "zzz yyy"), (4, "quux xyzzy plugh wibble wobble")])
    r = {x.query_id: x for x in locate.locate(q, stored).results.collect()}
    assert r[1].status == "confident" and r[1].best.doc_id == 3
    assert abs(r[1].best.first_word - 40) <= 1 and abs(r[1].best.last_word - 89) <= 1
    assert r[2].status == "ambiguous" and len(r[2].alternatives) >= 2
    assert r[3].status == "insufficient" and r[3].reasons == ["few-words"]
    assert r[4].status == "insufficient"


def test_index_holds_every_word_once(spark, corpus, stored):
    want = sorted((d, i, w) for d, text in enumerate(corpus) for i, w in enumerate(text.split()))
    assert sorted(map(tuple, stored.words().collect())) == want
    assert {r.doc_id: r.n_words for r in stored.doc_words().collect()} == {d: len(t.split()) for d, t in enumerate(corpus)}
    counts = {}
    for _, _, w in want:
        counts[w] = counts.get(w, 0) + 1
    assert {r.word: (r.n, r.total) for r in stored.vocab.collect()} == {w: (n, len(want)) for w, n in counts.items()}


def test_index_versions(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/index"
    first = store.build(documents(spark, corpus[:2]), path, layout=SHORT)
    second = store.build(documents(spark, corpus[:3]), path, layout=SHORT)
    # A build that did not end has tables and no row.
    half = f"{path}/v0"
    first.vocab.write.parquet(f"{half}/vocabulary")
    for name in ("postings", "grams"):  # as in a session that did not build it
        spark.sql(f"DROP TABLE {store._name(second.path, name)}")
    opened = store.open_index(spark, path)
    assert opened.path == second.path and opened.layout == SHORT
    assert opened.words().count() == 900 and opened.grams.count() == index.form_grams(second.vocab).count()
    w = opened.vocab.limit(1).select("word")
    assert opened.words(w).join(w, "word").count() == opened.words().join(w, "word").count() > 0
    assert store.open_index(spark, path, version=first.path.rsplit("/", 1)[-1]).words().count() == 600
    with pytest.raises(ValueError, match="no such version"):
        store.open_index(spark, path, version="v0")


def test_votes_and_fuzzy_pairs_equal_plain_version(spark, corpus, stored, monkeypatch):
    q = readings(spark, [(1, " ".join(corpus[2].split()[10:40])), (2, "bakelo " + " ".join(corpus[5].split()[200:280])), (3, "ba ke lo ru"), (4, "")])
    vocab, tokens, cfg = stored.vocab, locate.query_tokens(q), locate.LocateConfig(max_bins=2)
    monkeypatch.setattr(index, "GRAMS", 100)
    near = {(r.token, r.form): r.similarity for r in index.fuzzy_matches(tokens, stored.grams).collect()}
    grams = lambda w: [f"#{w}#"[i : i + 3] for i in range(len(w))]
    forms, asked = {r.word for r in vocab.collect()}, {r.token for r in tokens.collect()}
    for t in asked:
        for f in forms:
            shared = sum(grams(f).count(g) for g in grams(t))
            alike = len(t) >= 3 and t != f and abs(len(t) - len(f)) <= 2 and shared >= max(1, -(-(len(t) - 1) // 3))
            s = similarity_batch([t], [f], 0.38)[0] if alike else 0
            assert (round(s, 6) if s >= 0.62 else None) == near.get((t, f)), (t, f)
    cands = index.fuzzy_candidates(tokens, vocab, stored.grams)
    table, weights = locate.candidate_weights(tokens, cands, cfg).cache(), {}
    for r in table.collect():
        weights.setdefault(r.word, []).append((r.query_id, r.k, r.votes))
    want = {}
    for doc, text in enumerate(corpus):
        for pos, w in enumerate(text.split()):
            for query, k, votes in weights.get(w, []):
                for step in (0, -1, 1):
                    bin_ = (query, doc, (pos - k) // 4 + step)
                    want[bin_] = want.get(bin_, 0) + votes * (1 if step else 2)
    found = lambda df: {(r.query_id, r.doc_id, r.bin): round(r.score * 2 * locate.VOTE_UNIT) for r in df.collect()}
    top = lambda df: sorted(map(tuple, locate.top_bins(df, cfg).collect()))
    for limit in (bins.WEIGHTS, table.count() // 2):  # one block of readings, and several
        monkeypatch.setattr(bins, "WEIGHTS", limit)
        whole, leading = locate.vote_origins(table, stored, cfg).cache(), locate.leading_bins(table, stored, cfg).cache()
        assert found(whole) == want
        few = found(leading)
        assert all(want[b] == score for b, score in few.items()) and len(few) < 0.8 * len(want)
        assert top(leading) == top(whole)


def test_a_frequent_form_votes_only_where_it_was_read(spark):
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "query_id bigint, k int, token string")
    rows = [("a", "a", 1.0, 500, 1.0), ("a", "x", 0.7, 18, 4.0), ("b", "y", 0.7, 19, 4.0)]
    cands = spark.createDataFrame([(t, f, s, n, 1000, i) for t, f, s, n, i in rows], "token string, form string, similarity double, n bigint, total bigint, idf double")
    assert sorted(r.word for r in locate.candidate_weights(tokens, cands, locate.LocateConfig()).collect()) == ["a", "x"]


def test_votes_are_summed_without_a_shuffle(spark, corpus, stored):
    tokens = locate.query_tokens(readings(spark, [(1, " ".join(corpus[2].split()[10:40]))]))
    weights = locate.candidate_weights(tokens, index.fuzzy_candidates(tokens, stored.vocab, stored.grams), locate.LocateConfig())
    weights = spark.createDataFrame(weights.toPandas(), "query_id bigint, k int, word string, votes bigint")
    plan = bins._counts(stored.postings(weights), weights, 4, SHORT.segment)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "BroadcastHashJoin" in plan and "HashAggregate" in plan
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan


def test_too_long_a_reading_is_refused(spark, stored):
    long = spark.createDataFrame([(1, 200, "ba", 1)], "query_id bigint, k int, word string, votes bigint")
    with pytest.raises(ValueError, match="more words"):
        bins.all_bins(stored, long, 4)


def plain_align(tokens, words, min_sim=0.6):
    m, n = len(tokens), len(words)
    sim = [[1.0 if t == w else similarity_batch([t], [w], 0.4)[0] for w in words] for t in tokens]
    h = [[0.0] * (n + 1) for _ in range(m + 1)]
    back = [[0] * (n + 1) for _ in range(m + 1)]
    best = (0.0, 0, 0)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            s = sim[i - 1][j - 1]
            pair = s * 2 - 1 + (0.3 if len(tokens[i - 1]) >= 4 else 0) if s >= min_sim else -1.0
            v, t = 0.0, 0
            for c, k in ((h[i - 1][j - 1] + pair, 1), (h[i - 1][j] - 0.6, 2), (h[i][j - 1] - 0.6, 3)):
                if c > v:
                    v, t = c, k
            h[i][j], back[i][j] = v, t
            if v > best[0]:
                best = (v, i, j)
    score, i, j = best
    hits = []
    while i and j and back[i][j]:
        t = back[i][j]
        if t == 1 and sim[i - 1][j - 1] >= min_sim:
            hits.append((i - 1, j - 1))
        i, j = (i - 1, j - 1) if t == 1 else (i - 1, j) if t == 2 else (i, j - 1)
    return score, hits[::-1]


def test_alignment_equals_plain_traceback():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5)))
    ts = [[word() for _ in range(rnd.randint(1, 9))] for _ in range(60)]
    ws = [[word() for _ in range(rnd.randint(1, 14))] for _ in range(60)]
    for (score, path), t, w in zip(align.align_paths(ts, ws, 0.6, ()), ts, ws):
        want, hits = plain_align(t, w)
        assert abs(score - want) < 1e-9
        assert [(i, j) for i, j, ok in path if ok] == hits


def test_top_bins_suppress_neighbors(spark):
    rows = [(1, 0, b, float(s)) for b, s in [(10, 9), (11, 8), (12, 8), (13, 7), (40, 3)]] + [(1, 1, 11, 9.0)]
    b = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, bin bigint, score double")
    got = [(r.doc_id, r.bin) for r in locate.top_bins(b, locate.LocateConfig()).orderBy("rank").collect()]
    assert got == [(0, 10), (1, 11), (0, 13), (0, 40)]


def test_line_numbers_may_have_gaps(spark):
    q = spark.createDataFrame([(1, 7, "ba ke"), (1, 12, "lo")], "query_id bigint, line_no int, text string")
    assert [(r.k, r.line_no) for r in locate.query_tokens(q).orderBy("k").collect()] == [(0, 0), (1, 0), (2, 1)]


def test_leading_bins_need_no_postings_and_cut_ties_by_document(spark, corpus, stored, monkeypatch):
    """Pieces of a few bins, tasks that sort often, exact copies of a document: the best bins are those of the whole count."""
    docs = documents(spark, corpus + [corpus[0]] * 40)
    built = store.build(docs, layout=SHORT, lookup=False)
    with pytest.raises(Exception, match="(?i)not.found"):
        built.postings()
    tokens, cfg = locate.query_tokens(readings(spark, [(7, " ".join(corpus[0].split()[120:190])), (-2, "ba")])), locate.LocateConfig()
    weights = locate.candidate_weights(tokens, index.fuzzy_candidates(tokens, built.vocab), cfg).cache()
    whole = locate.vote_origins(weights, store.build(docs, layout=SHORT), cfg)
    want = sorted(map(tuple, locate.top_bins(whole, cfg).collect()))
    for piece, rows, cells in ((bins.PIECE, bins.ROWS, bins.CELLS), (2, 0, 8)):
        for name, value in (("PIECE", piece), ("ROWS", rows), ("CELLS", cells)):
            monkeypatch.setattr(bins, name, value)
        leading = locate.leading_bins(weights, built, cfg)
        assert sorted(map(tuple, locate.top_bins(leading, cfg).collect())) == want
        assert leading.count() <= leading.rdd.getNumPartitions() * 2 * cfg.bins_to_rank


def test_vote_totals_need_no_postings(spark, corpus, stored, monkeypatch):
    """Documents of several segments and of several pieces have one row; their totals are those of the bins."""
    docs = documents(spark, corpus)
    built = store.build(docs, layout=SHORT, lookup=False)
    tokens, cfg = locate.query_tokens(readings(spark, [(7, " ".join(corpus[0].split()[120:190])), (-2, "ba")])), locate.LocateConfig()
    weights = locate.candidate_weights(tokens, index.fuzzy_candidates(tokens, built.vocab), cfg).cache()
    want = {}
    for r in locate.vote_origins(weights, store.build(docs, layout=SHORT), cfg).collect():
        want.setdefault((r.query_id, r.doc_id), []).append(round(r.score * 2 * locate.VOTE_UNIT))
    want = sorted((*k, len(v), sum(v), max(v)) for k, v in want.items())
    for piece, cells in ((bins.PIECE, bins.CELLS), (2, 8)):
        monkeypatch.setattr(bins, "PIECE", piece)
        monkeypatch.setattr(bins, "CELLS", cells)
        assert sorted(map(tuple, locate.vote_totals(weights, built, cfg).collect())) == want


def test_counted_matches():
    order, first = filed(np.array([2, 0, 2, 1]), 4)
    by, entry = matches(np.array([2, 3, 0]), first)
    assert by.tolist() == [0, 0, 2] and order[entry].tolist() == [0, 2, 1]
    assert list(spans(np.array([3, 3, 9, 1]), 6)) == [(0, 2), (2, 3), (3, 4)]
    codes, of = gram_codes(["ab", "é"])
    assert of.tolist() == [0, 0, 1] and [(int(c) >> 42, int(c) >> 21 & 0x1FFFFF, int(c) & 0x1FFFFF) for c in codes] == [(35, 97, 98), (97, 98, 35), (35, 233, 35)]
