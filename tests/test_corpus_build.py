import os

import pytest

from lectern.operators import corpus, store
from lectern.plans import tables

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id int, page int, line int, text array<array<string>>, verses array<struct<book:int,chapter:int,verse:int>>, aliyot array<map<string,string>>, isPetucha boolean"


def test_pieces_of_odd_lines(spark):
    """Several stops in a raw word, control characters in the text, empty runs, marks inside words, lines without runs."""
    texts = [[["One two. th-ree.x.y four", "", "five."]], [["a\u0001b. c\u0002d"]], [["x​y #[n. o] Z"]], [[]], [["..."]]]
    ref = [{"book": 1, "chapter": 1, "verse": n} for n in (1, 2)]
    rows = [(1, 1, n + 1, t, ref, [], True) for n, t in enumerate(texts)]
    lines = corpus.parse_lines(spark.createDataFrame(rows, SCHEMA))
    words = {n: [] for n in range(1, 6)}
    for r in corpus.flatten_words(lines).orderBy("pos").collect():
        words[r.line].append((r.word, r.run, r.pos, r.ends_before, r.gap_before))
    assert words[1] == [("one", 0, 0, 0, False), ("two", 0, 1, 0, False), ("th", 0, 2, 1, False), ("ree", 0, 3, 1, False), ("x", 0, 4, 1, False),
                        ("y", 0, 5, 1, False), ("four", 0, 6, 2, False), ("five", 2, 7, 2, True)]
    assert words[2] == [("a", 0, 8, 3, False), ("b", 0, 9, 3, False), ("c", 0, 10, 4, False), ("d", 0, 11, 4, False)]
    assert words[3] == [("xy", 0, 12, 4, False), ("z", 0, 13, 4, False)] and not words[4] and not words[5]
    counts = {r.line: (r.n_words, r.n_ends, r.offset, r.ends_offset) for r in lines.collect()}
    assert counts == {1: (8, 3, 0, 0), 2: (4, 1, 8, 3), 3: (2, 0, 12, 4), 4: (0, 0, 14, 4), 5: (0, 1, 14, 4)}
    flagged = corpus.flatten_words(lines).where("petucha_before or gap_before").select("doc_id", "pos", "petucha_before", "gap_before")
    assert sorted(map(tuple, corpus.gaps(lines).collect())) == sorted(map(tuple, flagged.collect()))
    opens = corpus.verse_opens(lines).orderBy("pos").collect()
    assert [(r.pos, r.line, r.ends_before, r.ref and r.ref.verse) for r in opens] == [(0, 1, 0, 1), (2, 1, 1, 2), (6, 1, 2, None), (8, 2, 3, 1), (10, 2, 4, 2)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_counts_and_forms_need_no_index(spark, monkeypatch):
    stored = store.build(tables.documents(spark, DATA))
    monkeypatch.setattr(tables, "_indexed", {})
    monkeypatch.setattr(store, "build", lambda *a, **k: pytest.fail("the postings were built"))
    assert tables.word_counts(spark, DATA).exceptAll(stored.doc_words()).count() == 0
    assert tables.word_counts(spark, DATA).count() == stored.doc_words().count()
    forms = tables.vocabulary(spark, DATA)
    assert forms.exceptAll(stored.vocab).count() == 0 and forms.count() == stored.vocab.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_verses_and_columns_do_not_parse_the_texts_again(spark):
    c = tables.Corpus(spark, DATA)
    for table in (c.verses, c.opens, c.columns, c.line_spans, c.sections, c.subsections):
        assert not any("documents.parquet" in f for f in table.inputFiles())


def test_verses_of_lines_are_those_of_their_words(spark):
    """Verses over several lines, several in one line, ends without words and runs that share an end count."""
    texts = [[["One two. three", "four. five"]], [["six"]], [["..."]], [["seven. x.y", "eight"]], [[]], [["nine"]]]
    rows = [(1, 1, n + 1, t, [{"book": 1, "chapter": 1, "verse": 1}], [], False) for n, t in enumerate(texts)]
    lines = corpus.parse_lines(spark.createDataFrame(rows, SCHEMA))
    opens = corpus.verse_opens(lines)
    words = corpus.flatten_words(lines.join(corpus.line_verses(lines, opens), corpus.PLACE))
    plain = corpus.flatten_words(lines).join(opens.select("doc_id", "ends_before", "verse_id"), ["doc_id", "ends_before"])
    assert sorted((r.pos, r.word, r.verse_id) for r in words.collect()) == sorted((r.pos, r.word, r.verse_id) for r in plain.collect())
    assert words.count() == 11


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_words_are_joined_as_lines(spark):
    """No join takes single words: they become rows above the last join."""
    plan = tables.Corpus(spark, DATA).words._jdf.queryExecution().optimizedPlan().toString().splitlines()
    words = next(i for i, x in enumerate(plan) if "posexplode(toks" in x)
    assert not any("Join" in x for x in plan[:words]) and any("Join" in x for x in plan[words:])
