import os

import pytest

from lectern.operators import corpus, placement
from lectern.plans import place_queries, tables, text_queries
from lectern.plans.registry import registry

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id int, page int, line int, text array<array<string>>, verses array<struct<book:int,chapter:int,verse:int>>, aliyot array<map<string,string>>, isPetucha boolean"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_excerpts_over_several_lines(spark):
    """Spans over line and column ends, past the text, before it, inside a line with dashes, and on a line without words."""
    texts = [(1, 1, "One two-three"), (1, 2, "..."), (1, 3, "four"), (2, 1, "five #[x] six seven")]
    rows = [(7, page, line, [[t]], [], [], False) for page, line, t in texts]
    pages = spark.createDataFrame(rows, SCHEMA)
    spans = corpus.line_ranges(corpus.parse_lines(pages)).drop("text")
    points = spark.createDataFrame([(1, 7, 2, 4), (2, 7, 0, 1), (3, 7, 5, 99), (4, 7, -3, 0), (5, 8, 0, 3)], "q int, doc_id int, a int, b int")
    found = {r.q: (r.text, tuple(r["at"]) if r["at"] else None) for r in placement.excerpts(points, "a", "b", spans, pages, ["q"], 2).collect()}
    assert found == {
        1: ("three four five", (1, 1, False, "")),
        2: ("one two", (1, 1, True, "One two-three")),
        3: ("six seven", (2, 1, False, "six seven")),
        4: ("one", None),
    }


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_placements_turn_no_word_into_a_row(spark):
    assert "posexplode(toks" not in plan(place_queries._placed(spark, DATA))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_texts_of_targets_are_made_before_their_rows_multiply(spark):
    rows = plan(registry.queries["resolve_target"](spark, DATA)).splitlines()
    above = [rows[i - 1] for i, x in enumerate(rows) if "Join LeftOuter" in x]
    assert above and not any("date_format" in x or "array_join" in x for x in above)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_no_table_of_verses_goes_through_the_driver(spark):
    c = tables.corpus_of(spark, DATA)
    made = [corpus.verse_opens(c.lines_parsed), corpus.verse_table(c.opens, c.lines_parsed), c.subsections, registry.queries["resolve_target"](spark, DATA)]
    for df in made:
        sent = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
        # Of pages, documents and their chunks there are few.
        assert not any(k in x for x in sent for k in ("verse", "line", "chapter", "section"))


def test_slices_of_a_document_come_from_its_row(spark):
    docs = spark.createDataFrame([(1, "One two, three? four FIVE"), (2, "..."), (3, "six"), (4, None), (5, "a b c d")], "doc_id int, text string")
    got = placement.consecutive_slices(docs, 2)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "one two"), (1, 2, "three four"), (1, 3, "five"), (3, 1, "six"), (5, 1, "a b"), (5, 2, "c d")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    # The text is parsed once.
    assert plan(got).count("split(") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_a_book_is_sliced_without_the_index(spark, monkeypatch):
    monkeypatch.setattr(tables, "corpus_index", None)
    assert text_queries.R.queries["book_slice"](spark, DATA).where("n = 1").count() == 200
