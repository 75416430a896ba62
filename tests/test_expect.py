"""Checks inside the write, and running sums of several levels."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus, store
from lectern.operators.expect import BuildError, Watch, write_expected
from lectern.operators.joins import prefix_sums


def facts(spark):
    return spark.createDataFrame([(1, 0, 5), (2, 3, 7), (3, None, 2), (4, 0, 1)], "doc_id int, bad_words int, n int")


def test_a_table_with_breaches_does_not_come_to_be(spark, tmp_path):
    path = f"{tmp_path}/facts"
    with pytest.raises(BuildError, match="bad_words: 2 rows, such as .2."):
        write_expected(facts(spark), path, Watch(corpus.expectations({"bad_words": 0})))
    assert os.listdir(tmp_path) == []
    good = facts(spark).where("bad_words = 0")
    report = write_expected(good, path, Watch(corpus.expectations({"bad_words": 0}), {"all": F.sum("n")}, {"all": (6, 6)}))
    assert report == {"rows": 2, "bad_words": 0, "all": 6} and spark.read.parquet(path).count() == 2
    with pytest.raises(FileExistsError):
        write_expected(good, path, Watch({}))
    assert os.listdir(tmp_path) == ["facts"]


def test_bounds_of_totals(spark, tmp_path):
    for bounds in ((None, 14), (16, None)):
        with pytest.raises(BuildError, match="all: 15"):
            write_expected(facts(spark), f"{tmp_path}/x", Watch({}, {"all": F.sum("n")}, {"all": bounds}))
    with pytest.raises(BuildError, match="all: None"):
        write_expected(facts(spark).limit(0), f"{tmp_path}/x", Watch({}, {"all": F.sum("n")}, {"all": (0, None)}))
    with pytest.raises(ValueError):
        Watch({}, within={"all": (0, None)})


def test_an_index_with_breaches_has_no_version(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some few words"), (2, "other words")], "doc_id bigint, text string")
    words = {"words": F.sum(F.size("words"))}
    short = {"long enough": F.col("doc_words") > 2}
    with pytest.raises(BuildError, match="long enough: 1 rows"):
        store.build(docs, f"{tmp_path}/i", watch=Watch(short, words))
    assert not os.path.exists(f"{tmp_path}/i/versions") and os.listdir(f"{tmp_path}/i") == []
    watch = Watch({"has words": F.col("doc_words") > 0}, words, {"words": (5, 5)})
    store.build(docs, f"{tmp_path}/i", watch=watch)
    assert watch.report() == {"rows": 2, "has words": 0, "words": 5}
    assert store.open_index(spark, f"{tmp_path}/i").vocab.count() == 4


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_running_sums_of_several_levels(spark, levels):
    rnd = random.Random(levels)
    rows = [(k, x, rnd.randrange(9)) for k in "ab" for x in rnd.sample(range(-50, 900), 120)]
    got = prefix_sums(spark.createDataFrame(rows, "k string, x bigint, v int"), ["k"], "x", {"v": "s"}, 4, levels)
    assert got.columns == ["k", "x", "v", "s"]
    assert {(r.k, r.x): r.s for r in got.collect()} == {(k, x): sum(v for j, y, v in rows if j == k and y < x) for k, x, _ in rows}
