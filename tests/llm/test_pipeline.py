"""The pipeline against the registered queries, and its stages on odd tables."""

import pytest

import corpus_pipeline as pipeline
from lectern.llm import queries
from tests.llm.test_texts import prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, _rows int, n_lines int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two languages, copies, a near copy, recurring lines, a contaminated text, junk, nulls, repeated rows."""
    import random

    rng, out = random.Random(8), str(tmp_path_factory.mktemp("tables"))
    german = "der die und das ist nicht ein auf mit von zu haus baum strasse".split()
    en = lambda n: prose(rng, n)
    item = " ".join(f"k{chr(97 + i)}" for i in range(20))
    texts = [(en(60), "en") for _ in range(20)] + [(" ".join(rng.choice(german) for _ in range(60)), "de") for _ in range(20)]
    texts += [(texts[0][0], "en"), (texts[1][0] + " wz", "en"), (item + " " + en(30), "en"), (item + " " + en(900), "en")]
    texts += [("12 34 %%", "en"), ("", "en"), (None, None), ("Licensed for use by all\n" + en(40), "en")]
    texts += [("Licensed for use by all\n" + en(40), "en"), ("Licensed for use by all", "en")]
    rows = [(i, t, lang, f"s{i % 3}", len(t or ""), "own", 7, 3) for i, (t, lang) in enumerate(texts)]
    rows += [rows[2], rows[2], (None, en(50), None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
        ids[name] = sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i))
    assert set(range(40)) <= set(ids["language ID"])
    assert not {44, 45, 46} & set(ids["language ID"]) and ids["language ID"].count(2) == 3
    assert 49 not in ids["line dedup"] and {47, 48} <= set(ids["line dedup"])
    assert not {40, 41} & set(ids["MinHash near-dedup"]) and ids["MinHash near-dedup"].count(2) == 1
    assert 42 not in ids["benchmark decontamination"] and 43 in ids["benchmark decontamination"]
    kept = {r.doc_id: r for r in docs.collect()}
    assert kept[0].score == "own" and kept[0]._rows == 7 and kept[0].n_lines == 3
    assert kept[48].n_chars == len(kept[48].text)
    last = pipeline.run(spark, folder)
    assert {r.doc_id for r in last.collect()} == set(kept) and last.where("NOT exact").count() == 0


def test_stages_on_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_every_operator_is_registered():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.registry.queries)
    assert names == list(range(1, 14))


def test_unlike_documents_with_one_id_or_none_all_stay(spark):
    import random

    rng = random.Random(6)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d + " wz"), (8, d), (None, e), (9, e), (None, None), (None, None), (3, ""), (3, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    assert len([x for x in got if x[0] == 7 and x[1] in (d, d + " wz")]) == 1
    assert [x for x in got if x[1] not in (d, d + " wz")] == sorted([(None, a), (None, b), (7, c), (9, e), (None, None), (3, ""), (3, " ")], key=repr)
