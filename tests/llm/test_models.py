"""Language, quality and extraction models on held-out data, and their defined results on odd rows."""

import os

import numpy as np
import pytest

from lectern.llm import html_text, language, quality, queries

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@needs_data
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = queries.registry.queries["op2_language_id"](spark, DATA).join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the hat", "en", 3), (2, "der hund und die katze", "de", 4), (None, None, None, None), (4, "", "en", 1), (5, "12 %% 34", "de", 1), (2**60 + 1, "the end " * 20_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    net = language.train(docs)
    got = {r.doc_id: r for r in language.predict(docs.union(docs), net).collect()}
    assert set(got) == {1, 2, None, 4, 5, 2**60 + 1}
    assert [(got[i].lang_pred, got[i].score) for i in (None, 4, 5)] == [("und", 0.0)] * 3
    assert {got[1].lang_pred, got[2].lang_pred, got[2**60 + 1].lang_pred} <= {"en", "de"}
    assert language.predict(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language.train(docs.limit(0)) is None
    assert language.predict(docs.limit(0), net).count() == 0


def test_convolution_gradient():
    """The gradient of the network equals differences of its loss."""
    rng = np.random.default_rng(0)
    n = len(language.WIDTHS)
    params = [rng.normal(0, 0.5, (w, 256, language.FILTERS)) for w in language.WIDTHS] + [np.zeros(language.FILTERS) for _ in language.WIDTHS]
    params += [rng.normal(0, 0.5, (language.FILTERS * n, 2)), np.zeros(2)]
    x, _ = language.windows(["the quick brown fox", "zwei alte hunde", "so it goes"])
    y = np.array([0, 1, 0])

    def loss():
        pooled = [np.maximum(language.responses(x, t, b).max(axis=1), 0) for t, b in zip(params[:n], params[n : 2 * n])]
        return -np.log(language.softmax(np.concatenate(pooled, axis=1) @ params[-2] + params[-1])[np.arange(3), y]).mean()

    grads = language.gradients(params, x, y, np.ones(2))
    for which, at in ((0, (0, ord("t"), 3)), (0, (1, ord("h"), 0)), (n, (2,)), (2 * n, (5, 1)), (2 * n + 1, (0,))):
        old, before = params[which][at], loss()
        params[which][at] = old + 1e-6
        assert abs((loss() - before) / 1e-6 - grads[which][at]) < 1e-3
        params[which][at] = old


@needs_data
def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = queries.registry.queries["op8_quality"](spark, DATA).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95
    assert got.score[got.quality == 1].mean() > got.score[got.quality == 0].mean() + 0.5


def test_quality_of_odd_rows(spark):
    rows = [(i, ("good words in a row. " if i % 2 else "%%% ### !!! ") * (i + 1), i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None), (1, 7)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (2**60 + 1, "x" * 100_000, "c"), (1, "", "b"), (9, "a\0b", "d")], "doc_id bigint, text string, predicted string")
    got = quality.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and {r.doc_id for r in got} == {None, 1, 2**60 + 1, 9}
    assert len({r.score for r in got if r.text in (None, "")}) == 1
    assert [r.score for r in quality.score(odd, None).collect()] == [0.5] * 5
    assert quality.train(docs, labels.limit(0)) is None
    assert quality.score(odd.limit(0), model).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(1)
    p = [x.astype(np.float64) for x in quality.initial(3)]
    f, first, y = rng.normal(size=(7, quality.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        s, _ = quality.forward(p, f, first)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grads = quality.gradients(p, f, first, y, np.ones(3))
    for i, x in enumerate(p):
        at = tuple(rng.integers(0, n) for n in x.shape)
        old, before = x[at], loss()
        x[at] = old + 1e-6
        assert abs((loss() - before) / 1e-6 - grads[i][at]) < 1e-4, i
        x[at] = old


def test_marginals_equal_enumeration():
    page = html_text.parse("<div><p>one</p><section class='ad'><p>two</p></section></div><p>three")
    f = html_text.forest([page])
    rng = np.random.default_rng(2)
    w = html_text.Weights(rng.normal(size=len(html_text.TAGS) + 1), rng.normal(size=html_text.BINS), rng.normal(size=html_text.NUMBERS), rng.normal(size=(html_text.KINDS, 2, 2)))
    n, e = len(page.tag), w.evidence(f)
    total, one = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        mass = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(w.edge[f.kind[i], y[page.parent[i]], y[i]] for i in range(1, n)))
        total += mass
        one += mass * np.array(y)
    assert np.allclose(html_text.marginals(f, w)[0], one / total)


@pytest.fixture(scope="module")
def weights(spark):
    return html_text.train(spark.createDataFrame([], "page_id bigint, html string"))


def test_extraction_of_unseen_layouts(weights):
    a, b, c = "People came late to the hall, and stayed on.", "It was raining, as it had for days.", "Later that year, things improved: prices fell."
    pages = [
        f"<header><h1>Site</h1></header><nav><a href=x>a</a></nav><article><h1>T</h1><p>{a}</p><aside><p>{b}</p></aside><form><p>Sign up</p></form><div class=comments><p>{c}</p></div></article><div class=cookie-notice>{b}</div><footer>{c}</footer>",
        f"<div class=header>{a}</div><div class=content><h1>T</h1><p>{a}</p><p>{b}</p><div class=ad>{c}</div></div><div class=sidebar><p>{b}</p></div><section class=comments><p>{c}</p></section>",
        f"<article><p>{a}<p>one<br>two &amp;&nbsp;&copy; <b>{b}</b><script>var x='</p>';</script><ul><li>x<li>y</ul>tail</article>",
    ]
    got = html_text.main_texts(pages, weights)
    assert got[0] == f"T\n{a}" and got[1] == f"T\n{a}\n{b}"
    assert got[2].split("\n")[:2] == [a, f"one two & © {b}"]


def test_extraction_of_odd_rows(spark, weights):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, "u", None, 1), (2, "u", "", 2), (None, None, "</p><<>&#xD800;&bogus;", 3), (2**60 + 1, "u", "<article><p>" + "word " * 50_000, 4), (5, "u", deep, 5), (1, "u", None, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = html_text.extract(pages, weights).collect()
    assert len(got) == 6 and {r.page_id for r in got} == {1, 2, None, 2**60 + 1, 5}
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", "", ""]
    assert [len(r.text) for r in got if r.page_id == 2**60 + 1] == [249_999]
    assert html_text.extract(pages.limit(0), weights).count() == 0


@needs_data
def test_extraction_of_the_pages_equals_their_articles(spark):
    import html
    import re

    got = queries.registry.queries["op9_main_text"](spark, DATA).toPandas().set_index("page_id")
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got.text[r.page_id] == "\n".join(x for x in blocks if x)


def test_pages_without_end_tags():
    """The article is read where a head or another unseen element is left open; what is closed stays unseen."""
    read = lambda html: [body for _, body in html_text.parse(html).parts]
    body = "<article><p>One.</p><p>Two.</p></article>"
    for head in ("<title>x</title>", "<title>x</title><meta charset=utf-8><style>p{}</style><script>a<b</script>", "<noscript><img src=p>", "<noscript><link></noscript>"):
        assert read(f"<html><head>{head}<body>{body}</html>") == ["One.", "Two."], head
    assert read(f"<head><title>x</title>{body}") == ["One.", "Two."]
    assert read("<head><title>x</title> \n One. <p>Two.") == ["One.", "Two."]
    assert read(f"<head><title>x</title><script>s</script></head><body>{body}</body>") == ["One.", "Two."]
    for tag in ("svg", "object", "noscript", "template", "math", "canvas", "video"):
        assert read(f"<body><div><{tag}><path>hidden</div>{body}</body>") == ["One.", "Two."], tag
        assert read(f"<body><p>Zero.<a><{tag}>hidden</a></p>{body}</body>") == ["Zero.", "One.", "Two."], tag
        assert read(f"<body><div><{tag}><g>hidden</g><i>hidden</{tag}></div>{body}") == ["One.", "Two."], tag
    assert read(f"<body><svg><path>hidden{body}") == ["One.", "Two."]
    assert read(f"<body><svg><foreignObject><p>hidden</p></foreignObject></svg>{body}") == ["One.", "Two."]
