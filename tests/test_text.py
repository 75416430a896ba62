import random

from pyspark.sql import functions as F

from lectern.functions import text, values
from lectern.functions.distance import distance_batch, similarity_batch
from lectern.functions.profile import HEBREW


def plain_distance(a, b, pairs):
    both = set(pairs) | {p[::-1] for p in pairs}
    prev = [j * 0.8 for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [i * 0.8]
        for j, y in enumerate(b, 1):
            sub = 0 if x == y else 0.3 if "?" in (x, y) else 0.45 if x + y in both else 1.0
            row.append(min(prev[j] + 0.8, row[-1] + 0.8, prev[j - 1] + sub))
        prev = row
    return prev[-1]


def test_distance_equals_plain_recurrence():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("אבכדרהחתוז?") for _ in range(rnd.randint(0, 7)))
    a, b = [word() for _ in range(500)], [word() for _ in range(500)]
    got = distance_batch(a, b, HEBREW.confusable)
    assert all(abs(g - plain_distance(x, y, HEBREW.confusable)) < 1e-9 for g, x, y in zip(got, a, b))


def test_similarity_is_one_less_distance_per_letter():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("אבכדר?") for _ in range(rnd.randint(0, 6)))
    a, b = [word() for _ in range(300)], [word() for _ in range(300)]
    for most in (0.25, 0.5):
        for s, x, y in zip(similarity_batch(a, b, most, HEBREW.confusable), a, b):
            d, longest = plain_distance(x, y, HEBREW.confusable), max(len(x), len(y))
            want = 1.0 if longest == 0 else 0.0 if d > most * longest else max(0.0, 1 - d / longest)
            assert abs(s - want) < 1e-9, (x, y)


def test_tokens_leave_out_points_digits_and_other_scripts(spark):
    rows = {"שָׁלוֹם, עוֹלָם! יוֹם־טוֹב 5 a?": ["שלום", "עולם", "יום", "טוב", "?"], "12 ab -": [], "": []}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(text.tokenize("t", HEBREW)).collect()] == list(rows.values())


def test_days_and_labels(spark):
    df = spark.createDataFrame([("2026-02-30",), ("2026-02-28",), ("x",)], "d string")
    assert [r[0] is not None for r in df.select(values.valid_day("d")).collect()] == [False, True, False]
    lab = spark.range(1).select(values.list_label(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), values.list_label(F.array(F.lit("a"))))
    assert tuple(lab.first()) == ("a, b and c", "a")


def test_word_count_is_that_of_the_words(spark):
    """A letter whose lower case is two signs, marks in words, dashes, question marks, plain and empty text, null."""
    from pyspark.sql import functions as F

    from lectern.operators.index import corpus_word_count, corpus_words

    texts = ["aİb İ c", "x​y z", "a‐b c-d", "what?ever ?", "One two", "", "ẞ ǅ Ⅷ ⓐ", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", corpus_word_count("text").alias("n"), corpus_words("text").alias("w")).collect()
    assert [r.n for r in rows] == [None if r.w is None else len(r.w) for r in rows] == [4, 2, 4, 2, 2, 0, 2, None]
