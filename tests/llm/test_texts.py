"""Line dedup, decontamination, substring and near dedup against plain versions over small hard cases."""

import hashlib
import random
import re
import time

import pytest

from lectern.llm import decontaminate, line_templates, near_dedup, substrings

WORDS = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
SCHEMA = "doc_id bigint, text string, n_words int, _gone string, component_id int"
SPACE = re.compile("[^\x20\x09-\x0d]+")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, repeats inside a text, nulls, empty, blank, short and long texts, big ids."""
    rng = random.Random(3)
    base = prose(rng, 120)
    passage = prose(rng, 30)
    texts = [base] * 6 + [None, "", " \n\t ", "wa", "wa wb wc", "wa wb wc", "é ü ß 漢字 wa"]
    for i in range(12):
        words = base.split()
        words[rng.randrange(len(words))] = f"x{i}"
        texts.append(" ".join(words))
    texts += [prose(rng, 40) + "\n" + passage + "\t" + prose(rng, 25) for _ in range(5)]
    texts += [passage + " " + passage, "wa " * 300, "wa " * 300, base.upper(), prose(rng, 4000), "z" * 20_000]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    rows += [(None, base), (None, None), (2**60 + 1, base), (2**60 + 3, prose(rng, 50)), rows[0], rows[0]]
    return [(i, t, 5, "mine", 9) for i, t in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def order(key):
    return (key[0] is not None, key[0] or 0)


def test_substrings_equal_plain_version(spark):
    rows = corpus()
    got = substrings.drop_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows) and got[0]._gone == "mine" and got[0].component_id == 9
    hashes = {r.text: r.h for r in frame(spark, rows).selectExpr("text", "xxhash64(text) AS h").distinct().collect()}
    seen, want = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in rows}, key=lambda k: (order(k), hashes[k[1]])):
        words = SPACE.findall(t or "")
        off = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                off[k : k + 20] = [True] * 20
            seen.add(window)
        want[i, t] = (len(words), sum(off), None if t is None else " ".join(w for w, x in zip(words, off) if not x))
    texts = {(i, hashes[t]): t for i, t, *_ in rows}
    back = substrings.drop_repeats(frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) AS h")).collect()
    assert sorted(map(repr, [(r.doc_id, texts[r.doc_id, r.h], r.n_words, r.n_removed, r.text) for r in back])) == sorted(
        map(repr, [(i, t, *want[i, t]) for i, t, *_ in rows])
    )
    assert substrings.drop_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.drop_repeats(frame(spark, rows), window=5)


def test_near_dedup_equals_plain_version(spark):
    rows = corpus()
    sets = []
    for _, t, *_ in rows:
        words = SPACE.findall((t or "").translate(near_dedup.LOWER))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, *_) in zip(group, rows):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    want = [(i, len(s), least[g] if s else i, i == (least[g] if s else i)) for (i, *_), s, g in zip(rows, sets, group)]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted(map(repr, [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got])) == sorted(map(repr, want))
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_near_dedup_joins_a_large_group_of_near_copies(spark):
    """More members than a small node holds, all different, some linked only through others."""
    rng = random.Random(9)
    base = prose(rng, 300).split()
    rows = []
    for i in range(150):
        words = list(base)
        words[(2 * i) % 300] = f"y{i}"
        rows.append((i, " ".join(words), 1, "", 1))
    rows += [(1000 + i, prose(rng, 200), 1, "", 1) for i in range(150)]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.component_id for r in got if r.doc_id < 150} == {0}
    assert all(r.kept for r in got if r.doc_id >= 1000)


def test_near_dedup_finds_pairs_at_the_threshold_in_crowded_nodes(spark):
    """600 different texts with most words in common, alike at 0.755 in pairs and below 0.7 otherwise, by brute force."""
    rng, texts = random.Random(27), []
    fresh = lambda n: [f"v{rng.getrandbits(60):x}" for _ in range(n)]
    common = fresh(112)
    for _ in range(300):
        both = fresh(9)
        texts += [common + both + fresh(19) for _ in range(2)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    alike = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert alike == [(i, i + 1) for i in range(0, 600, 2)]
    got = near_dedup.near_duplicates(frame(spark, [(i, " ".join(w), 1, "", 1) for i, w in enumerate(texts)])).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.doc_id) if r.component_id != r.doc_id // 2 * 2] == []


def test_near_dedup_compares_every_pair_of_a_node_once(spark, monkeypatch):
    """Cells of several blocks give the pairs of a plain double loop."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(2)
    base = prose(rng, 60).split()
    rows = [(i, " ".join(base[: 30 + i % 9] + [f"z{rng.randrange(9)}" for _ in range(12)]), 1, "", 1) for i in range(70)]
    signed = near_dedup.signatures(frame(spark, rows), "doc_id", "text").localCheckpoint()
    docs = {bytes(r.cls): (r.n, near_dedup.unpack([r.sig])[0], i % 5) for i, r in enumerate(signed.collect())}
    labels = [(7, bytearray(c), bytearray(str(x[2]).encode()), len(docs)) for c, x in docs.items()]
    nodes = spark.createDataFrame(labels, "path bigint, cls binary, label binary, size bigint")
    got = near_dedup.crossed(nodes, signed.dropDuplicates(["cls"]), near_dedup.Link()).collect()
    want = set()
    for a, (n, s, x) in docs.items():
        for b, (m, t, y) in docs.items():
            agree = int((s == t).sum())
            if a < b and x != y and agree >= 32 and 100 * min(n, m) >= 75 * max(n, m):
                want.add((a, b, agree))
    assert len(want) > 100 and sorted((bytes(r.a), bytes(r.b), r.agree) for r in got) == sorted(want)


def test_near_dedup_cells_give_few_links_that_join_what_all_pairs_join(spark, monkeypatch):
    """A node of 90 different texts, a part of its pairs linked: fewer rows than members per cell, the components of brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    rng = random.Random(4)
    base = prose(rng, 80).split()
    rows = [(i, " ".join(base[: 60 + i % 11] + [f"z{rng.randrange(30)}" for _ in range(i % 13)]), 1, "", 1) for i in range(90)]
    signed = near_dedup.signatures(frame(spark, rows), "doc_id", "text").dropDuplicates(["cls"]).localCheckpoint()
    sets = near_dedup.full_sets(frame(spark, rows), "doc_id", "text", signed.select("cls", "_id", "_th")).localCheckpoint()
    nodes = signed.selectExpr("7 AS path", "cls", "cls AS label").crossJoin(signed.agg(near_dedup.F.count("cls").alias("size")))
    pairs = near_dedup.crossed(nodes, signed, near_dedup.Link()).select("a", "b").localCheckpoint()
    linked = near_dedup.confirmed(pairs, signed, sets, near_dedup.Link()).localCheckpoint()
    got = near_dedup.crossed(nodes, signed, near_dedup.Link(), sets).localCheckpoint()
    of = lambda edges: sorted((bytes(r.cls), bytes(r.label)) for r in near_dedup.components(edges).collect())
    assert of(got) == of(linked) and linked.count() > 1000
    assert got.count() < 6 * 64 and got.select("a", "b").subtract(linked).isEmpty()


def test_components_of_a_chain(spark):
    key = lambda n: hashlib.md5(str(n).encode()).digest()
    links = [(bytearray(key(i)), bytearray(key(i + 1))) for i in range(60)] + [(bytearray(b"x"), bytearray(b"y"))]
    got = near_dedup.components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert len(got) == 63 and len({bytes(r.label) for r in got}) == 2
    assert len({bytes(r.cls) for r in got}) == 63


def plain_hits(text, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda t: find((t or "").translate(decontaminate.LOWER))
    words, names = low(text), set()
    hit = [False] * len(words)
    for name, body in items:
        seq = low(body)
        n = min(13, len(seq))
        windows = {tuple(seq[k : k + n]) for k in range(len(seq) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in windows:
                hit[k : k + n] = [True] * n
                names.add(str(name))
    return len(words), sum(hit), sorted(names)


@pytest.mark.parametrize("block", [100_000, 25])
def test_decontamination_equals_plain_version(spark, block):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate([40, 13, 12, 5, 1, 30])] + [(7, ""), (8, None), (9, "wa WB, wc!"), (9, "wa WB, wc!")]
    texts = [t for _, t, *_ in corpus()]
    texts += [f"{prose(rng, 20)} {items[0][1][:90]} {prose(rng, 9)}", items[0][1], f"é {items[2][1].upper()}. {items[5][1]}", items[3][1] + " " + items[3][1]]
    rows = [(i, t, 5, "mine", 9) for i, t in enumerate(texts)]
    found = decontaminate.find(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), block_words=block)
    got = {r.doc_id: r for r in found.withColumn("n", decontaminate.n_hit()).withColumn("bad", decontaminate.contaminated()).collect()}
    for i, t in enumerate(texts):
        n, h, names = plain_hits(t, items)
        assert (got[i].n_words, got[i].n, got[i].item_ids) == (n, h, names), t
        assert got[i].bad == (h > 0 and 20 * h >= n) and got[i]._gone == "mine"


def test_decontamination_counts_windows_of_items_without_id(spark):
    item = " ".join(f"w{i}" for i in range(14))
    items = spark.createDataFrame([(None, item), (None, "lone words"), (7, "x " + item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, item), (2, "some lone words"), (3, "lone"), (4, "x " + item)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n, r.item_ids) for r in decontaminate.find(docs, items).withColumn("n", decontaminate.n_hit()).collect()}
    assert got == {1: (14, ["7"]), 2: (2, []), 3: (0, []), 4: (15, ["7"])}


def test_automaton_takes_one_step_per_word_on_repeats():
    seq = ["a"] * 30_000
    own = decontaminate.Automaton([("1", seq), ("2", ["a"] * 5), ("3", ["b", "a", "a"])])
    start = time.process_time()
    hit, found = own.scan(["c", *seq, "b"])
    assert hit.sum() == 30_000 and found == {"1", "2"} and time.process_time() - start < 5


def test_decontamination_without_items_and_removal_of_spans(spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    rows = [(1, "wa wb", 5, "", 9), (None, None, 5, "", 9)]
    assert {(r.n_words, len(r.item_ids)) for r in decontaminate.find(frame(spark, rows), empty).collect()} == {(2, 0), (0, 0)}
    item = " ".join(f"k{chr(97 + i)}" for i in range(14))
    long = "so it began: " + "wa " * 400 + item.upper() + ", and so on"
    found = decontaminate.find(frame(spark, [(1, long, 5, "", 9), (2, item, 5, "", 9)]), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    left = decontaminate.remove_spans(found).collect()
    assert [r.text for r in left] == ["so it began: " + "wa " * 400 + ", and so on"]


def test_recurring_lines_of_one_token_are_templates(spark):
    """Words and lines of scripts without spaces; a lone field is none, and two documents are too few."""
    lines = ["Advertisement", "\u7248\u6743\u6240\u6709\u4fdd\u7559\u6240\u6709\u6743\u5229", "page7", "own%s"]
    texts = ["\n".join(lines) % chr(97 + i) for i in range(3)] + ["twice", "twice", "  Advertisement\t"]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.drop_recurring(frame(spark, [(i, t, 5, "", 9) for i, t in enumerate(texts)])).collect()}
    assert got == {0: (texts[0], 0), 1: ("page7\nownb", 2), 2: ("page7\nownc", 2), 3: ("twice", 0), 4: ("twice", 0), 5: ("", 1)}


def test_line_templates(spark):
    """Variable fields with and without digits, lines kept once, prose that starts alike, blank and odd white space."""
    # Three of ten fields vary in the first line, which is too many for a template; one of eight in the second.
    texts = [f"user login ok from host{i} port {i} at {c} end\nlog line of {c} that is written often" for i, c in enumerate("abcd")]
    texts += [f"the old man went {a} {b} {c}" for a, b, c in (("away", "to", "sea"), ("home", "by", "night"), ("up", "the", "hill"))]
    texts += ["All rights reserved.", "x\n All\trights  reserved. \n\ny", "All rights reserved.\n\nAll rights reserved.", None, "", "\n", "word", "word", "word"]
    rows = [(i, t, 5, "mine", 9) for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in line_templates.drop_recurring(docs).collect()}
    assert [got[i].n_dropped for i in range(4)] == [0, 1, 1, 1]
    assert got[1].text == "user login ok from host1 port 1 at b end"
    assert all(got[i].n_dropped == 0 and got[i].text == texts[i] for i in (4, 5, 6))
    assert (got[7].text, got[8].text, got[9].text) == ("All rights reserved.", "x\n\ny", "")
    assert (got[9].n_lines, got[9].n_dropped) == (3, 2)
    assert (got[10].text, got[10].n_lines, got[11].text, got[12].text, got[13].text) == (None, 0, "", "\n", "word")
    assert got[8]._gone == "mine"
    again = line_templates.drop_recurring(docs.union(docs)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, list(got.values()) * 2))
    assert line_templates.drop_recurring(frame(spark, [])).count() == 0
    odd = frame(spark, [(None, "a b c 1", 1, "", 1), (5, "a b c 2", 1, "", 1), (6, "a b c 3", 1, "", 1), (7, "q" * 200_000 + "7", 1, "", 1)])
    assert sum(r.n_dropped for r in line_templates.drop_recurring(odd).collect()) == 0
