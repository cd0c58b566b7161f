import math
import random

import pytest

from partloom.llm import decontamination as dec


def least(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        prev, row = row, [0]
        for i, p in enumerate(pattern):
            row.append(min(prev[i] + (p != c), prev[i + 1] + 1, row[i] + 1))
        best = min(best, row[-1])
    return best


def edited(rng, t, n):
    t = list(t)
    for _ in range(n):
        at = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[at] = rng.choice("abcdef ")
        elif kind == 1:
            del t[at]
        else:
            t.insert(at, rng.choice("abcdef"))
    return "".join(t)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.2])
def test_against_brute_force(spark, rate):
    rng = random.Random(int(rate * 10))
    prose = lambda n: " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(n))
    items = [(i, prose(rng.randint(8, 30))) for i in range(12)] + [(90, None), (91, ""), (92, "tiny"), (93, "ab"), (94, "c d")]
    texts = [None, "", "tiny", "tinyish", prose(40)]
    for _ in range(40):
        i, t = rng.choice(items[:12])
        m = len(t)
        texts.append(prose(rng.randint(0, 20)) + "\n" + edited(rng, t, rng.randint(0, max(1, int(m * rate * 1.5)))).upper() + "  " + prose(rng.randint(0, 20)))
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dec.leaks(docs, bench, rate).collect()}
    want = {}
    for k, t in enumerate(texts):
        for i, p in items:
            p = dec.normal(p)
            if t and p and len(p) < dec.WHOLE_WORDS and f" {p} " in f" {dec.normal(t)} ":
                want[k, i] = 0  # these texts are words and blanks only
            elif t and len(p) >= dec.WHOLE_WORDS and (d := least(p, dec.normal(t))) <= math.floor(rate * len(p)):
                want[k, i] = d
    assert got == want and len(want) > 10


def test_blocks_and_clean(spark, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_BYTES", 60)
    items = [(i, f"question number {i} asks about the {w} of things") for i, w in enumerate(["colour", "weight", "origin", "shape"])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + items[2][1], "a"), (2, "nothing of the sort", "b"), (None, items[0][1], "c"), (None, "clean", "d"), (3, None, "e")], "doc_id long, text string, k string")
    assert {(r.doc_id, r.item_id) for r in dec.leaks(docs, bench).collect()} == {(1, 2), (None, 0)}
    left = dec.clean(docs, bench)
    assert sorted(r.k for r in left.collect()) == ["b", "d", "e"] and left.columns == docs.columns
    assert dec.leaks(docs, bench.limit(0)).count() == 0 and dec.clean(docs.limit(0), bench).count() == 0


def test_clean_judges_rows_by_their_own_texts(spark):
    item = "question number one asks about the colour of things"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + item, "a"), (1, "clean", "b"), (None, item, "c"), (None, "clean too", "d"), (1, None, "e")], "doc_id long, text string, k string")
    assert sorted(r.k for r in dec.clean(docs, bench).collect()) == ["b", "d", "e"]


def test_short_items_are_whole_words():
    m = dec.Matcher([(1, "What is 2+2? Four"), (2, "yes"), (3, "(a)")], 0.1)
    assert [x[0] for x in m.leaks("so: what is  2+2? four, they say")] == [1]
    assert [x[0] for x in m.leaks("Yesterday eyes; oh yes. x(a)y")] == [2, 3] and not m.leaks("yesterday what is 2+2? fourteen")


def test_very_long_texts_repeated_rows_and_clashing_names(spark):
    item = "question number one asks about the colour of things"
    bench = spark.createDataFrame([(1, item, 7), (1, item, 8)], "item_id long, text string, distance int")
    long = "word " * 400_000 + item
    docs = spark.createDataFrame([(1, long, 1), (1, long, 1), (2, "word " * 400_000, 2)], "doc_id long, text string, distance int")
    assert [(r.doc_id, r.item_id, r.distance) for r in dec.leaks(docs, bench).collect()] == [(1, 1, 0)] * 2
    assert [r.doc_id for r in dec.clean(docs, bench).collect()] == [2]
