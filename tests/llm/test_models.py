"""Language identification, quality ranking and the class model: held-out accuracy, and counts against plain ones."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import class_lm, language_id, quality_ranker

PARTS = {"aa": "the and with ing er th of".split(), "bb": "der die und sch ung ein".split(), "cc": "que los ción ado por ez".split()}


def prose(rng, kind, n):
    return " ".join("".join(rng.choice(PARTS[kind]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, k, rng.randint(3, 60)), k, 0.5) for i, k in enumerate(sorted(PARTS) * 60)]
    rows += [(900, None, "aa", 0.1), (901, "", "aa", 0.1), (902, "123 456!", None, 0.1), (903, prose(rng, "bb", 3000), None, 0.1), (0, rows[0][1], "aa", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs.where("doc_id % 4 <> 1 or doc_id >= 900"))).collect()}
    assert len(out) == len(rows) - 1
    held = [(r[0], r[2]) for r in rows[:180] if r[0] % 4 == 1]
    assert np.mean([out[i].lang_pred == k for i, k in held]) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902)) and out[903].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in out.values())
    none = language_id.predict(docs, language_id.fit(docs.where("lang is null").limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"} and language_id.predict(docs.limit(0), language_id.fit(docs)).count() == 0


def test_language_id_is_multinomial_bayes(spark):
    rows = [(0, "ab", "x"), (1, "abab", "x"), (2, "cd", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(docs, bits=10, alpha=1.0)
    want = np.ones((1 << 10, 2))
    for _, t, k in rows:
        np.add.at(want[:, "xy".index(k)], language_id.buckets(t, 10, (1, 2, 3)), 1)
    assert np.allclose(m.logp, np.log(want / want.sum(0)), atol=1e-5) and np.allclose(np.exp(m.prior), [2 / 3, 1 / 3])


def test_quality_ranker(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        good = rng.random() < 0.8
        t = prose(rng, rng.choice(sorted(PARTS)), rng.randint(5, 80))
        rows.append((i, t.capitalize() + "." if good else t.upper().replace(" ", "!! ") if i % 2 else t.replace(" ", "*** ")))
        marks.append((i, int(good), 7))
    rows += [(900, None), (901, "")]
    marks += [(901, None, 0), (None, 1, 0), (5, marks[5][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("good", F.lit("clash"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality_ranker.fit(docs, labels, train=F.col("doc_id") % 3 != 1)
    out = {r.doc_id: r for r in quality_ranker.score(docs, model).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert np.mean([out[i].predicted == marks[i][1] for i in held]) > 0.95
    assert out[900].score == out[901].score and all(0 <= r.score <= 1 for r in out.values())
    flat = quality_ranker.fit(docs, labels.limit(0), train=F.lit(True))
    assert {r.score for r in quality_ranker.score(docs, flat).collect()} == {0.5}


def test_pairs_are_bradley_terry():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    good = rng.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))
    m = quality_ranker.fit_pairs(x, good, pairs=5000)
    s = x @ m.weights
    assert m.weights[0] > 0 > m.weights[1] and abs(m.weights[2]) < abs(m.weights[1])
    up, down = s[good], s[~good]
    assert (up[:, None] > down[None, :]).mean() > 0.75
    assert (s < m.cut).mean() == pytest.approx((~good).mean(), abs=0.02)


def test_class_model_counts(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice(sorted(PARTS)), rng.randint(0, 40)).title(), "n") for i in range(80)] + [(500, None, "n"), (501, "", "n"), (502, "unheard Words only", "n"), (3, "same id", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts = Counter()
    for r in train:
        counts.update((r[1] or "").lower().split())
        counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    settings = class_lm.Settings(top_words=30, classes=5, known_words=60)
    model = class_lm.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2), settings=settings)
    got = class_lm.score(docs, model).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in rows:
        w = [*(t or "").lower().split(), None]
        want.setdefault(i, []).append((len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    for r in got:
        assert any((r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.base_score == pytest.approx(w[3]) for w in want[r.doc_id])
        assert r.score < 0
    assert class_lm.score(docs.limit(0), model).count() == 0


def all_words(model):
    """Count and class of every training word."""
    found = {w: (int(model.counts[k]), int(model.kinds[k])) for w, k in model.ids.items()}
    return found | {bytes(r.w): (r.n, r.c) for r in model.rest.collect()}


def test_class_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b a", "a a b d e", "", "c d a"])], "doc_id long, text string")
    model = class_lm.fit(docs, settings=class_lm.Settings(top_words=3, classes=2, known_words=4))
    assert np.allclose((10**model.step).sum(1), 1)
    emit = np.zeros(len(model.below))
    words = all_words(model)
    assert {w.decode(): n for w, (n, _) in words.items()} == {"a": 6, "b": 3, "c": 2, "d": 2, "e": 1} and model.unseen not in {c for _, c in words.values()}
    for n, c in words.values():
        emit[c] += (n + 1) / 10 ** model.below[c]
    emit[model.unseen] += 1 / 10 ** model.below[model.unseen]
    emit[model.end] += (model.ends + 1) / 10 ** model.below[model.end]
    assert np.allclose(emit, 1)


@pytest.mark.parametrize("known", [0, 25, 1000])
def test_class_model_against_brute_force(spark, monkeypatch, known):
    """Given the classes, steps and scores follow from plain counts; each word outside the exchange has the class of greatest gain."""
    monkeypatch.setattr(class_lm, "HELD", 7)
    monkeypatch.setattr(class_lm, "TOGETHER", 5)
    rng = random.Random(known)
    texts = [None, ""] + [" ".join(f"w{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(rng.randint(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    model = class_lm.fit(docs.where("doc_id < 40"), settings=class_lm.Settings(top_words=10, classes=4, known_words=known))
    words, size = all_words(model), len(model.below)
    runs = [[*((words.get(w, (0, model.unseen))) for w in class_lm.tokens(t)), (40, model.end)] for t in texts]
    pairs = np.zeros((size, size))
    for run in runs[:40]:
        for x, y in zip([(0, model.end), *run], run):
            pairs[x[1], y[1]] += 1
    assert np.allclose(model.step, np.log10((pairs + 1) / (pairs.sum(1, keepdims=True) + size)))
    for r in class_lm.score(docs, model).collect():
        run = runs[r.doc_id]
        want = sum(model.step[x[1], y[1]] + np.log10(y[0] + 1) - model.below[y[1]] for x, y in zip([(0, model.end), *run], run))
        assert r.score == pytest.approx(want) and r.n_known == sum(n > 0 for n, _ in run)


def test_words_beside_the_exchange_take_the_class_of_greatest_gain(spark):
    pairs = np.array([[1, 9, 2, 3], [8, 0, 1, 2], [3, 2, 0, 1], [5, 4, 1, 0]], float)
    rows = [(5, [0 * 4 + 1, 1 * 4 + 0], [3, 1]), (6, [2 * 4 + 2], [2]), (7, [3 * 4 + 3, 1 * 4 + 1, 0], [1, 1, 5])]
    got = {r.w: (r.n, r.c) for r in class_lm.placed(spark.createDataFrame(rows, "w long, codes array<long>, ns array<long>"), pairs, "long").where("w is not null").collect()}
    row, col = pairs.sum(1) + 4, pairs.sum(0) + 4
    for w, codes, ns in rows:
        gain = [sum(n * (np.log((pairs[x // 4, k] + 1) / row[x // 4] / col[k]) + np.log((pairs[k, x % 4] + 1) / row[k] / col[x % 4])) for x, n in zip(codes, ns)) for k in range(2)]
        assert got[w] == (sum(ns), int(np.argmax(gain)))


def test_very_long_texts_in_models(spark):
    long = "aa bb cc " * 300_000
    docs = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, "aa bb", "y")], "doc_id long, text string, lang string")
    out = class_lm.score(docs, class_lm.fit(docs, settings=class_lm.Settings(top_words=2, classes=2, known_words=2))).collect()
    assert sorted(r.n_tokens for r in out) == [3, 900_001, 900_001]
    assert language_id.predict(docs, language_id.fit(docs)).count() == 3
    assert quality_ranker.score(docs, quality_ranker.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), F.lit(True))).count() == 3


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 3, 30)
    pull = np.where(kind[:, None] == (kind[None, :] + 1) % 3, 8.0, 0.2)
    bigrams = np.zeros((32, 32))
    bigrams[:30, :30] = rng.poisson(pull)
    of = class_lm.exchange(bigrams, 30, 3)[:30]

    def gain(c):
        both = np.zeros((3, 3))
        np.add.at(both, (c[:, None], c[None, :]), bigrams[:30, :30])
        x = lambda a: (a * np.log(np.maximum(a, 1e-12))).sum()
        return x(both) - x(both.sum(0)) - x(both.sum(1))

    assert gain(of) >= gain(kind) - 1e-6 and gain(of) > gain(np.arange(30) % 3)


def test_ranker_sees_the_whole_of_a_long_text():
    share = quality_ranker.features("word " * 5000 + "--- " * 5000)[len(quality_ranker.CLASSES) + 9]
    assert share == 0.5


@pytest.mark.parametrize("seed", range(6))
def test_exchange_ends_where_no_word_would_move(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 12))
    bigrams = rng.poisson(2, (n + 2, n + 2)).astype(float)
    of = class_lm.exchange(bigrams, n, 3)

    def likelihood(c):
        both = np.zeros((c.max() + 1,) * 2)
        np.add.at(both, (c[:, None], c[None, :]), bigrams)
        x = lambda a: (a * np.log(np.maximum(a, 1e-300))).sum()
        return x(both) - x(both.sum(0)) - x(both.sum(1))

    for w in range(n):
        for c in range(3):
            other = of.copy()
            other[w] = c
            assert likelihood(other) <= likelihood(of) + 1e-6
