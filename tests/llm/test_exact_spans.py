import hashlib
import random
from collections import Counter

import pytest

from partloom.llm import exact_spans


def brute(texts, length):
    bufs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bufs for i in range(len(b) - length + 1))
    out = []
    for b in bufs:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = b"\x01" * length
        spans = sum(hit[i] and (i == 0 or not hit[i - 1]) for i in range(len(b)))
        left = bytes(c for c, h in zip(b, hit) if not h)
        out.append((len(b), sum(hit), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(3)]
    texts = [None, "", "short", "a" * 700, "ab" * 400, "abc" * 300 + prose(30)]
    for i in range(60):
        t = prose(rng.randint(5, 120))
        if i % 3 == 0:
            p = rng.choice(shared)
            a = rng.randint(0, 40)
            t = t + p[a : a + rng.randint(length - 20, length + 120)] + prose(20)
        texts.append(t)
    base = prose(150)
    for _ in range(25):  # near copies, and exact ones
        w = base.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [base, base, texts[10], texts[10] + texts[11] + texts[10]]
    return texts


@pytest.mark.parametrize(("seed", "split", "shard"), [(1, 1000, 2_000_000), (2, 3, 5000), (3, 1, 3000)])
def test_against_brute_force(spark, monkeypatch, seed, split, shard):
    monkeypatch.setattr(exact_spans, "SPLIT_AT", split)
    monkeypatch.setattr(exact_spans, "SHARD_BYTES", shard)
    length = 120
    texts = corpus(seed, length)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exact_spans.remove(docs, length).collect()}
    for i, want in enumerate(brute(texts, length)):
        assert got[i] == want, (i, texts[i])


def test_repeated_rows_and_empty_table(spark):
    t = "unlike any other text " * 20
    docs = spark.createDataFrame([(1, t), (1, t), (2, "b" * 10)], "doc_id long, text string")
    rows = exact_spans.remove(docs, 400).collect()
    assert sorted(r.n_removed for r in rows) == [0, len(t), len(t)]
    assert exact_spans.remove(docs.limit(0), 400).count() == 0


def test_rows_of_one_null_id_and_text_by_the_thousand(spark):
    """Each key's spans are made once, so ten times the rows take no longer lists."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    t = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    docs = spark.range(4000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(t).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, other), (5, other + t[:500])], "doc_id long, text string"))
    found = exact_spans.spans(docs, 400).collect()
    assert sorted(len(r.spans) for r in found) == [1, 1, 1]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in exact_spans.remove(docs, 400).collect())
    assert got == {(None, 3000, 3000, 1): 4000, (None, 1000, 1000, 1): 1, (5, 1500, 1500, 1): 1}


@pytest.mark.parametrize("step", [1, 37, 200])
def test_long_texts_in_blocks(spark, monkeypatch, step):
    monkeypatch.setattr(exact_spans, "STEP", step)
    texts = corpus(7, 120)[:30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exact_spans.remove(docs, 120).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 120)


def test_cut_repeats_keeps_columns(spark):
    p = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(500))
    docs = spark.createDataFrame([(1, "x" + p + "tail one", "k"), (2, p + "é", "m"), (3, None, None), (4, p, "z")], "doc_id long, text string, n_removed string")
    rows = {r.doc_id: r for r in exact_spans.cut_repeats(docs, 400).collect()}
    assert rows[1].text == "xtail one" and rows[2].text == "é" and rows[3].text is None and 4 not in rows
    assert rows[1].n_removed == "k"
