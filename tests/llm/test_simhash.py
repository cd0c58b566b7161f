import random

import numpy as np
import pytest
import xxhash

from partloom.llm import simhash
from partloom.operators.graph import components


def plain(text, k=4):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(f, radius):
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_fingerprint():
    for t in (None, "", " \n", "One two", "a b c d", "É À the Quick brown fox\njumps\tover over over over the lazy dog"):
        assert simhash.fingerprint(t) == plain(t)


def noisy(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    out = list(base)
    while len(out) < n:
        x = rng.choice(out[-200:] if rng.random() < 0.5 else base)
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("large", [20_000, 5])
def test_links_against_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(large)
    f = noisy(rng, 900)
    want = classes(f, 4)
    df = spark.createDataFrame([(simhash.signed(x),) for x in f], "f long")
    found = simhash.links(df, 4)
    for r in found.collect():
        assert ((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 4
    root = {r.node: r.root for r in components(found).collect()}
    got = [root.get(simhash.signed(x), simhash.signed(x)) for x in f]
    same = {}
    for w, g in zip(want, got):
        assert same.setdefault(w, g) == g
    assert len(set(same.values())) == len(same)


@pytest.mark.parametrize("n", [10, 10_000, 10_000_000, 10**11])
def test_allocation_is_a_pigeonhole(n):
    both = np.full((64, 64), n / 4.0)
    np.fill_diagonal(both, n / 2.0)
    groups, t = simhash.allocate(n, both, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and sum(t) == 4 - len(groups) + 1


def test_whole_query(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    texts = [None, "", "x", "X", "only two"]
    for k in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(words) for _ in range(50)) for _ in range(30)]
    docs = spark.createDataFrame([(100 - i, t, "c") for i, t in enumerate(texts)] + [(7, texts[10], "c")], "doc_id long, text string, f string")
    ids, f = [100 - i for i in range(len(texts))] + [7], [plain(t) for t in [*texts, texts[10]]]
    group = classes(f, 4)
    least = {}
    for i, g in zip(ids, group):
        least[g] = min(i, least.get(g, i))
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted((i, f"{x:016x}", least[g]) for i, x, g in zip(ids, f, group))
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values()) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_similar_texts(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(900)]
    texts = [None, "", "x"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for edits in (0, 0, 1, 3, 5, 40, 150):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    like = lambda i, j: simhash.likeness(texts[i], texts[j], 5) >= 0.8
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[j] != root[i] and like(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    missed = sum(root[i] != got[i] for i in range(len(texts)))
    assert missed <= 3 and all(root[i] == root[got[i]] for i in range(len(texts)))
    assert simhash.similar(docs.limit(0)).count() == 0


def compared(texts, words_in=5, similarity=0.8, radius=9):
    """Least index of each text's component, by comparing all pairs that are candidates."""
    prints = [simhash.four_fingerprints(t, words_in)[:4] for t in texts]
    sets = [set(simhash.shingles(t, words_in)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and any((x ^ y).bit_count() <= radius for x, y in zip(prints[i], prints[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_siblings_of_one_original(spark):
    rng = random.Random(3)
    texts = []
    for n in (220, 30, 9):
        base = ["w%d" % rng.randrange(5000) for _ in range(600)]
        texts.append(" ".join(base))
        for _ in range(n):
            w = list(base)
            for at in rng.sample(range(600), 10):
                w[at] = "edit%d" % rng.randrange(10**6)
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = [simhash.likeness(texts[i], texts[j], 5) for i in range(1, 20) for j in range(1, i)]
    assert sum(x < 0.8 for x in pairs) > 0.95 * len(pairs) and simhash.likeness(texts[0], texts[1], 5) >= 0.8
    want = compared(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(w == 0 for w in want) > 200


def test_repeated_lines(spark):
    rng = random.Random(11)
    prose = lambda n: ["v%d" % rng.randrange(10**5) for _ in range(n)]
    texts = []
    for times in (2, 10, 30, 60):
        lines, line = [" ".join(prose(20)) for _ in range(30)], " ".join(prose(14))
        texts += ["\n".join([*lines, line]), "\n".join([*lines, *[line] * times])]
    line = " ".join(prose(6))
    texts += ["\n".join([line] * 300 + [" ".join(prose(20))]) for _ in range(4)]  # one line has all the weight
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and simhash.likeness(texts[i], texts[j], 5) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert root == [0, 0, 2, 2, 4, 4, 6, 6, 8, 9, 10, 11]
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert [got[i] for i in range(len(texts))] == root


@pytest.mark.parametrize("of", [simhash.similar, simhash.near_duplicates])
def test_one_of_each_with_null_and_repeated_ids(spark, of):
    rng = random.Random(2)
    texts = [" ".join("w%d" % rng.randrange(10**5) for _ in range(80)) for _ in range(6)]
    rows = [(None, texts[0], "a"), (None, texts[1], "b"), (None, texts[1], "b"), (5, texts[2], "c"), (5, texts[3], "d"), (5, texts[0], "a"), (4, texts[4], "e"), (9, texts[4], "f"), (None, None, "g"), (None, "", "g"), (4, texts[5], "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string")
    left = simhash.one_of_each(docs, of(docs))
    got = sorted((r.k, r.doc_id) for r in left.collect())
    assert got == [("a", 5), ("b", None), ("c", 5), ("d", 5), ("e", 4), ("g", None), ("h", 4)] and left.columns == docs.columns


def test_bitmaps_leave_out_no_pair_that_is_alike():
    draw = random.Random(7)
    base = [f"w{draw.randrange(900)}" for _ in range(160)]
    texts = [""] + [" ".join(f"x{draw.randrange(40)}" if draw.random() < 0.001 * k else w for w in base[: 160 - k % 20]) for k in range(60)]
    rows = np.array([simhash.four_fingerprints(t, 5) for t in texts], np.uint64)
    size, bits = rows[:, 4].astype(np.int64), rows[:, 5:]
    search = simhash.Search(64, 0.8, 1)
    left_out = 0
    for i in range(len(texts)):
        near = search.near(rows[:, 0], size, bits, slice(i, i + 1), slice(0, None))
        alike = np.array([simhash.likeness(texts[i], t, 5) for t in texts])
        assert near[alike >= 0.8].all()
        left_out += (~near & (np.minimum(size, size[i]) >= 0.8 * np.maximum(size, size[i]))).sum()
    assert left_out > 100
