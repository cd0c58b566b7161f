"""The trigram index through changes, and the rare-word join, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from partloom.operators import rare_words, trigrams

WORDS = ["junta", "tapa", "cilindro", "de", "bomba", "agua", "k4m", "1", "6", "fiat", "ñandú", "Válvula", "ab", "motor", "xy12"]


def texts(rng, ids):
    return [(i, None if rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for i in ids]


def plain(rows, search, top):
    words = list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", search.lower()) if w))
    enough = len(words) if len(words) <= 2 else max(2, len(words) * 2 // 3)
    out = []
    for i, t in rows:
        f = (t or "").lower().translate(str.maketrans("ñúá", "nua"))
        alone = [bool(re.search(f"(?<![a-z0-9]){w}(?![a-z0-9])", f)) for w in words]
        found = sum(a if len(w) <= 2 else w in f for w, a in zip(words, alone))
        if words and found >= enough:
            out.append((-found, -sum(alone), len(t or ""), i))
    return [(i, -found, -whole, size) for found, whole, size, i in sorted(out)[:top]]


def test_index_through_changes(spark, tmp_path):
    rng = random.Random(3)
    searches = ["junta tapa", "bomba agua motor", "ab", "de 1 6", "k4m", "nandu", "valvula fiat xy1", "", "zzz", "ab 1 xy12 motor"]
    rows = dict(texts(rng, range(400)))
    df = lambda r: spark.createDataFrame(list(r.items()), "id long, text string")
    path = trigrams.build(df(rows), str(tmp_path / "index"))
    for round_ in range(4):
        if round_:
            changed = rng.sample(range(420), 60)
            for i in changed:
                if rng.random() < 0.3:
                    rows.pop(i, None)
                else:
                    rows[i] = texts(rng, [i])[0][1]
            ids = spark.createDataFrame([(i,) for i in changed] + [(changed[0],), (None,)], "id long")
            path = trigrams.update(df(rows), ids, path, str(tmp_path / f"anew{round_}"), many=50 if round_ == 3 else 100)
        got = {}
        for r in trigrams.search(spark, path, spark.createDataFrame([(s,) for s in searches], "search string"), top=20).collect():
            got.setdefault(r.search, []).append((r.id, r.found, r.whole, r.size))
        for s in searches:
            assert sorted(got.get(s, [])) == sorted(plain(rows.items(), s, 20)), s
        anew = trigrams.build(df(rows), str(tmp_path / f"rebuilt{round_}"))
        for table in (trigrams.postings, trigrams.texts):
            assert sorted(map(tuple, table(spark, path).collect())) == sorted(map(tuple, table(spark, anew).collect()))
    assert path.endswith("anew3")


def test_no_change_and_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    path = trigrams.build(none, str(tmp_path / "index"))
    assert trigrams.update(none, none.select("id"), path, "unused") == path
    assert trigrams.search(spark, path, spark.createDataFrame([("junta",), ("ab",)], "search string")).count() == 0


@pytest.mark.parametrize(("alike", "most", "since"), [(0.5, 12, None), (0.3, 6, None), (0.8, 40, None), (0.5, 12, 100)])
def test_pairs_by_rare_words(spark, alike, most, since):
    rng = random.Random(int(alike * 10))
    vocabulary = [f"w{k}" for k in range(90)]
    items = [(i, rng.choice("abc") if i % 9 else None, list(dict.fromkeys(rng.choices(vocabulary, k=rng.randint(0, 7))))) for i in range(180)]
    items += [(200 + i, "abcd"[i % 4], [*items[i][2][:4], "w1"]) for i in range(60)]
    items = [(i, b, list(dict.fromkeys(w))) for i, b, w in items]
    n = {}
    for _, _, w in items:
        for x in w:
            n[x] = n.get(x, 0) + 1
    want = set()
    for i, b, w in items:
        for j, c, u in items:
            common = set(w) & set(u)
            if i < j and b != c and any(2 <= n[x] <= most for x in common) and len(common) >= alike * len(set(w) | set(u)) - 1e-9 and (since is None or j > since):
                want.add((i, j, len(common)))
    df = spark.createDataFrame(items, "id long, brand string, words array<string>")
    assert {tuple(r) for r in rare_words.pairs(df, alike, most, since).collect()} == want and want
    assert {(r.word, r.n) for r in rare_words.hubs(df, most).collect()} == {(w, k) for w, k in n.items() if k > most}
    top = rare_words.best(rare_words.pairs(df, alike, most), 2).groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert top <= 2


def test_lists_of_a_block_of_texts(spark):
    """Trigrams of odd texts, put in lists by a task, are those of each text alone."""
    held = ["", "ab", "abc", "abcabc abc", "año abcñdef", "x\u4e2dabc\U0001f600def", "123-456 7", "zz\nzzz", "z" * 50]
    rows = spark.createDataFrame([(i * 7919 % 31 - 9 + (i % 3) * 20_000, held[i % len(held)]) for i in range(31)], "id long, f string").coalesce(1)
    lists = rows.mapInArrow(trigrams.listed, "trigram string, block long, ids array<long>").collect()
    assert all(r.ids == sorted(set(r.ids)) and {i // trigrams.BLOCK for i in r.ids} == {r.block} for r in lists)
    want = rows.select("id", F.explode(trigrams.trigrams(F.col("f"))).alias("trigram")).collect()
    assert sorted((r.trigram, i) for r in lists for i in r.ids) == sorted((r.trigram, r.id) for r in want)
    small, trigrams.HELD = trigrams.HELD, 5
    try:
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"id": pa.array([r.id for r in rows.collect()], pa.int64()), "f": [r.f for r in rows.collect()]}).slice(2)
        cut = [(t, i) for b in trigrams.listed([batch]) for t, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()) for i in ids]
        assert sorted(cut) == sorted((r.trigram, r.id) for r in want if r.id in set(batch.column(0).to_pylist()))
    finally:
        trigrams.HELD = small
