"""Names that meet at rare words: against all pairs, and many long ones in time."""

import itertools
import random
import time

from pyspark.sql import functions as F

from partloom.operators import rare_words


def test_long_names_and_null_brands(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 3, 20, 300, 1500]))]
        for _ in range(3):
            rows.append((len(rows) * 7 - 100, rng.choice([None, "x", "y"]), sorted({w if rng.random() < 0.8 else f"w{rng.randrange(4000)}" for w in base})))
    df = spark.createDataFrame(rows, "id long, brand string, words array<string>").repartition(5)
    n = {}
    for _, _, w in rows:
        for x in w:
            n[x] = n.get(x, 0) + 1
    want = set()
    for (a, p, v), (b, q, w) in itertools.combinations(rows, 2):
        both = set(v) & set(w)
        if p != q and any(n[x] <= 30 for x in both) and len(both) >= 0.5 * (len(v) + len(w) - len(both)):
            want.add((a, b, len(both)))
    got = [tuple(r) for r in rare_words.pairs(df, 0.5, 30).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_many_meetings_in_time(spark):
    # Millions of meetings at words of some 200 names each, of names that share little else.
    k = F.col("id")
    words = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(k, i), F.lit(4000)).cast("string")))
    names = spark.range(4000).select("id", F.pmod(k, F.lit(2)).cast("string").alias("brand"), F.array_distinct(F.concat(words, F.array(F.concat(F.lit("own"), (k / 2).cast("long").cast("string"))))).alias("words"))
    began = time.time()
    assert rare_words.pairs(names).count() == 0
    assert time.time() - began < 60
