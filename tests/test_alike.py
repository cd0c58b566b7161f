"""What is asked or said alike meets once: joins that grew with the square of equal rows end in a moment."""

import random
import time

from pyspark.sql import functions as F

from partloom.operators import citations, evidence, fitments, relations


def quick(f, seconds=60):
    began = time.time()
    out = f()
    assert time.time() - began < seconds
    return out


def test_fits_many_asks_of_one_code(spark):
    asked = spark.range(60_000).select(F.col("id").alias("ask"), F.lit("X1").alias("code"), F.lit("fiat").alias("maker"), F.lit(None).cast("string").alias("model"), F.when(F.col("id") % 2 == 0, 2000).alias("year"))
    known = spark.range(60_000).select(F.lit("X1").alias("code"), F.lit("FIAT").alias("maker"), F.lit("UNO").alias("model"), F.concat(F.lit("E"), F.col("id") % 2).alias("engine"), F.lit(1990).alias("first"), F.lit(1995).alias("last"))
    got = quick(lambda: {tuple(r) for r in fitments.fits(asked, known).groupBy("year", "fits", "why", F.array_join("engines", " ")).count().collect()})
    assert got == {(2000, False, "other year", "", 30_000), (None, True, None, "E0 E1", 30_000)}


def test_searches_for_the_same_words(spark):
    index = relations.inverted(spark.range(100_000).select("id", F.array(F.lit("a"), F.when(F.col("id") < 10, "b").otherwise("c")).alias("words")))
    asked = spark.range(20_000).select(F.col("id").alias("search"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit(None).cast("string"))).alias("word"))
    got = quick(lambda: relations.words_to_ids(index, asked).groupBy("hits").agg(F.count("*"), F.count_distinct("id")).collect())
    assert [tuple(r) for r in got] == [(2, 200_000, 10)]


def test_sets_that_name_the_same_codes(spark):
    k = F.col("id")
    parts = spark.range(40_000).select(k, F.lit("PZ1000").alias("code"), F.concat(F.lit("pieza "), k % 2).alias("text"), F.when(k > 0, 1.0).alias("price"), (k % 3).alias("stock"))
    kits = spark.range(100_000, 140_000).select(k, F.lit("K1").alias("code"), F.concat(F.lit("KIT PZ1000 n"), k % 2).alias("text"), F.lit(1.0).alias("price"), F.lit(1).cast("long").alias("stock"))
    got = quick(lambda: {tuple(r) for r in citations.kit_parts(parts.unionByName(kits)).collect()})
    assert got == {(kit, part) for kit in (100_000, 100_001) for part in (1, 2)}


def test_fitment_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(p, f"B{rng.randrange(3)}", f"K{rng.randrange(2)}", f"C{rng.randrange(3)}", rng.choice([None, 1, 2])) for p in range(30) for _ in range(rng.randint(1, 3))]
    fields = "part long, brand string, kind string, car string, engine int"
    for least in (1, 2):
        want = {}
        for a, ba, ka, ca, ea in rows:
            for b, bb, kb, cb, eb in rows:
                if a < b and ba != bb and (ka, ca) == (kb, cb) and (ea is None or eb is None or ea == eb):
                    want.setdefault((a, b), set()).add(ca)
        got = evidence.fitment_pairs(spark.createDataFrame(rows, fields), least).collect()
        assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b): r.cars for r in got} == {p: len(c) for p, c in want.items() if len(c) >= least}
    k = F.col("id")
    many = spark.range(20_000).select(k.alias("part"), F.concat(F.lit("B"), k % 2).alias("brand"), F.lit("K").alias("kind"), F.lit("C").alias("car"), F.lit(None).cast("int").alias("engine"))
    assert quick(lambda: evidence.fitment_pairs(many, 1).count()) == 10_000 * 10_000


def test_sales_of_one_supplier_do_not_meet(spark):
    """All of a customer's sales of a part met each other, whoever had supplied them."""
    k = F.col("id")
    one = spark.range(60_000).select(F.lit(1).alias("customer"), F.lit(1).alias("part"), F.lit(7).cast("long").alias("id"), k.alias("seen"), F.lit(False).alias("returned"))
    two = spark.createDataFrame([(2, 1, 5, 1, True), (2, 1, 6, 2, False), (2, 1, 5, 3, True), (2, 1, 6, 3, True), (3, 1, 6, 1, False)], "customer int, part int, id long, seen long, returned boolean")
    got = quick(lambda: {tuple(r) for r in evidence.bought_after(one.unionByName(two)).collect()})
    assert got == {(5, 6, 2, True), (6, 5, 1, True)}
