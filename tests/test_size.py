"""What a task holds, and how many tasks there are, where tables are large or short but costly."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from partloom.functions import staging
from partloom.operators import citations, code_search, graph, imports, pricing, queues, rescoring, reviews, search, signatures
from partloom.plans import structures, texts

SMALL = "/root/testdata/sf0.001"


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def wrote(name, make):
    """The rows of the staged tables of a name that make writes."""
    before = set(staging._written)
    out = make()
    return out, [s.read.parquet(p) for p, s in staging._written.items() if p not in before and p.endswith(f"-{name}")]


def test_parts_are_read_in_many_tasks(spark):
    from partloom.sources.views import Views

    v = Views(spark, SMALL)
    assert tasks(structures.citing(v)) > 1
    assert tasks(texts.parts(v, raw="p_name")) > 1


def test_known_pairs_are_left_out(spark):
    p = spark.createDataFrame([(1, "X", "K1000", "one // K2000"), (2, "Y", "K2000", "two"), (3, "Z", "K2000", None)], "id long, brand string, code string, text string")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "a long, b long")
    out, read = wrote("declared_codes", lambda: citations.written_pairs(p, pairs((2, 1)), pairs((9, 8))))
    assert [tuple(r) for r in out.collect()] == [(1, 3)]
    assert [t.columns for t in read] == [["id", "brand", "code", "kit", "named"]]  # no texts go on


def test_places_need_no_task_for_a_group(spark):
    rows = spark.range(400_000).select(F.when(F.col("id") % 4 > 0, 1).alias("g"), (F.col("id") * 7919 % 400_000).alias("x"))
    out, read = wrote("in_order", lambda: queues.placed(rows, "g", [F.desc("x")]))
    want = rows.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("x"))))
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
    assert read[0].where("g = 1").select("_range").distinct().count() > 1


def test_equal_descriptions_are_read_once(spark):
    rows = spark.createDataFrame([(1, "RETEN 35x52x7"), (2, "RETEN 35x52x7"), (3, None), (4, "KIT RETEN")], "id long, text string")
    out, read = wrote("described", lambda: rescoring.described(rows, [("RETEN", "gaskets")]))
    assert read[0].count() == 3 and sorted((r.id, r.family) for r in out.collect() if r.family) == [(1, "gaskets"), (2, "gaskets"), (4, "gaskets")]
    out, read = wrote("signatures", lambda: signatures.signed(rows))
    assert read[0].count() == 3 and out.count() == 4 and out.where("signature is null").count() == 1


def test_a_contradiction_outdoes_a_doubt(spark):
    rows = signatures.signed(spark.createDataFrame([(1, "Bomba agua FIAT PALIO"), (2, "Bomba agua"), (3, "Bomba agua reconstruida"), (4, "Bomba")], "id long, text string")).select("id", "signature")
    pairs = rows.toDF("a", "signature_a").crossJoin(rows.toDF("b", "signature_b")).where("a < b")
    got = {(r.a, r.b): (r.why, r.doubt) for r in signatures.compared(pairs).collect()}
    assert got[1, 2] == ("no car", True) and got[1, 3] == ("rebuilt", False) and got[1, 4] == ("no car", True) and got[2, 4] == ("few words", False)
    # The rules after the one that decides are not looked at: no list of all of them is made.
    assert "filter(array(CASE" not in signatures.compared(pairs)._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_made_once_for_both_ways(spark):
    links = spark.createDataFrame([(1, 2, 50), (2, 3, 60)], "a long, b long, conf long")
    both = graph.both_ways(links)
    assert sorted(map(tuple, both.collect())) == [(1, 2, 50), (2, 1, 50), (2, 3, 60), (3, 2, 60)]
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_steps_of_replacements_are_those_that_go_on(spark):
    rows = spark.createDataFrame([(str(i), str(i % 3), 1) for i in range(50)], "old string, new string, seen int")
    out, read = wrote("steps", lambda: imports.replacement_ends(rows))
    assert read[0].count() == 3 and out.where("code = '7'").first()[1:] == ("1", 1)


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(staging, "ROWS", 100)
    many = spark.range(5000).select("id")
    assert staging.by_rows(many, "id").select(F.spark_partition_id().alias("p")).distinct().count() > 16
    prices = many.select((F.col("id") % 2500).alias("id"), F.lit(1).alias("brand"), F.col("id").cast("double").alias("price"), F.lit("2001-01-01").cast("timestamp").alias("seen"))
    assert pricing.two_prices(prices).count() == 2500 and tasks(pricing.two_prices(prices)) > 16
    fans = many.select((F.col("id") % 2500).alias("a"), F.lit(1).alias("list"), F.col("id").alias("base"))
    assert reviews.fans(fans).count() == 2500 and tasks(reviews.fans(fans)) > 16


def test_nearest_by_tiles(spark):
    x = np.random.default_rng(1).normal(size=(2500, 3))
    v = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    assert 2500 * 2500 > search.CELLS  # more than a task holds at once
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    c = u @ u.T
    np.fill_diagonal(c, -2)
    got = search.nearest(v, v, 1)
    assert {(r.probe, r.near) for r in got.collect()} == set(enumerate(c.argmax(1)))


def test_brands_of_prices_need_no_join(spark):
    links, priced = spark.createDataFrame([(1, 2, 50)], "a long, b long, conf long"), spark.createDataFrame([(1, 5.0, 7), (2, 6.0, 8)], "id long, price double, brand long")
    out = pricing.linked_prices(links, priced)
    assert [r.asDict() for r in out.collect()] == [{"a": 1, "b": 2, "conf": 50, "price_a": 5.0, "brand_a": 7, "price_b": 6.0, "brand_b": 8}]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_equal_codes_are_one_state(spark):
    n = 30
    products = spark.createDataFrame([(i, "SHARED77", None, False) for i in range(n)] + [(100 + i, f"OWN{i:05}", None, False) for i in range(n)], "id long, code string, barcode string, oem boolean")
    links = spark.createDataFrame([(i, 100 + i, 80, False) for i in range(n)], "a long, b long, conf int, ends boolean")
    searches = spark.createDataFrame([("OWN00000",), ("OWN00001",)], "search string")
    out, read = wrote("same_code", lambda: code_search.search(products, links, searches))
    assert sum(t.count() for t in read) <= 2 * 2 and out.count() == 2 * 2 * n
    got = {(r.search, r.id): (r.hops, r.worst, r.by_code) for r in out.collect()}
    assert got["OWN00000", 5] == (1, 80, False) and got["OWN00000", 0] == (1, 80, False) and got["OWN00000", 105] == (2, 80, False)


def test_ways_of_a_code_are_tried_in_one_join(spark):
    products = spark.createDataFrame([("ABC1", None), ("0ABC1", None), ("00ABC1", "X99LUCAS"), ("NGKABC1SKF", None), ("KGN777", None), ("777", None)], "code string, barcode string")
    typed = ["ABC1", "00ABC1", "000ABC1", "X99NGK", "NGKX99", "NGK777", "NGK777KGN", "KGN777NGK", "00", "NGKABC1", "X9"]
    brands = spark.createDataFrame([("NGK",), ("KGN",), ("GK",)], "name string")
    out, read = wrote("names", lambda: code_search.resolved(products, spark.createDataFrame([(t,) for t in typed], "typed string"), brands, ("LUCAS", "SKF")))
    got = {r.typed: (r.code, r.how) for r in out.collect()}
    assert got == {
        "ABC1": ("ABC1", "exact"), "00ABC1": ("00ABC1", "exact"), "000ABC1": ("ABC1", "zero"), "X99NGK": ("X99LUCAS", "brand"), "NGKX99": ("X99LUCAS", "brand"), "NGK777": ("777", "brand"),
        "KGN777NGK": ("KGN777", "brand"), "NGKABC1": ("NGKABC1SKF", "glued"),
    }
    assert read[0].count() == 3  # one table of few rows, not each typed code's cuts, goes out
