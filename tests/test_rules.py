"""Rules over codes, names, days and choices on rows that tell right from wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from partloom.functions import checks, days
from partloom.operators import choice, nested, relations, vehicles


def values(spark, rule, given):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x string").select("k", rule(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.k)]


def test_base_codes(spark):
    given = ["TC-687-20 2M", "JVL-168-28", "4505CG1", "1812AC6-COMP", "JCA-123", "JCA-121-15", "JI-276-R", "MATEO-12-I", "MATEO-12-D", "CAMBA265.32.I", "CAMBA265.32", "TC-615-MG 0M", "ABC", "", None, "LONGPART-1-STD"]
    assert values(spark, checks.base_code, given) == ["TC-687", "JVL-168", "4505", "1812", "JCA-123", "JCA-121", "JI-276", "MATEO-12-I", "MATEO-12-D", "CAMBA265-32-I", "CAMBA265-32", "TC-615", None, None, None, "LONGPART-1"]


def test_suspicious_codes(spark):
    given = ["123", "1.09E+11", "20x2.50x180", "1987", "BE-777", "233900E010", "H21A1/2\"RF1,5", "F000 TE1 3X9", "MD-135V", "24V", "E0NN6051CC", "1920LT", "1200 cc", "11/32\"", "278.897 c/CHAPA", "JUEGO DE AROS DIESEL", "A1", "", None, "W712/94"]
    want = ["small number", "scientific", "measure", None, None, None, None, None, None, "electric", None, None, "measure", "symbols", None, "description", "short", "empty", "empty", None]
    assert values(spark, checks.suspicious, given) == want
    assert values(spark, lambda c: checks.suspicious(c, F.lit("RETEN CIGÜEÑAL 35x52x7")), ["35x52x7", "12 mm", "123"]) == [None, None, "small number"]


def test_kits(spark):
    given = ["KIT DISTRIBUCION", "Jgo.Jtas.P/Motor", "COMBO EMBRAGUE", "COMBO 3 FILTROS", "COMBO DE FILTROS", "CONJUNTO BOMBA", "DISTRIBUCION C/BOMBA (LKTBN336 + LWPN007)", "Junta CUMMINS NT310 (3036100/3411461)", "ASSET", None]
    assert values(spark, checks.is_kit, given) == [True, True, False, True, True, False, True, False, False, False]


def test_measures(spark):
    rows = spark.createDataFrame([(5, 60, 7), (10, 80, 3), (20, 20, 1), (0, 20, 1), (30, 0, 0), (-1, 20, 5), (10, 20, -2), (None, 20, 1)], "inner int, outer int, height int")
    got = [r.x for r in rows.select(checks.impossible_measures(F.col("inner"), F.col("outer"), F.col("height")).alias("x")).collect()]
    assert got == [["outer over eight times the inner"], [], ["inner not under outer"], [], [], ["negative", "outer over eight times the inner"], ["negative"], []]


def test_descriptions_that_are_codes(spark):
    rows = spark.createDataFrame([("bomba agua", None), ("ficha rele", True), ("bomba, agua", None), ("W712/94", None), ("bomba agua gol 1.6", None), ("abc", None)], "t string, known boolean")
    assert [r.x for r in rows.select(checks.reads_as_text(F.col("t"), F.col("known")).alias("x")).collect()] == [True, False, False, False, True, False]


def test_list_dates(spark):
    day = dt.date
    given = [("L 31-02-1996 05-07-1996.csv", day(1996, 8, 1)), ("ILLINOIS 17 07 2026.xlsx", day(2026, 7, 20)), ("x 17 07 26.xlsx", day(2026, 7, 20)), ("x 17 07 2026", day(2026, 7, 1)), ("old 1.1.2020 b 2.2.2026", day(2026, 3, 1)), ("none", day(2026, 3, 1)), ("1-1-2026", None)]
    rows = spark.createDataFrame([(k, *g) for k, g in enumerate(given)], "k int, f string, d date").select("k", days.list_date(F.col("f"), F.col("d")).alias("x")).collect()
    got = [r.x and (r.x.day, r.x.origin) for r in sorted(rows, key=lambda r: r.k)]
    assert got == [(day(1996, 7, 5), "list"), (day(2026, 7, 17), "list"), (day(2026, 7, 17), "list"), (day(2026, 7, 1), "loaded"), (day(2026, 2, 2), "list"), (day(2026, 3, 1), "loaded"), None]


def test_inflation(spark):
    monthly = spark.createDataFrame([("2026-02", 0.1), ("2026-04", 0.2)], "month string, rate double")
    rows = spark.createDataFrame([(1, "2025-01-05"), (2, "2026-02-28"), (3, "2026-03-01"), (4, "2026-04-01"), (5, "2027-01-01"), (6, None)], "id int, day string").withColumn("day", F.col("day").cast("date"))
    got = {r.id: r.inflation for r in days.inflation_since(rows, monthly, "day").collect()}
    assert got.pop(6) is None and {k: round(x, 9) for k, x in got.items()} == {1: 0.32, 2: 0.2, 3: 0.2, 4: 0.0, 5: 0.0}
    assert days.inflation_since(rows, monthly.limit(0), "day").where("inflation is not null").count() == 0


OFFERS = "part string, id long, verdict string, stock int, price double, cost double, searched boolean, returned boolean, refused boolean, safety boolean, kit boolean, off_scale boolean, grade int"


def offer(part, i, verdict, stock, price, cost=None, **more):
    flags = dict.fromkeys(("searched", "returned", "refused", "safety", "kit", "off_scale"), False) | {"grade": 0} | more
    return (part, i, verdict, stock, price, cost, *[flags[k] for k in ("searched", "returned", "refused", "safety", "kit", "off_scale", "grade")])


def test_recommendations(spark):
    rows = [
        offer("cheap probable", 1, "verified", 1, 90.0), offer("cheap probable", 2, "probable", 1, 50.0), offer("cheap probable", 3, "candidate", 1, 10.0), offer("safety", 1, "verified", 1, 90.0, safety=True), offer("safety", 2, "probable", 1, 50.0, safety=True),
        offer("searched", 1, "candidate", 1, 40.0, searched=True), offer("searched", 2, "verified", 1, 60.0), offer("returned", 1, "verified", 1, 5.0, returned=True), offer("returned", 2, "verified", 1, 9.0), offer("grade", 1, "verified", 2, 5.0, grade=1),
        offer("grade", 2, "verified", 2, 7.0), offer("none", 1, "candidate", 1, 5.0), offer("kits", 1, "verified", 1, 1.0, kit=True), offer("kits", 2, "verified", 1, 2.0, off_scale=True), offer("kits", 3, "verified", 1, 3.0), offer("gone", 1, "verified", 0, 3.0),
    ]
    got = {r.part: (r.recommended, r.cheapest, r.why_not) for r in choice.recommended(spark.createDataFrame(rows, OFFERS), "part").collect()}
    assert got == {"cheap probable": (2, 3, "candidate"), "safety": (1, 2, "safety"), "searched": (1, 1, None), "returned": (2, 1, "returned"), "grade": (2, 1, "grade"), "none": (None, 1, "candidate"), "kits": (3, 3, None)}


def test_order_and_margin(spark):
    rows = [offer("a", 1, "verified", 1, 9.0, 5.0), offer("a", 2, "candidate", 1, 90.0, 5.0), offer("a", 3, "rejected", 0, None, None, searched=True), offer("a", 4, "probable", 1, 8.0, 7.0), offer("a", 5, "probable", 1, 30.0, 1.0, refused=True)]
    df = spark.createDataFrame(rows, OFFERS)
    assert [r.id for r in choice.in_order(df, "part").orderBy("place").collect()] == [3, 1, 4, 5, 2]
    assert [tuple(r) for r in choice.best_margin(df, "part").collect()] == [("a", 1, 4.0, 3.0)]


@pytest.mark.parametrize("most", [1, 3, 8])
def test_nearest_codes(spark, most):
    import random

    rng = random.Random(most)
    codes = [(i, rng.choice("AB"), rng.randint(0, 60)) for i in range(120)] + [(200 + i, "C", 10**9 * i) for i in range(5)]
    asked = [(p, n) for p in "ABCD" for n in (-5, 0, 7, 30, 61, 1000, 2 * 10**9)]
    got = {}
    for r in choice.nearest_codes(spark.createDataFrame(codes, "id long, prefix string, number long"), spark.createDataFrame(asked + asked[:3], "prefix string, asked long"), most).collect():
        got.setdefault((r.prefix, r.asked), []).append((r.place, r.far, r.id))
    for p, n in asked:
        want = sorted((abs(x - n), i) for i, q, x in codes if q == p)[:most]
        assert sorted(got.get((p, n), [])) == [(k + 1, *w) for k, w in enumerate(want)]


def test_part_states(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    history = [(1, "oil", day(0), 1000, 9000, 300), (1, "oil", day(100), 5000, None, None), (2, "oil", day(0), 1000, 9000, 300), (2, "oil", day(50), None, None, 100), (3, "oil", day(60), 7000, 0, None), (3, "oil", day(50), None, 400, 10), (4, "oil", day(1), None, None, None)]
    v = spark.createDataFrame([(k, 6000) for k in (1, 2, 3, 4)], "vehicle long, km_now long")
    got = {r.vehicle: (r.km_left, r.days_left, r.state) for r in vehicles.part_states(spark.createDataFrame(history, "vehicle long, part string, seen date, km long, life_km long, life_days long"), v, "2024-05-01").collect()}
    assert got == {1: (8000, 279, "fine"), 2: (None, 29, "soon"), 3: (1400, -51, "overdue"), 4: (None, None, "fine")}


def test_json_in_text(spark):
    given = ['a {"n": {"m": 1}} b', 'x ```json\n{"n": 2}\n``` {y}', "none", "{broken}", '{"a": 1} and {"b": 2}', '} {"n": 3}', '```{"n": 4}', None]
    assert values(spark, nested.first_json, given) == ['{"n": {"m": 1}}', '{"n": 2}', None, None, None, '{"n": 3}', '{"n": 4}', None]


def test_versions(spark):
    rows = [(1, "turbo?", "yes", "A"), (1, "turbo?", "no", "B"), (1, "turbo?", "no", "B"), (1, "abs?", "yes", "A"), (1, "abs?", "yes", "B"), (2, "abs?", "yes", "C")]
    got = [tuple(r) for r in nested.versions(spark.createDataFrame(rows, "product long, question string, answer string, code string")).collect()]
    assert got == [(1, {"turbo?": {"yes": ["A"], "no": ["B"]}})]


def test_words_named_together_in_long_names(spark):
    long = [chr(97 + k) for k in range(20)]
    df = spark.createDataFrame([("f", long), ("f", long[:2]), ("f", long[:2])], "family string, words array<string>")
    got = {(r.a, r.b): r.names for r in relations.co_named(df).collect()}
    assert len(got) == 190 and got["a", "b"] == 3 and got["s", "t"] == 1
