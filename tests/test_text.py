import pytest
from pyspark.sql import functions as F

from partloom.functions import text


def values(spark, f, cells):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r.v for r in rows.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_sanitize(spark):
    cells = [" ab-12/3 ", "1234.0", "1234.00", "1.5E+4", "2024-01-31", "2024-01-31 10:00:00", None, "", "12.5", "é9"]
    assert values(spark, text.sanitize, cells) == ["AB123", "1234", "1234", "15000", "", "", "", "", "125", "9"]


def test_read_number(spark):
    cells = ["1.234,56", "1,234.56", "1.234", "1.23", "12,5", "1.234.567", "-3,5", "$ 10", "1 234", "12 34", "abc", None, "", "0,5", ".5", "1,234,567"]
    want = [1234.56, 1234.56, 1234.0, 1.23, 12.5, 1234567.0, -3.5, 10.0, 1234.0, None, None, None, None, 0.5, 0.5, 1234567.0]
    assert values(spark, text.read_number, cells) == want


def test_check_digits(spark):
    assert values(spark, text.gtin_closes, ["4006381333931", "4006381333932", "96385074", "036000291452", "12345", None]) == [True, False, True, True, None, None]
    assert values(spark, text.vin_digit, ["1M8GDM9AXKP042788", "1HGCM82633A004352", "1M8GDM9AXKP04278", "IM8GDM9AXKP042788"]) == ["X", "3", None, None]


def test_plates(spark):
    assert values(spark, text.plate_format, ["ab 123 cd", "ABC-123", "A123BCD", "123ABC", "AB12CD", None]) == ["mercosur", "federal", "motorcycle", "motorcycle", None, None]


def test_words_and_median(spark):
    assert values(spark, text.words, ["Bomba de agua, BOMBA ñandú", None]) == [["bomba", "de", "agua", "nandu"], None]
    rows = spark.createDataFrame([("a", x) for x in (3.0, 1.0, 2.0, 4.0)] + [("b", None), ("c", 5.0), ("d", 2.0), ("d", 1.0), ("d", 9.0)], "k string, x double")
    assert {r.k: r.m for r in rows.groupBy("k").agg(text.upper_median("x").alias("m")).collect()} == {"a": 3.0, "b": None, "c": 5.0, "d": 2.0}


def test_wilson(spark):
    rows = spark.createDataFrame([(0, 0), (0, 10), (5, 10)], "e long, n long")
    got = [r.w for r in rows.select(text.wilson_upper(F.col("e"), F.col("n")).alias("w")).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.27753, abs=1e-4) and got[2] == pytest.approx(0.76341, abs=1e-4)
