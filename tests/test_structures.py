"""Scales of lists, citations and fitment catalogues against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.operators import citations, fitments, scales


def test_scales_equal_least_squares(spark):
    rng = random.Random(2)
    true = {b: rng.uniform(-1, 1) for b in range(12)}
    groups = [range(5), range(5, 9), [9, 10]]  # list 11 is compared with none
    pairs = []
    for g in groups:
        for _ in range(700):
            x, y = rng.sample(list(g), 2)
            p = rng.uniform(5, 500)
            pairs.append((x, p * np.exp(true[x] + rng.gauss(0, 0.2)), y, p * np.exp(true[y] + rng.gauss(0, 0.2))))
    prices = [(b, float(np.exp(true[b]) * rng.uniform(10, 900))) for b in range(12) for _ in range(25)] + [(12, 5.0)]
    p = spark.createDataFrame([(a, float(x), b, float(y)) for a, x, b, y in pairs], "brand_a long, price_a double, brand_b long, price_b double")
    q = spark.createDataFrame(prices, "brand long, price double")
    got = {r.brand: r.scale for r in scales.list_scales(p, q).collect()}
    med = {b: float(np.log(sorted(x for c, x in prices if c == b)[len([1 for c, _ in prices if c == b]) // 2])) for b in range(12)}
    want = {11: med[11]}
    for g in groups:
        rows, right = [], []
        for i in g:
            for j in g:
                r = sorted(round(float(np.log(x / y) if a == i else np.log(y / x)), 12) for a, x, b, y in pairs if {a, b} == {i, j})
                if i < j and len(r) >= 20:
                    w = np.sqrt(len(r))
                    rows.append([w * ((k == i) - (k == j)) for k in g])
                    right.append(w * r[len(r) // 2])
        s = np.linalg.lstsq(np.array(rows, float), np.array(right), rcond=None)[0]
        for k, i in enumerate(g):
            want[i] = s[k] + np.mean([med[i] for i in g]) - s.mean()
    assert set(got) == set(want)
    for b, v in want.items():
        assert abs(np.log(got[b]) - v) < 1e-7
    one = scales.deviations(p.limit(3), scales.list_scales(p, q)).collect()
    assert all(min(r.times, r.usual, r.off) >= 1 for r in one)


def test_scales_without_pairs(spark):
    none = spark.createDataFrame([], "brand_a long, price_a double, brand_b long, price_b double")
    q = spark.createDataFrame([(1, float(k)) for k in range(1, 26)], "brand long, price double")
    assert [(r.brand, round(r.scale, 9)) for r in scales.list_scales(none, q).collect()] == [(1, 13.0)]


@pytest.mark.parametrize("pieces", [4, 8])
def test_citations_against_patterns(spark, pieces):
    rng = random.Random(pieces)
    codes = ["P716", "C5563", "MFLA258", "W71294", "0280156020", "K4M700", "AB1", "XX", "12", "1234", "A1B2", "NOPE"]
    parts = [*codes, "p 716", "C-5563", "mfla.258", "W712/94", "K4M 700", " ", "-", ",", "ñ", "(", "0280 156 020", "A-1-B-2", "A  1B2", "X", "P716X"]
    texts = [(i, "".join(rng.choice(parts) + rng.choice([" ", "", "-", ", ", "/"]) for _ in range(rng.randint(0, 9)))) for i in range(200)] + [(900, None), (901, ""), (902, "A-1-B-2")]
    got = {(r.id, r.code) for r in citations.cited(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(c,) for c in [*codes, codes[0], None]], "code string"), pieces).collect()}
    want = set()
    for i, t in texts:
        for c in codes:
            if len(c) >= 4 and re.search("[0-9]", c):
                for m in re.finditer("(?=(?<![A-Z0-9])(" + r"[\s.\-/]?".join(c) + ")(?![A-Z0-9]))", (t or "").upper().replace("Ñ", "N")):
                    if len(re.split(r"[\s.\-/]", m[1])) <= pieces:
                        want.add((i, c))
    assert got == want and want


def test_declared_pairs_and_kits(spark):
    rows = [
        (1, 1, "A100X", "SENSOR REF ORIG 0280-156020", 5.0, 1), (2, 2, "0280156020", "SENSOR BOSCH", 9.0, 1), (3, 1, "0280156020", "OTRO", 9.0, 1), (4, 3, "ZZ99", "SENSOR 0280156020", 1.0, 1), (5, 4, "KK11", "KIT SENSOR OEM 0280156020", 1.0, 1),
        (10, 1, "KIT777", "JUEGO DISTRIBUCION LKTBN336 y LWPN007", 1.0, 1), (11, 2, "KIT778", "JUEGO DISTRIBUCION LKTBN336 y LWPN007", 2.0, 0), (12, 3, "LKTBN336", "CORREA", None, 1), (13, 4, "LKTBN336", "CORREA", 4.0, 1), (14, 3, "LWPN007", "BOMBA", 4.0, 0),
    ]
    p = spark.createDataFrame(rows, "id long, brand long, code string, text string, price double, stock int")
    none = spark.createDataFrame([], "a long, b long")
    assert {tuple(r) for r in citations.written_pairs(p, none, none).collect()} == {(1, 2)}
    assert citations.written_pairs(p, spark.createDataFrame([(2, 1)], "a long, b long"), none).count() == 0
    assert {tuple(r) for r in citations.kit_parts(p).collect()} == {(5, 2), (5, 3), (10, 13), (10, 14)}


CATALOGUE = [
    ["FIAT", "", "", "", ""], ["Palio", "1.6 16V", "G", "1998 a 2004", "BKR6EKPA / PMR7A"], ["", "1.3", "G", "Desde 2000", "BKR6E"], ["FIAT - Continuação", None, None, None, None], ["", "1.4", "G", "2001", "LOST1"], ["Uno", "1.0", "G", "Até 1995", "BP6E"],
    ["", "", "", "", ""], ["", "1.1", "G", "", "G"], ["", "1.2", "G", "05/1999 a 08/2000", "BP7E"], ["FORD", "", "", "", ""], ["Ka", "1.0", "", "x", "ZETEC"], ["a lower case title", "", "", "", ""], ["Ka", "1.0", "G", "2005", "TR6B"],
]


@pytest.mark.parametrize("block", [2, 10_000])
def test_catalogue(spark, monkeypatch, block):
    monkeypatch.setattr(fitments, "BLOCK", block)
    df = spark.createDataFrame([("f", k, c) for k, c in enumerate(CATALOGUE)] + [("g", 0, ["x", "y", "z", "1", "A11"])], "file string, line long, cells array<string>")
    columns = spark.createDataFrame([("f", 3, 4), ("g", 3, 4)], "file string, years_at int, code_at int")
    got = sorted((r.line, r.maker, r.model, r.engine, r.first, r["last"], r.code) for r in fitments.parsed(df, columns).collect())
    assert got == [
        (1, "FIAT", "PALIO", "1.6 16V", 1998, 2004, "BKR6EKPA"), (1, "FIAT", "PALIO", "1.6 16V", 1998, 2004, "PMR7A"), (2, "FIAT", "PALIO", "1.3", 2000, None, "BKR6E"), (5, "FIAT", "UNO", "1.0", None, 1995, "BP6E"),
        (8, "FIAT", "UNO", "1.2", 1999, 2000, "BP7E"), (12, "FORD", "KA", "1.0", 2005, None, "TR6B"),
    ]


def test_columns_of_a_catalogue_and_what_is_one(spark):
    rows = [["FIAT", "", "", "", ""], ["FORD", "", "", "", ""]] + [["Uno", f"1.{k}", "G", "BP6E", f"19{80 + k} a 19{90 + k}"] for k in range(10)]
    df = spark.createDataFrame([("f", k, c) for k, c in enumerate(rows)] + [("p", k, [f"K{k}", "text", "10,5", "", ""]) for k in range(12)], "file string, line long, cells array<string>")
    assert {tuple(r) for r in fitments.columns_of(df).where("file = 'f'").collect()} == {("f", 4, 3)}
    makers = spark.createDataFrame([("FIAT",), ("FORD",), ("FIAT",)], "name string")
    assert [tuple(r) for r in fitments.looks_like_one(df, makers).collect()] == [("f", 2)]


def test_crossing(spark):
    rows = [("FIAT", "UNO", e, f, l, c) for e, f, l, c in [("1.0", 1990, 1995, "A1"), ("1.0", 1994, None, "B1"), ("1.3", None, 1999, "A1"), ("1.3", 1999, 1999, "B1"), ("1.0", 1996, 1999, "C1"), ("1.3", 2000, 2001, "C1")]]
    df = spark.createDataFrame(rows, "maker string, model string, engine string, first int, last int, code string")
    assert [tuple(r) for r in fitments.crossed(df).collect()] == [("A1", "B1", 2)]
    assert fitments.crossed(df, 1).where(F.col("b") == "C1").count() == 1


def test_fits_a_car_and_what_else_does(spark):
    rows = [("A1", "FIAT", "UNO", "1.0", 1990, 1995, 1, "plug"), ("A1", "FIAT", "UNO WAY", "1.3", 1999, None, 1, "plug"), ("B1", "FIAT", "UNO", "1.0", None, None, 2, "plug"), ("C1", "FIAT", "UNO", "1.0", None, None, 3, "filter"), ("D1", "FIAT", "UNO", "1.0", None, None, 1, "plug"), ("B1", "FIAT", "UNO WAY", "1.3", None, None, 2, "plug")]
    known = spark.createDataFrame(rows, "code string, maker string, model string, engine string, first int, last int, brand int, kind string")
    asks = [(1, "A1", "fiat", "uno", 1993), (2, "A1", "fiat", "uno", 1997), (3, "A1", "ford", "", None), (4, "Z9", "fiat", "uno", None), (5, "A1", "Fiat ", None, None), (6, "A1", None, "uno", 1993)]
    got = {r.ask: (r.fits, r.why, r.engines) for r in fitments.fits(spark.createDataFrame(asks, "ask int, code string, maker string, model string, year int"), known).collect()}
    assert got == {1: (True, None, ["1.0"]), 2: (False, "other year", []), 3: (False, "other car", []), 4: (None, "no data", []), 5: (True, None, ["1.0", "1.3"]), 6: (False, "other car", [])}
    products = spark.createDataFrame([(1, "A1"), (2, "B1"), (3, "B1"), (4, "C1"), (5, "D1")], "id long, code string")
    assert {tuple(r) for r in fitments.for_same_cars(spark.createDataFrame([("A1",), ("A1",)], "code string"), known, products).collect()} == {("A1", 2, 2), ("A1", 3, 2)}
