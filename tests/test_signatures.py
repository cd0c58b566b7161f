"""Pairs of descriptions that are one part, or not and why."""

import pytest

from partloom.operators import signatures

GOLDEN = [
    ("Jta.Tapa Cil. Renault Master motor G9U 2463cc", "Junta Tapa de Cilindros RENAULT MASTER TRAFIC - 2,5 - G9U720", None), ("Jta.Carter DEUTZ F5L 913", "Junta para Cárter DEUTZ 913 TRACTOR 5 CIL. F5L", None),
    ("SENSOR DE ROTACION HYUNDAI ACCENT ELANTRA", "Sensor rotacion Hyundai Elantra Accent", None), ("Jta.Carter DEUTZ F4L 913", "Junta Carter DEUTZ F5L 913", "engine"), ("Junta Tapa Cil. FIAT 1.6 PALIO", "Junta Tapa Cilindros FIAT PALIO 1,3", "litres"),
    ("Relay universal 12V HELLA", "Relay universal 24 V HELLA", "volts"), ("Bomba combustible FORD KA 120 L/H", "Bomba combustible FORD KA 128 L/H", None), ("Bomba combustible FORD KA 120 L/H", "Bomba combustible FORD KA 200 L/H", "flow"),
    ("Alternador FIAT UNO reconstruido", "Alternador FIAT UNO", "rebuilt"), ("KIT CORREA DISTRIBUCION FORD KA", "CORREA DISTRIBUCION FORD KA", "set"), ("Bomba agua FIAT UNO delantera", "Bomba agua FIAT UNO trasera", "position"),
    ("Juntas Carburador FIAT 125", "Juntas Carburador FIAT 1600/128", "model"), ("Juntas Carburador FIAT 147 DUNA", "Juntas Carburador FIAT 128 EUROPA 147 DUNA", None), ("Bujia nafta RENAULT CLIO", "Bujia nafta BMW SERIE", "car"),
    ("Jta.Tapa Cil. HONDA CIVIC 1984/1989", "Junta Tapa Cilindros HONDA CIVIC 2015/...", "years"), ("Junta Tapa Valvulas FORD FIESTA diesel", "Junta Tapa Valvulas FORD FIESTA nafta", "fuel"), ("Junta Tapa Cilindros FIAT FIRE 8V", "Junta Tapa Cilindros FIAT FIRE 16V", "valves"),
    ("Filtro aceite FORD KA", "Bomba aceite FORD KA", "other family"), ("Sensor MAP FORD KA", "Sonda MAP FORD KA", "other part"), ("Junta escape FORD F100", "Junta admision FORD F100", "other place"), ("Junta escape FORD F100", "Junta FORD F100", "no place"),
    ("Junta Tapa Cilindros FORD KA", "Junta Tapa Cilindros", "no car"), ("Junta Tapa Cilindros FORD 1.6", "Junta Tapa Cilindros reconstruida", "rebuilt"), ("Cosa rara FORD", "Cosa rara FORD", "no family"), ("Filtro FORD", "Filtro FORD", "few words"), ("", "Filtro FORD", "no text"),
    ("Junta Carter DEUTZ 4 CIL.", "Junta Carter DEUTZ 5 CIL.", "cylinders"), ("Sensor oxigeno FORD KA 4 cables 36 cm", "Sensor oxigeno FORD KA 4 cables 63 cm", "length"), ("Sensor oxigeno FORD KA 36 cm", "Sensor oxigeno 63 cm", "length"), ("Tapa rosca M14 X 1.5 filtro FIAT", "Tapa rosca M16x1,5 filtro FIAT", "thread"),
]


@pytest.fixture(scope="module")
def decided(spark):
    rows = spark.createDataFrame([(k, s, t) for k, (a, b, _) in enumerate(GOLDEN) for s, t in (("a", a), ("b", b))], "k int, side string, text string")
    sig = signatures.signed(rows)
    pairs = sig.where("side = 'a'").selectExpr("k", "signature signature_a").join(sig.where("side = 'b'").selectExpr("k", "signature signature_b"), "k")
    return {r.k: r for r in signatures.compared(pairs).collect()}


@pytest.mark.parametrize("k", range(len(GOLDEN)))
def test_pairs(decided, k):
    assert decided[k].why == GOLDEN[k][2] and decided[k].same == (GOLDEN[k][2] is None)
    assert decided[k].doubt == (GOLDEN[k][2] in ("no place", "no car"))


def test_both_ways_alike(spark, decided):
    rows = spark.createDataFrame([(k, s, t) for k, (a, b, _) in enumerate(GOLDEN) for s, t in (("b", a), ("a", b))], "k int, side string, text string")
    sig = signatures.signed(rows)
    pairs = sig.where("side = 'a'").selectExpr("k", "signature signature_a").join(sig.where("side = 'b'").selectExpr("k", "signature signature_b"), "k")
    for r in signatures.compared(pairs).collect():
        assert (r.why, r.same, r.strength) == (decided[r.k].why, decided[r.k].same, decided[r.k].strength)
