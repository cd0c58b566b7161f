"""Whole results of joins against plain versions: no pair that a rule takes is left out, and none is made twice."""

import random
from itertools import product

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from partloom.functions import staging
from partloom.llm import simhash
from partloom.operators import fitments, graph, rare_words, rescoring
from partloom.sources.views import Views


def test_every_ask_meets_every_fitment_of_its_code(spark):
    """Each ask against all that catalogues say of its code. Only an empty maker, or one that no car has, fits no car."""
    rng = random.Random(8)
    codes, makers, models = ["A1", "B1", "C1"], ["FIAT", "FORD", "FIAT IVECO"], ["UNO", "UNO WAY", "KA"]
    known = [(rng.choice(codes[:2]), rng.choice(makers), rng.choice(models), rng.choice(["", "1.0", "1.3"]), rng.choice([None, 1990, 1995]), rng.choice([None, 1993, 1999])) for _ in range(12)] * 2
    asks = [(k, *x) for k, x in enumerate(product(codes, ["fiat", " Ford ", "", None, "opel"], ["uno", "", None, " way"], [None, 1989, 1994, 2001]))]
    got = {r.ask: (r.fits, r.why, tuple(r.engines)) for r in fitments.fits(spark.createDataFrame(asks, "ask int, code string, maker string, model string, year int"), spark.createDataFrame(known, "code string, maker string, model string, engine string, first int, last int")).collect()}
    want = {}
    for ask, code, maker, model, year in asks:
        said = [k[1:] for k in known if k[0] == code]
        maker, model = (maker or "").strip().upper(), (model or "").strip().upper()
        cars = [k for k in said if maker and maker in k[0] and model in k[1]]
        good = [k for k in cars if year is None or (k[3] is None or k[3] <= year) and (k[4] is None or k[4] >= year)]
        why = "no data" if not said else "other car" if not cars else "other year" if not good else None
        want[ask] = (bool(good) if said else None, why, tuple(sorted({k[2] for k in good} - {""})))
    assert got == want and len(got) == len(asks)


def test_two_hops_against_all_pairs(spark):
    """Every pair within two links once, brands of several products and links written twice or to themselves among them."""
    rng = random.Random(7)
    brand = {k: rng.choice([1, 2, 3, None]) for k in range(30)}
    links = [(a, b, brand[a], brand[b]) for a, b in [(rng.randrange(30), rng.randrange(30)) for _ in range(25)] for _ in range(rng.choice([1, 2]))] + [(None, 5, None, brand[5]), (4, None, brand[4], None)]
    df = spark.createDataFrame(links, "a long, b long, brand_a long, brand_b long")
    step = {(a, b) for x, y, *_ in links if x is not None and y is not None for a, b in ((x, y), (y, x))}
    want = {(a, b) for a, b in step | {(a, d) for a, b in step for c, d in step if b == c} if a != b}
    got = [tuple(r) for r in graph.two_hops(df).select("a", "b").collect()]
    assert len(got) == len(set(got)) and {x for a, b in got for x in ((a, b), (b, a))} == want
    said = {r.brand: (r.reached, r.pairs) for r in graph.reached_brands(df).collect()}
    of = {}
    for a, b in want:
        of.setdefault(brand[a], []).append(brand[b])
    assert said == {k: (len(set(v) - {None}), len(v)) for k, v in of.items()}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_brands_come_with_links(spark):
    """Pairs within two links were dealt out again for the brand of each product, and products twice for their links."""
    v = Views(spark, "/root/testdata/sf0.001")
    assert exchanges(v.links) <= 1
    assert exchanges(graph.reached_brands(v.branded_links)) <= 8


def test_pairs_are_dealt_out_once_for_each_of_their_two(spark):
    """Pairs went with texts and sizes through joins by product, by bridge and by brands. Prices that are nothing, equal
    descriptions, and pairs written twice or the other way round among the rows."""
    make = spark.createDataFrame
    products = make([(k, k % 3, k % 4 == 0, f"C{k}", ["RETEN EJE 30x50x7 largo", None, "KIT BOMBA"][k % 3]) for k in range(12)], "id long, brand long, oem boolean, code string, text string")
    links = [(a, b) for a in range(12) for b in range(12) if a < b and (a + b) % 3 < 2]
    prices = make([(k, float(k)) for k in range(9)], "id long, price double")
    none = {"declared": make([], "a long, b long, list string"), "fitments": make([], "id long, car string"), "bought": make([], "a long, b long, times long, returned boolean"), "decisions": make([], "brand_a long, brand_b long, approved boolean")}
    before = set(staging._written)
    got = rescoring.gathered(make([*links, *[(b, a) for a, b in links[::2]]], "a long, b long"), products, make(links, "a long, b long"), [("BOMBA", "pumps"), ("RETEN", "gaskets")], prices=prices, scales=make([], "brand long, scale double"), **none)
    rows = {(r.a, r.b): r for r in got.collect()}
    degree = {k: sum(k in x for x in links) for k in range(12)}
    for a, b in links:
        r, node = rows.pop((a, b)), a if a % 4 == 0 else b if b % 4 == 0 else None
        off = max(a, b) / min(a, b) if 0 < min(a, b) and max(a, b) < 9 else None
        assert (r.code, r.hanging) == ((None, 0) if node is None else (f"C{node}", degree[node]))
        assert (r.price_deviation is None) == (off is None) and (off is None or abs(r.price_deviation - off) < 1e-9)
        assert (r.same_text, r.kit) == (a % 3 == b % 3 == 0, (a % 3 == 2) != (b % 3 == 2))
    assert not rows
    wrote = {p.rsplit("-", 1)[1] for p in staging._written if p not in before}
    assert wrote == {"described", "approve_rates"}  # no pairs are written with what their texts say


def test_a_name_goes_to_a_task_once():
    """A name's bitmap went with each of its rare words; now once to each task that has some of them, and no word is left out."""
    base, tasks = 10_000, 8
    names = [np.sort(np.array([3 * base + x for x in range(k, k + 300, 3)] + [1 * base + 9000 + k, 300 * base + 1])) for k in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x"] * 5), pa.array([n.tolist() for n in names], pa.list_(pa.int64()))], names=["id", "brand", "w"])
    rows = [r for b in rare_words._keys(iter([batch]), 0.5, 250, base, tasks) for r in b.to_pylist()]
    assert len(rows) <= 5 * tasks and len({(r["id"], r["task"]) for r in rows}) == len(rows)
    for k, n in enumerate(names):
        first = len(n) - -(-len(n) // 2) + 1
        want = {(int(x) % base, at) for at, x in enumerate(n[:first]) if 2 <= x // base <= 250}
        own = [r for r in rows if r["id"] == k]
        assert {(w, at) for r in own for w, at in zip(r["words"], r["ats"])} == want and sum(len(r["words"]) for r in own) == len(want)
        assert {w % tasks for r in own for w in r["words"] if r["task"] != w % tasks} == set()


def test_pairs_within_the_radius_alone_are_looked_at():
    """Sizes, labels and bitmaps were read for every pair of a run; now for those within the radius, and the same pairs are left."""
    rng = np.random.default_rng(3)
    n = 200
    f = rng.integers(0, 1 << 62, 5).astype(np.uint64)[rng.integers(0, 5, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    size, label, bits = rng.integers(60, 120, n), rng.integers(0, 40, n), rng.integers(0, 1 << 62, (2, 8)).astype(np.uint64)[rng.integers(0, 2, n)]
    search, left = simhash.Search(3, 0.8, 1), 0
    for x in range(n):
        want = []
        for y in range(n):
            common = min(int(size[x]) - sum((int(p) & ~int(q)).bit_count() for p, q in zip(bits[x], bits[y])), int(size[y]) - sum((int(q) & ~int(p)).bit_count() for p, q in zip(bits[x], bits[y])))
            if (int(f[x]) ^ int(f[y])).bit_count() <= 3 and common >= 0.8 / 1.8 * (int(size[x]) + int(size[y])) - 1e-6 and label[x] != label[y]:
                want.append(y)
        got = search.hits(f, size, bits, label, slice(x, x + 1), slice(0, None)).tolist()
        at = np.arange(n)
        assert got == want == search.hits(f, size, bits, label, np.full(n, x), at).tolist()
        left += len(want)
    assert n < left < n * n / 4
