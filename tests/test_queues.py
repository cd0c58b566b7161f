"""The order of a review queue, and codes that join several families."""

from partloom.operators import queues


def test_order(spark):
    nets = spark.createDataFrame([(i, 1) for i in range(1, 9)] + [(i, 10) for i in range(10, 19)] + [(20, 20), (21, 21), (22, 22), (23, 23)], "id long, net long")
    rows = [(1, 1, 10, 1, 2, "x", ["kit"], 10), (1, 20, 21, 1, 2, "x", [], 60), (1, 20, 22, 1, 2, "x", ["price"], 50), (1, 20, 23, 1, 2, "x", ["kit", "price"], 90), (1, 21, 23, 3, 4, None, ["price"], 10), (1, 1, 2, 1, 2, "x", [], 70), (2, 1, 10, 1, 2, "x", [], 5)]
    pending = spark.createDataFrame(rows, "lot int, a long, b long, brand_a int, brand_b int, family string, alarms array<string>, conf int")
    rates = spark.createDataFrame([("price", 0.9), ("kit", 0.1)], "alarm string, rate double")
    got = [tuple(r) for r in queues.review_order(pending, nets, rates, 60).orderBy("lot", "place").collect()]
    one = [(1, 10, "joins networks"), (20, 22, "1 / 2 / x"), (1, 2, "1 / 2 / x"), (20, 21, "1 / 2 / x"), (20, 23, "1 / 2 / x"), (21, 23, "3 / 4 / ?")]
    assert got == [(1, *x, k + 1) for k, x in enumerate(one)] + [(2, 1, 10, "joins networks", 1)]
    assert sorted(map(tuple, queues.bridges_of_lots(pending, nets, 60).collect())) == [(1, 1, 10, 72), (2, 1, 10, 72)]


def test_suspicious_bridges(spark):
    texts = ["RETEN EJE", "RETEN", "Bomba agua", "KIT BOMBA", "cosa", "RETEN", "RETEN", "Filtro", None]
    products = [(100, True, "x"), (200, True, "y"), (300, True, "z"), (400, True, "w")] + [(i, False, t) for i, t in enumerate(texts)]
    links = [(100, i) if i % 2 else (i, 100) for i in range(6)] + [(200, i) for i in (0, 2, 7, 8)] + [(300, i) for i in (0, 1, 2, 3, 4)] + [(400, i) for i in (0, 2, 7)]
    p, e = spark.createDataFrame(products, "id long, oem boolean, text string"), spark.createDataFrame(links, "a long, b long")
    got = sorted(tuple(r) for r in queues.suspicious_bridges(p, e, [("BOMBA", "pumps"), ("RETEN", "gaskets"), ("FILTRO", "filters")]).collect())
    assert got == [(100, 6, ["gaskets", "pumps"], True, False), (200, 4, ["filters", "gaskets", "pumps"], False, True)]
