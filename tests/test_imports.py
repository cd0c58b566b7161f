import datetime as dt

from partloom.operators import imports
from partloom.sources import lists


def test_outcomes_and_merge(spark):
    old = spark.createDataFrame([("A1", 1, 10.0, 5), ("B2", 1, 10.0, 5), ("C3", 1, 10.0, 5), ("Z9", 2, 1.0, 1)], "code string, brand long, price double, stock int")
    new = spark.createDataFrame([(0, "A1", 1, 12.0, 6), (1, "B2", 1, 1000.0, 7), (2, "C3", 1, 10.0, 5), (3, "D4", 1, 3.0, 2), (4, "", 1, 3.0, 2), (5, "A1", 1, 11.0, 8), (6, "C3", 2, None, 4)], "row_no long, code string, brand long, price double, stock int")
    result = imports.outcomes(old, new)
    assert {(r.code, r.brand): r.outcome for r in result.collect()} == {("A1", 1): "price", ("B2", 1): "held", ("C3", 1): "same", ("D4", 1): "new", ("", 1): "no code", ("C3", 2): "new"}
    after = {(r.code, r.brand): (r.price, r.stock) for r in imports.merged_catalogue(old, result).collect()}
    assert after == {("A1", 1): (11.0, 8), ("B2", 1): (10.0, 7), ("C3", 1): (10.0, 5), ("D4", 1): (3.0, 2), ("C3", 2): (None, 4), ("Z9", 2): (1.0, 1)}


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a long, b long")


def test_pending(spark):
    out = imports.queue(pairs(spark, [(3, 4)]), pairs(spark, [(2, 1), (1, 2), (4, 3), (5, 5), (6, 7), (8, 9)]), pairs(spark, [(7, 6)]), pairs(spark, [(9, 8)]))
    assert [(r.a, r.b) for r in out.collect()] == [(1, 2)]
    joins = spark.createDataFrame([(1, 2, 500), (3, 4, 5)], "a long, b long, new_pairs long")
    safety = spark.createDataFrame([(9,)], "id long")
    ok = imports.approve(pairs(spark, [(1, 2), (3, 4), (5, 6), (8, 9)]), pairs(spark, [(5, 6)]), safety, joins)
    assert [(r.a, r.b) for r in ok.collect()] == [(3, 4)]


def test_merges_and_lists(spark):
    links = spark.createDataFrame([(1, 2, 50), (2, 3, 60), (1, 3, 70)], "a long, b long, conf long")
    out = imports.merge_products(links, spark.createDataFrame([(2, 1)], "loser long, winner long"))
    assert [(r.a, r.b, r.conf) for r in out.collect()] == [(1, 3, 70)]
    gone = imports.no_longer_declared(pairs(spark, [(1, 2), (1, 3), (4, 5)]), pairs(spark, [(1, 2)]), spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    assert [(r.a, r.b) for r in gone.collect()] == [(1, 3)]
    t = lambda n: dt.datetime(2024, 1, n)
    rep = spark.createDataFrame([("a", "b", t(1)), ("b", "c", t(1)), ("a", "x", t(0 + 1)), ("c", "a", t(2)), ("q", "r", t(1))], "old string, new string, seen timestamp")
    got = {r.code: (r.last, r.steps) for r in imports.replacement_ends(rep).collect()}
    assert got["a"] == ("x", 1) and got["b"] == ("x", 3) and got["q"] == ("r", 1)
    stock = spark.createDataFrame([(1, 5), (2, 1)], "id long, stock long")
    res = spark.createDataFrame([(1, 2, t(10)), (1, 2, t(1)), (2, 3, t(10))], "id long, units long, seen timestamp")
    assert {r.id: r.free for r in imports.free_stock(stock, res, "2024-01-12").collect()} == {1: 3, 2: 0}


def test_price_lists(spark, tmp_path):
    (tmp_path / "acme.csv").write_bytes("Lista de precios ACME;;;\nCódigo;Descripción;Precio;Stock\nA-100;Bomba de agua larga;1.234,50;5\nA-200;Filtro de aceite corto;99,90;12\n;;;\n".encode("cp1252"))
    (tmp_path / "bare.txt").write_text("X1001\tFiltro de aire para motor\t10.50\t7790001000019\nX1002\tCorrea de distribucion\t20.75\t7790001000026\n", encoding="utf-8")
    rows = lists.read_lists(spark, str(tmp_path)).cache()
    heads = lists.header_rows(rows)
    by_file = {r.file.rsplit("/", 1)[-1]: r.header for r in heads.collect()}
    assert by_file == {"acme.csv": 1, "bare.txt": None}
    titled = {(r.role, r.column) for r in lists.roles_by_title(rows, heads).collect()}
    assert titled == {("code", 0), ("description", 1), ("price", 2), ("stock", 3)}
    data = {(r.file.rsplit("/", 1)[-1], r.role): r.column for r in lists.roles_by_data(rows, heads).collect()}
    assert data["bare.txt", "code"] == 0 and data["bare.txt", "description"] == 1 and data["bare.txt", "price"] == 2 and data["bare.txt", "barcode"] == 3 and data["acme.csv", "price"] == 2
    seen = rows.where(rows.file.contains("acme")).select("hash")
    assert {r.file.rsplit("/", 1)[-1] for r in lists.not_imported(rows, seen).collect()} == {"bare.txt"}


def test_one_role_per_column(spark):
    rows = spark.createDataFrame([("f", "h", 0, ["CODIGO DE BARRAS", "CODIGO", "DESCRIPCION ARTICULO", "PRECIO"]), ("g", "h", 0, ["Articulo", "Cod.", "P. Lista", "EAN"])], "file string, hash string, row_no long, cells array<string>")
    heads = spark.createDataFrame([("f", 0), ("g", 0)], "file string, header long")
    got = {(r.file, r.role): r.column for r in lists.roles_by_title(rows, heads).collect()}
    assert got == {("f", "barcode"): 0, ("f", "code"): 1, ("f", "description"): 2, ("f", "price"): 3, ("g", "description"): 0, ("g", "code"): 1, ("g", "price"): 2, ("g", "barcode"): 3}


def test_separator_counts_all_lines():
    assert lists.separator("Prices, valid from\n" * 60 + "a;b;c\n" * 90) == ";"
