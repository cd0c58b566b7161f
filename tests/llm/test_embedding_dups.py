"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from partloom.llm import embedding_dups


def brute(rows, similarity):
    usable = [k for k, (i, e, label) in enumerate(rows) if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for n, a in enumerate(usable):
        for b in usable[n + 1 :]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= similarity:
                    links[a] += 1
                    links[b] += 1
                    up[find(b)] = find(a)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, links[k], least.get(find(k)), i == least.get(find(k))) for k, (i, *_) in enumerate(rows)), key=repr)


def check(spark, rows, kind="float", similarity=0.93):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    got = sorted((tuple(r) for r in embedding_dups.near_vectors(df, similarity=similarity, miss=1e-7).collect()), key=repr)
    assert got == brute([tuple(r) for r in df.collect()], similarity)
    return got


def clouds(rng, sizes, length, spread):
    """Groups of vectors around directions of their own."""
    out = []
    for n, s in zip(sizes, spread):
        out += list(rng.normal(size=length) + s * rng.normal(size=(n, length)))
    return out


def test_odd_rows(spark):
    x = [1.0, 2.0, 3.0]
    rows = [
        (5, x, 1), (3, x, 1), (3, x, 1), (9, [2.0, 4.0, 6.0], 1), (1, x, 2), (2, x, None), (None, x, 3), (None, x, 3), (4, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1),
        (8, [1.0, None, 3.0], 1), (10, [1.0, float("nan"), 3.0], 1), (11, [1.0, float("inf"), 3.0], 1), (12, [1.0, 2.0], 1), (None, [5.0, 1.0], 4), (13, [5.0, 1.0], 4),
    ]
    got = check(spark, rows, "double")
    assert (3, 3, 3, True) in got and (None, 1, None, True) in got and (None, 1, 13, False) in got


def test_empty_table_and_other_columns(spark):
    assert embedding_dups.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 5, "a"), (2, [1.0, 0.0], 1, 6, "b")], "vec_id long, embedding array<double>, label int, node int, component_id string")
    assert sorted(map(tuple, embedding_dups.near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


@pytest.mark.parametrize("spread", [0.02, 0.1, 0.25])
def test_groups(spark, spread):
    rng = np.random.default_rng(int(spread * 100))
    vectors = clouds(rng, [60, 30, 5, 1, 1, 40], 24, [spread] * 6)
    rows = [(int(k), [float(np.float32(x)) for x in v], int(k) % 2) for k, v in zip(rng.permutation(len(vectors)), vectors)]
    check(spark, rows + rows[:20])


def test_parts_of_large_buckets_and_cells(spark, monkeypatch):
    """Cells that merge, buckets dealt to several tasks, and a cell that fills them."""
    monkeypatch.setattr(embedding_dups, "LARGE", 40)
    monkeypatch.setattr(embedding_dups, "CELL", 4)
    monkeypatch.setattr(embedding_dups, "BLOCK", 16)
    monkeypatch.setattr(embedding_dups, "BUCKET", 400)
    rng = np.random.default_rng(8)
    vectors = clouds(rng, [250, 90, 60], 16, [0.03, 0.2, 0.3])
    check(spark, [(k, v.tolist(), 1) for k, v in enumerate(vectors)], "double")


def test_cells_are_linked_throughout(spark):
    rng = np.random.default_rng(4)
    vectors = np.array(clouds(rng, [300, 200], 16, [0.05, 0.15]))
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(vectors)], "i long, e array<double>, label int")
    distinct = embedding_dups.usable(df, "i", "e", "label").selectExpr("label", "v", "i least", "1L copies")
    nodes = embedding_dups.staged(embedding_dups.coded(distinct, "<f8", 4, 6, 1), "nodes")
    of = dict(map(tuple, embedding_dups.cells(nodes, "<f8", 0.93, 6).collect()))
    at = {r.node: r.least for r in nodes.collect()}
    assert len(of) > 250
    for cell in set(of.values()):
        x = vectors[[at[n] for n, c in of.items() if c == cell]]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert (x @ x.T >= 0.93).all()


def test_number_of_tables():
    for n in (1, 5_000, 10**9):
        bits, number = embedding_dups.tables(n, 0.93, 1e-4)
        same = (1 - np.arccos(0.93) / np.pi) ** bits
        assert (1 - same) ** number <= 1e-4 < (1 - same) ** (number - 1)
