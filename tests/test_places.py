"""Walking distances and free places against a plain search."""

import random
from collections import deque

from partloom.operators import places


def walked(free, starts):
    best, todo = {s: 0 for s in starts if s in free}, deque(s for s in starts if s in free)
    while todo:
        f, x, y = todo.popleft()
        for n in ((f, x + 1, y), (f, x - 1, y), (f, x, y + 1), (f, x, y - 1)):
            if n in free and n not in best:
                best[n] = best[f, x, y] + 1
                todo.append(n)
    return best


def test_steps(spark):
    rng = random.Random(5)
    cells = [(f, x, y, rng.random() < 0.7) for f in range(3) for x in range(7) for y in range(6)]
    starts = [(0, 0, 0), (0, 6, 5), (1, 3, 3), (2, 9, 9)]
    free = {c[:3] for c in cells if c[3]}
    df = spark.createDataFrame(cells + cells[:9], "floor int, x int, y int, free boolean")
    got = {(r.floor, r.x, r.y): r.steps for r in places.steps(df, spark.createDataFrame(starts, "floor int, x int, y int")).collect()}
    assert got == walked(free, starts)


def test_free_and_suggested_places(spark):
    walk = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 1), (0, 2, 0, 2)], "floor int, x int, y int, steps int")
    shelves = spark.createDataFrame([(0, 0, 7, 1, 1, 1, 4), (0, 0, 8, 1, 3, 0, 1), (0, 0, 9, 1, 9, 9, 2)], "depot int, floor int, shelf int, module int, x int, y int, levels int")
    taken = spark.createDataFrame([(7, 1, 2)], "shelf int, module int, level int")
    free = places.free_places(shelves, walk, taken)
    assert sorted((r.shelf, r.level, r.cost) for r in free.collect()) == [(7, 1, 14), (7, 3, 6), (7, 4, 18), (8, 1, 15)]
    products = spark.createDataFrame([(1, 5, 0, 0), (2, 9, 0, 1), (3, 0, 9, 0), (4, 0, 2, 3), (5, 5, 1, 0)], "id long, sold long, asked int, stock int")
    assert [(r["rank"], r.id, r.shelf, r.level) for r in places.suggested(products, free, 3).orderBy("rank").collect()] == [(1, 2, 7, 3), (2, 5, 7, 1), (3, 1, 8, 1)]
