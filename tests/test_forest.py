"""Forests and widest paths against plain versions, on graphs with cycles."""

import heapq
import random

import pytest

from partloom.operators import forest, graph


def graph_of(seed, n, m, ties=5):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randint(1, ties) * 10) for _ in range(m)]


def kruskal(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    total = []
    for a, b, c in sorted(links, key=lambda e: -e[2]):
        if find(a) != find(b):
            up[find(a)] = find(b)
            total.append(c)
    return sorted(total)


def widest(links, s, t):
    step = {}
    for a, b, c in links:
        step.setdefault(a, []).append((b, c))
        step.setdefault(b, []).append((a, c))
    best, heap = {}, [(-100, s)]
    while heap:
        low, x = heapq.heappop(heap)
        if x in best:
            continue
        best[x] = -low
        for y, c in step.get(x, []):
            if y not in best:
                heapq.heappush(heap, (-min(-low, c), y))
    return best.get(t)


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 40, 90), (2, 60, 50)])
def test_random_graphs(spark, seed, n, m):
    links = graph_of(seed, n, m)
    df = spark.createDataFrame(links, "a long, b long, conf long")
    assert sorted(r.conf for r in forest.heaviest(df).collect()) == kruskal([e for e in links if e[0] != e[1]])
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(40)} | {(links[0][0], links[0][0])}
    best, steps = forest.widest_paths(df, spark.createDataFrame(sorted(pairs), "seed long, target long"))
    got = {(r.seed, r.target): (r.conf, r.hops) for r in best.collect()}
    chains = {}
    for r in steps.orderBy("step").collect():
        chains.setdefault((r.seed, r.target), []).append((r.step, r.a, r.b, r.conf))
    inside = {x for e in links for x in e[:2] if e[0] != e[1]}
    for s, t in pairs:
        want = widest(links, s, t)
        if want is None or not {s, t} <= inside:
            assert (s, t) not in got or s == t
            continue
        conf, hops = got[s, t]
        own = chains.get((s, t), [])
        assert conf == want and hops == len(own) and [x[0] for x in own] == list(range(1, hops + 1))
        assert [x[1] for x in own] + [t] == [s] + [x[2] for x in own]
        assert min([100, *[x[3] for x in own]]) == want
        assert all(max(c for a, b, c in links if {a, b} == {x[1], x[2]}) == x[3] for x in own)


def test_long_chain_star_and_links_to_avoid(spark):
    links = [(k, k + 1, 50 + k % 40) for k in range(100)] + [(1000, 1001 + k, 70) for k in range(200)] + [(0, 100, 20)]
    df = spark.createDataFrame(links, "a long, b long, conf long")
    pairs = spark.createDataFrame([(0, 100), (1005, 1100), (7, 1000), (20, 25)], "seed long, target long")
    best, steps = forest.widest_paths(df, pairs)
    assert {tuple(r) for r in best.collect()} == {(0, 100, 50, 100), (1005, 1100, 70, 2), (20, 25, 70, 5)}
    assert steps.count() == 107
    best, _ = forest.widest_paths(df, pairs, spark.createDataFrame([(51, 50)], "a long, b long"))
    assert {tuple(r) for r in best.collect()} == {(0, 100, 20, 1), (1005, 1100, 70, 2), (20, 25, 70, 5)}


def test_no_links(spark):
    df = spark.createDataFrame([(1, 1, 50)], "a long, b long, conf long")
    best, steps = forest.widest_paths(df, spark.createDataFrame([(1, 2)], "seed long, target long"))
    assert best.count() == steps.count() == 0


@pytest.mark.parametrize("small", [10_000, 3])
def test_networks_where_they_lie_and_by_rounds(spark, monkeypatch, small):
    """Rounds made hundreds of jobs whatever the size of the networks; both ways give the same paths."""
    monkeypatch.setattr(graph, "SMALL", small)
    links = [(a + 100 * n, b + 100 * n, c) for n in range(3) for a, b, c in graph_of(n, 9, 14)] + [(900, 901, 40), (901, 900, 60)]
    df = spark.createDataFrame(links, "a long, b long, conf long").repartition(3)
    pairs = {(a + 100 * n, b + 100 * n) for n in range(3) for a in (0, 3) for b in range(1, 9)} | {(0, 105), (900, 901), (555, 555)}
    spark.sparkContext.setJobGroup(f"widest{small}", "widest")
    best, steps = forest.widest_paths(df, spark.createDataFrame(sorted(pairs), "seed long, target long"))
    got = {(r.seed, r.target): r.conf for r in best.collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"widest{small}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {p: c for p in pairs if (c := 100 if p[0] == p[1] else widest(links, *p)) is not None}
    chains = {}
    for r in steps.orderBy("step").collect():
        chains.setdefault((r.seed, r.target), []).append(r)
    assert all(c[0].a == s and c[-1].b == t and min(x.conf for x in c) == got[s, t] for (s, t), c in chains.items()) and set(chains) == {p for p in got if p[0] != p[1]}
    assert small == 3 or jobs < 60
