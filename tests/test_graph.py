import random

from partloom.operators import evidence, graph


def brute(edges, seed, hops, least):
    """Best bottleneck within so many hops, then fewest hops."""
    found = {(seed, 0): 100}
    front = {(seed, 100)}
    best = {seed: (100, 0)}
    for h in range(1, hops + 1):
        nxt = set()
        for x, c in front:
            for a, b, w in edges:
                if w >= least:
                    for p, q in ((a, b), (b, a)):
                        if p == x:
                            nxt.add((q, min(c, w)))
        for q, c in nxt:
            if q not in best or c > best[q][0]:
                best[q] = (c, h)
        front = nxt
    return best


def test_closure_against_brute_force(spark):
    rng = random.Random(3)
    edges = [(a, b, rng.randint(20, 99)) for a, b in {tuple(sorted(rng.sample(range(25), 2))) for _ in range(45)}]
    df = spark.createDataFrame(edges, "a long, b long, conf long")
    seeds = spark.createDataFrame([(s,) for s in (0, 5, 24, 99)], "seed long")
    got = {(r.seed, r.id): (r.conf, r.hops) for r in graph.closure(df, seeds, 3, 30).collect()}
    want = {(s, i): v for s in (0, 5, 24, 99) for i, v in brute(edges, s, 3, 30).items()}
    assert got == want


def test_components_and_impact(spark):
    links = spark.createDataFrame([(1, 2, 60), (2, 3, 60), (5, 6, 60), (3, 3, 60)], "a long, b long, conf long")
    products = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    nets = graph.networks(products, links)
    assert {r.id: r.net for r in nets.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    pending = spark.createDataFrame([(1, 6), (1, 3), (4, 7)], "a long, b long")
    assert {(r.a, r.b): r.new_pairs for r in graph.joined_by(pending, nets).collect()} == {(1, 6): 6, (4, 7): 1}


def test_long_chain_and_star(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)], "u long, v long")
    got = {r.node: r.root for r in graph.components(chain).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1400))


def test_learned_evidence_may_not_cross_a_line(spark):
    fields = "a long, b long, code string, hanging long, measures string, same_text boolean, kit boolean, same_family boolean, worked long, catalogue boolean, lists long, approve_rate double, decisions long, price_deviation double, returned boolean"
    rows = [
        (1, 1, None, 0, None, False, False, None, 5, False, 0, 0.9, 20, 5.0, False),  # 50 plain; learned +50 stops under 55
        (2, 2, "K1234567", 1, "agree", False, False, True, 0, True, 2, 0.5, 0, 1.0, False),  # everything for it
        (3, 3, None, 0, "agree", False, False, False, 0, True, 2, 0.5, 0, 1.0, False),  # veto by family
        (4, 4, None, 0, "conflict", False, False, True, 0, False, 0, 0.5, 0, 5.0, False),  # capped where it stands, then +15
    ]
    got = {r.a: r for r in evidence.edge_score(spark.createDataFrame(rows, fields)).collect()}
    assert got[1].score == 54 and got[2].score == 100 and got[3].score == 20 and got[4].score == 20
    assert got[2].band == "high" and "veto" in got[3].reasons and "measures conflict" in got[4].reasons


def reach(n, edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            for p, q in ((a, b), (b, a)):
                if p == x and q not in seen:
                    seen.add(q)
                    todo.append(q)
    return seen


def test_cut_links_against_removal(spark):
    rnd = random.Random(3)
    pairs = sorted({tuple(sorted(rnd.sample(range(40), 2))) for _ in range(42)})
    want = set()
    for e in pairs:
        rest = [x for x in pairs if x != e]
        one, other = reach(40, rest, e[0]), reach(40, rest, e[1])
        if e[1] not in one and min(len(one), len(other)) >= 2:
            want.add((*e, min(len(one), len(other))))
    # Stored both ways, repeated, and with a link to itself.
    rows = [(a, b, 50) for a, b in pairs] + [(b, a, 60) for a, b in pairs[:9]] + [(7, 7, 90)]
    got = graph.cut_links(spark.createDataFrame(rows, "a long, b long, conf long"), 2).collect()
    assert want and {(r.a, r.b, r.smaller) for r in got} == want
    assert graph.cut_links(spark.createDataFrame([], "a long, b long, conf long")).count() == 0


def test_widest_against_thresholds(spark):
    rnd = random.Random(5)
    edges = [(*rnd.sample(range(12), 2), rnd.randrange(30, 100)) for _ in range(20)]
    pairs = [(a, b) for a in range(0, 12, 3) for b in range(12) if a != b]
    got = {(r.seed, r.target): r.conf for r in graph.widest(spark.createDataFrame(edges, "a long, b long, conf long"), spark.createDataFrame(pairs, "seed long, target long")).collect()}
    want = {}
    for c in sorted({x[2] for x in edges}):
        for a, b in pairs:
            if b in reach(12, [x[:2] for x in edges if x[2] >= c], a):
                want[a, b] = c
    assert got == want


def test_cut_links_take_few_jobs_and_large_networks_go_by_levels(spark, monkeypatch):
    """A round for each level made jobs in proportion to the longest chain."""
    rows = [(100 * n + k, 100 * n + k + 1, 50) for n in range(20) for k in range(30)] + [(5000 + k, 5000 + (k + 1) % 40, 50) for k in range(40)]
    df = spark.createDataFrame(rows, "a long, b long, conf long").repartition(7)
    want = {(100 * n + k, 100 * n + k + 1, min(k + 1, 30 - k)) for n in range(20) for k in range(2, 28)}
    spark.sparkContext.setJobGroup("cut", "cut")
    got = graph.cut_links(df, 3).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cut"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {tuple(r) for r in got} == want and len(got) == len(want) and jobs < 60
    monkeypatch.setattr(graph, "SMALL", 5)
    small = spark.createDataFrame([r for r in rows if r[0] < 200 or r[0] >= 5000] + [(9000, 9001, 1)], "a long, b long, conf long")
    assert {tuple(r) for r in graph.cut_links(small, 3).collect()} == {w for w in want if w[0] < 200}


def test_labels_equal_components(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(150)] + [(7, 7)]
    for parts in (1, 9):
        df = spark.createDataFrame(rows, "u long, v long").repartition(parts)
        assert {tuple(r) for r in graph.labels(df).collect()} == {tuple(r) for r in graph.components(df).collect()}
