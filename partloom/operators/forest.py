"""Widest paths: the heaviest spanning forest of links, rooted by its tours, and paths by doubled steps.

Of all chains between two products, one whose weakest link is strongest runs through the heaviest forest.
Every part takes as many rounds as the logarithm of what it works on: trees are merged (each takes its
best link), a tour of each tree is ranked by doubled pointers, which tells parents, and paths are made of steps
of 2, 4, 8, ... links. Each round's table is written, so lineage is cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.staging import staged
from partloom.operators.graph import by_size, canonical, components, in_networks, labels


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def heaviest(links: DataFrame, avoid: DataFrame | None = None) -> DataFrame:
    """a, b, conf: the links of a forest that joins all that links join, of greatest confidence; of equals the least pair.
    links: a, b, conf. avoid: a, b, in either order, links that no path may take."""
    edges = canonical(links)
    if avoid is not None:
        edges = edges.join(avoid.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    # u, v: the trees that a link's ends are in.
    edges = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct("conf", F.negative("a").alias("x"), F.negative("b").alias("y")).alias("e")), "edges")
    chosen = []
    while not edges.isEmpty():
        both = edges.select("u", "v", "e").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        best = staged(both.groupBy("u").agg(F.max(F.struct("e", "v")).alias("m")).select("u", "m.v", "m.e"), "best_links")
        chosen.append(best.select(F.negative("e.x").alias("a"), F.negative("e.y").alias("b"), F.col("e.conf").alias("conf")))
        into = components(best.select("u", "v"))
        moved = edges.join(into.toDF("u", "p"), "u").join(into.toDF("v", "q"), "v").where("p <> q")
        # Trees that have met are one node, and of the links between two trees only the best goes on.
        edges = staged(moved.groupBy(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).agg(F.max("e").alias("e")), "edges")
    if not chosen:
        return edges.select(F.negative("e.x").alias("a"), F.negative("e.y").alias("b"), F.col("e.conf").alias("conf"))
    return staged(_union(chosen).distinct(), "forest")


def rooted(forest: DataFrame) -> DataFrame:
    """node, parent, conf: every node but the root of its tree, which is its least one.

    A tour goes along each link there and back: after coming to a node it goes on to the next neighbour in order. How far
    each step is from the tour's end tells which of a link's two directions comes first, and so which end is the parent."""
    step = forest.select(F.col("a").alias("u"), F.col("b").alias("v"), "conf").unionByName(forest.select(F.col("b").alias("u"), F.col("a").alias("v"), "conf"))
    around = Window.partitionBy("u")
    turn = step.select("u", "v", F.coalesce(F.lead("v").over(around.orderBy("v")), F.min("v").over(around)).alias("w"))
    # The step after u -> v is v -> w, where w follows u among v's neighbours.
    tour = step.join(turn.select(F.col("u").alias("v"), F.col("v").alias("u"), "w"), ["u", "v"])
    roots = components(forest.select(F.col("a").alias("u"), F.col("b").alias("v"))).where("node = root").select(F.col("root").alias("v"))
    starts = step.join(roots.select(F.col("v").alias("u")), "u").groupBy(F.col("u").alias("v")).agg(F.min("v").alias("w")).withColumn("last", F.lit(True))
    tour = tour.join(starts, ["v", "w"], "left").select("u", "v", "conf", F.when(F.col("last").isNull(), F.col("v")).alias("su"), F.when(F.col("last").isNull(), F.col("w")).alias("sv"))
    rank = staged(tour.withColumn("far", F.col("su").isNotNull().cast("long")), "tour")
    while not (open_ := rank.where("su is not null")).isEmpty():
        after = rank.select(F.col("u").alias("su"), F.col("v").alias("sv"), F.col("su").alias("tu"), F.col("sv").alias("tv"), F.col("far").alias("more"))
        moved = open_.join(after, ["su", "sv"]).select("u", "v", "conf", F.col("tu").alias("su"), F.col("tv").alias("sv"), (F.col("far") + F.col("more")).alias("far"))
        rank = staged(moved.unionByName(rank.where("su is null")), "tour")
    back = rank.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("far").alias("back"))
    return staged(rank.join(back, ["u", "v"]).where("far > back").select(F.col("v").alias("node"), F.col("u").alias("parent"), "conf"), "parents")


def _steps(parents: DataFrame) -> list[DataFrame]:
    """Tables of steps of 1, 2, 4, ... links towards the root: node, at (where it ends), low (the weakest link on it)."""
    tables = [parents.select("node", F.col("parent").alias("at"), F.col("conf").alias("low"))]
    while True:
        last = tables[-1]
        twice = last.join(last.toDF("at", "to", "then"), "at").select("node", F.col("to").alias("at"), F.least("low", "then").alias("low"))
        twice = staged(twice, "steps")
        if twice.isEmpty():
            return tables
        tables.append(twice)


def _depths(nodes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """node, top (the root), depth."""
    rows = nodes.select("node", F.col("node").alias("top"), F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(tables))):
        hop = tables[k].select(F.col("node").alias("top"), F.col("at"))
        rows = rows.join(hop, "top", "left").select("node", F.coalesce("at", "top").alias("top"), (F.col("depth") + F.when(F.col("at").isNotNull(), 1 << k).otherwise(0)).alias("depth"))
    return rows


def _climbed(rows: list[tuple[int, int, int | None]], whole: bool) -> list[tuple]:
    """What widest_paths() gives for one network, by a tree of its heaviest links. rows: a, b, conf of links, and seed, target,
    null of pairs. whole: the links of the chains instead of their weakest and number."""
    best: dict[tuple[int, int], int] = {}
    for a, b, c in rows:
        if c is not None:
            best[a, b] = max(c, best.get((a, b), c))
    top: dict[int, int] = {}

    def find(x):
        while (y := top.get(x, x)) != x:
            top[x] = x = top.get(y, y)
        return x

    step: dict[int, list[tuple[int, int]]] = {}
    for (a, b), c in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        if (x := find(a)) != (y := find(b)):
            top[x] = y
            step.setdefault(a, []).append((b, c))
            step.setdefault(b, []).append((a, c))
    up: dict[int, tuple[int | None, int, int]] = {}
    for start in step:
        todo = [] if start in up else [(start, None, 0, 0)]
        while todo:
            x, p, c, deep = todo.pop()
            up[x] = p, c, deep
            todo += [(y, x, k, deep + 1) for y, k in step[x] if y != p]
    out = []
    for s, t in {(a, b) for a, b, c in rows if c is None}:
        x, y, rise, fall = s, t, [], []
        if s not in up or t not in up:
            continue
        while x != y and x is not None and y is not None:
            if up[x][2] >= up[y][2]:
                rise.append((x, up[x][0], up[x][1]))
                x = up[x][0]
            else:
                fall.append((up[y][0], y, up[y][1]))
                y = up[y][0]
        if x != y or x is None:
            continue
        chain = rise + fall[::-1]
        out += [(s, t, k, *e) for k, e in enumerate(chain, 1)] if whole else [(s, t, min([100, *(c for _, _, c in chain)]), len(chain))]
    return out


#: Links times pairs of a network up to which its pairs are climbed one by one.
STEPS = 50_000_000


def widest_paths(links: DataFrame, pairs: DataFrame, avoid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """For pairs (seed, target) that chains join: seed, target, conf (of the weakest link of a widest chain; 100 for a product
    itself) and hops (links of that chain); and its links in order: seed, target, step, a, b, conf. Networks of few links are
    looked at where they lie, the others by rounds."""
    own = links.where("a <> b").select(*[F.col(c).cast("long").alias(c) for c in ("a", "b", "conf")])
    if avoid is not None:
        own = own.join(avoid.select("a", "b").unionByName(avoid.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    # As they lie, links of one network are often in one task: pairs are made one again within the network.
    own = staged(own, "links")
    nets = labels(own.select(F.col("a").alias("u"), F.col("b").alias("v")))
    wanted = pairs.select(F.col("seed").cast("long").alias("seed"), F.col("target").cast("long").alias("target")).distinct()
    inside = wanted.where("seed <> target").join(nets.toDF("seed", "net"), "seed").join(nets.toDF("target", "net_t"), "target").where("net = net_t").select("net", "seed", "target")
    inside = staged(inside, "pairs")
    small, large = by_size(own, nets, inside.groupBy("net").agg(F.count("*").alias("pairs")), STEPS)
    none = F.lit(None).cast("long")
    rows = small.select("net", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "conf").unionByName(inside.select("net", F.col("seed").alias("a"), F.col("target").alias("b"), none.alias("conf")))
    best = in_networks(rows, lambda r: _climbed(r, False), "seed long, target long, conf long, hops long")
    chain = in_networks(rows, lambda r: _climbed(r, True), "seed long, target long, step long, a long, b long, conf long")
    if not large.isEmpty():
        far, far_links = widest_by_rounds(large, inside.select("seed", "target"))
        best = best.unionByName(far.select("seed", "target", F.col("conf").cast("long").alias("conf"), F.col("hops").cast("long").alias("hops")))
        chain = chain.unionByName(far_links.select(*[F.col(c).cast("long").alias(c) for c in chain.columns]))
    own_ends = wanted.where("seed = target").select("seed", "target", F.lit(100).cast("long").alias("conf"), F.lit(0).cast("long").alias("hops"))
    return best.unionByName(own_ends), chain


def widest_by_rounds(links: DataFrame, pairs: DataFrame, avoid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As widest_paths(), for networks of any size: by steps of the rooted forest."""
    parents = rooted(heaviest(links, avoid))
    tables = _steps(parents)
    wanted = staged(pairs.select("seed", "target").distinct(), "pairs")
    depth = staged(_depths(wanted.select(F.explode(F.array("seed", "target")).alias("node")).distinct(), tables), "depths")
    rows = wanted.join(depth.toDF("seed", "top", "ds"), "seed").join(depth.toDF("target", "top_t", "dt"), "target").where("top = top_t")
    # s and t climb; ds and dt are their depths by now, low the weakest link so far. Legs are what they have climbed.
    rows = staged(rows.select("seed", "target", F.col("seed").alias("s"), F.col("target").alias("t"), "ds", "dt", F.lit(100).cast("long").alias("low"), F.col("ds").alias("from_s"), F.col("dt").alias("from_t")), "climb")
    columns, legs = rows.columns, []
    # First the deeper end climbs to the depth of the other, by the bits of the difference.
    for k in reversed(range(len(tables))):
        up = tables[k].toDF("node", "at", "got")
        deeper, far = F.when(F.col("ds") >= F.col("dt"), "s").otherwise("t"), F.abs(F.col("ds") - F.col("dt"))
        tried = rows.withColumns({"side": F.when(far >= 1 << k, deeper), "end": F.when(far >= 1 << k, F.when(F.col("ds") >= F.col("dt"), F.col("s")).otherwise(F.col("t")))})
        tried = staged(tried.join(up, F.col("end") == F.col("node"), "left"), "climb")
        legs.append(tried.where("side is not null").select("seed", "target", "side", F.lit(k).alias("k"), "node", F.when(F.col("side") == "s", F.col("ds")).otherwise(F.col("dt")).alias("depth")))
        here = lambda side: F.coalesce(F.col("side") == side, F.lit(False))
        rows = tried.select("seed", "target", *[F.when(here(x), F.col("at")).otherwise(F.col(x)).alias(x) for x in "st"],
                            *[(F.col(f"d{x}") - F.when(here(x), 1 << k).otherwise(0)).alias(f"d{x}") for x in "st"], F.least("low", F.coalesce("got", "low")).alias("low"), "from_s", "from_t")
    # Then both climb while that does not bring them together.
    for k in reversed(range(len(tables))):
        x, y = tables[k].toDF("s", "at_s", "low_s"), tables[k].toDF("t", "at_t", "low_t")
        go = F.coalesce((F.col("s") != F.col("t")) & (F.col("at_s") != F.col("at_t")), F.lit(False))
        tried = staged(rows.join(x, "s", "left").join(y, "t", "left").withColumn("go", go), "climb")
        for side in "st":
            legs.append(tried.where("go").select("seed", "target", F.lit(side).alias("side"), F.lit(k).alias("k"), F.col(side).alias("node"), F.col(f"d{side}").alias("depth")))
        rows = tried.select("seed", "target", *[F.when(F.col("go"), F.col(f"at_{x}")).otherwise(F.col(x)).alias(x) for x in "st"],
                            *[(F.col(f"d{x}") - F.when(F.col("go"), 1 << k).otherwise(0)).alias(f"d{x}") for x in "st"], F.when(F.col("go"), F.least("low", "low_s", "low_t")).otherwise(F.col("low")).alias("low"), "from_s", "from_t")
    rows = staged(rows.select(*columns), "level")
    x, y = tables[0].toDF("s", "at_s", "low_s"), tables[0].toDF("t", "at_t", "low_t")
    last = staged(rows.where("s <> t").join(x, "s").join(y, "t"), "last")
    for side in "st":
        legs.append(last.select("seed", "target", F.lit(side).alias("side"), F.lit(0).alias("k"), F.col(side).alias("node"), F.col(f"d{side}").alias("depth")))
    met = last.select("seed", "target", F.least("low", "low_s", "low_t").alias("conf"), (F.col("from_s") + F.col("from_t") - 2 * (F.col("ds") - 1)).alias("hops"), "from_s", (F.col("ds") - 1).alias("top"))
    level = rows.where("s = t").select("seed", "target", F.col("low").alias("conf"), (F.col("from_s") + F.col("from_t") - 2 * F.col("ds")).alias("hops"), "from_s", F.col("ds").alias("top"))
    found = staged(met.unionByName(level), "paths")
    return found.select("seed", "target", "conf", "hops"), _links(_union(legs), tables, found)


def _links(legs: DataFrame, tables: list[DataFrame], found: DataFrame) -> DataFrame:
    """Legs of 2 ** k links, halved until each is one link."""
    legs = staged(legs, "legs")
    for k in reversed(range(1, len(tables))):
        long = legs.where(F.col("k") == k)
        middle = tables[k - 1].select("node", "at")
        first = long.withColumn("k", F.lit(k - 1))
        second = long.join(middle, "node").select("seed", "target", "side", F.lit(k - 1).alias("k"), F.col("at").alias("node"), (F.col("depth") - (1 << (k - 1))).alias("depth"))
        legs = staged(legs.where(F.col("k") < k).unionByName(first).unionByName(second), "legs")
    own = legs.join(tables[0].select("node", "at", F.col("low").alias("conf")), "node").join(found.drop("conf"), ["seed", "target"])
    up = F.col("side") == "s"
    # Upwards from the seed, then downwards to the target.
    step = F.when(up, F.col("from_s") - F.col("depth")).otherwise(F.col("from_s") - F.col("top") + F.col("depth") - F.col("top") - 1) + 1
    return own.select("seed", "target", step.alias("step"), F.when(up, F.col("node")).otherwise(F.col("at")).alias("a"), F.when(up, F.col("at")).otherwise(F.col("node")).alias("b"), "conf")
