"""The equivalence graph: links between products, searched transitively.

Links are rows a, b, conf; they hold in both directions. Iterations write their state to the shared
folder, so that lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions.staging import dropped, importable, staged


def canonical(links: DataFrame) -> DataFrame:
    """One row per unordered pair, with the best confidence; self-links go."""
    return links.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("conf").alias("conf"))


def both_ways(links: DataFrame) -> DataFrame:
    """Links in both directions; what makes them runs once."""
    return links.select(F.inline(F.array(F.struct("a", "b", "conf"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "conf"))))


def mirrored(links: DataFrame) -> DataFrame:
    """Pairs that are stored in both directions."""
    return links.where("a < b").select("a", "b").join(links.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").distinct()


def closure(links: DataFrame, seeds: DataFrame, max_hops: int | None, min_conf: int = 0) -> DataFrame:
    """For every seed and every product within max_hops links (None: any number) of at least min_conf: the best bottleneck
    confidence of such a chain, and the fewest hops of a chain with that bottleneck. seeds: column seed. A seed reaches
    itself, with confidence 100 and no hop. A round extends only chains that are not dominated by one as short with a
    better bottleneck; what is best so far is one table, to which rounds add, and which is made one again as they gather."""
    step = staged(both_ways(links.where(F.col("conf") >= min_conf)), "steps")
    best = lambda df: df.groupBy("seed", "id").agg(F.max(F.struct("conf", F.negative("hops").alias("h"))).alias("x")).select("seed", "id", F.negative("x.h").alias("hops"), F.col("x.conf").alias("conf"))
    front = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hops"), F.lit(100).cast("long").alias("conf")).distinct()
    known, fronts, hop = None, [front], 0
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = front.join(step.withColumnRenamed("conf", "c"), front.id == step.a).select("seed", F.col("b").alias("id"), F.least("conf", "c").alias("conf"))
        reached = reached.groupBy("seed", "id").agg(F.max("conf").alias("conf"))
        if len(fronts) >= ROUNDS:
            known, fronts = staged(best(_all(known, fronts)), "best"), []
        had = _all(known, fronts).groupBy("seed", "id").agg(F.max("conf").alias("had"))
        better = reached.join(had, ["seed", "id"], "left").where("had is null or conf > had").select("seed", "id", F.lit(hop).alias("hops"), "conf")
        front = staged(better, "front")
        if front.isEmpty():
            break
        fronts.append(front)
    return best(_all(known, fronts))


#: Rounds whose results closure() keeps apart before it makes one table of them.
ROUNDS = 8


def _all(known: DataFrame | None, fronts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, ([known] if known is not None else []) + fronts)


def _distinct(links: DataFrame) -> DataFrame:
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


#: Links that a task joins at a time before a shuffle.
HELD = 500_000


def joined_in_tasks(links: DataFrame, roots: bool = False) -> DataFrame:
    """u, v: links that join what the links of each task join, every node to the least one there (union-find). roots: that
    one too, to itself."""

    def run(batches):
        up: dict[int, int] = {}

        def find(x):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        def flush():
            nodes = [x for x in up if up[x] != x]
            if roots:
                nodes += set(map(find, nodes))
            yield pa.RecordBatch.from_pydict({"u": pa.array(nodes, pa.int64()), "v": pa.array(list(map(find, nodes)), pa.int64())})
            up.clear()

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(u), find(v)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > HELD:
                yield from flush()
        yield from flush()

    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """links u, v (numbers) to one row (node, root) per linked node, by alternating large and small stars, after each task has
    joined what it has; the root is the least node of the component. Minima are added up within tasks before a shuffle, so a
    node with very many links is no hot spot but for its join, which adaptive execution splits."""
    links = staged(_distinct(joined_in_tasks(links)), "links")
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(_distinct(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = _distinct(moved.unionByName(least.select("u", F.col("m").alias("v"))))
        before, links = links, staged(joined_in_tasks(after), "small_star")
        dropped(before, large)
        if (now := _state(links)) == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def labels(links: DataFrame) -> DataFrame:
    """As components(): node and root. What each task's links join is one star; a node in one star alone is done with, and only
    the roots of stars that share a node go through rounds. Links that lie in order of their networks need none."""
    stars = staged(joined_in_tasks(links, True), "stars")
    first = staged(stars.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")), "first_roots")
    shared = first.where("v < w")
    if shared.isEmpty():
        dropped(stars)
        return first.select(F.col("u").alias("node"), F.col("v").alias("root"))
    between = stars.join(shared.select("u", F.col("v").alias("m")), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    roots = components(between).select(F.col("node").alias("v"), "root")
    found = staged(first.join(roots, "v", "left").select(F.col("u").alias("node"), F.coalesce("root", "v").alias("root")), "labels")
    dropped(stars, first)
    return found


def networks(products: DataFrame, links: DataFrame) -> DataFrame:
    """id and net: each product's network, named by its least product; a product without links is its own."""
    found = labels(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return products.join(found, products.id == found.node, "left").select("id", F.coalesce("root", "id").alias("net"))


def joined_by(pending: DataFrame, nets: DataFrame) -> DataFrame:
    """What accepting each pending pair would join: the sizes of both networks, and how many new pairs there would be."""
    nets = staged(nets, "networks")
    size = nets.groupBy("net").agg(F.count("*").alias("size"))
    of = staged(nets.join(size, "net").select("id", "net", "size"), "sized_networks")
    left, right = of.toDF("a", "net_a", "size_a"), of.toDF("b", "net_b", "size_b")
    return pending.join(left, "a").join(right, "b").where("net_a <> net_b").select("a", "b", "size_a", "size_b", (F.col("size_a") * F.col("size_b")).alias("new_pairs"))


def hubs(members: DataFrame, least_degree: int) -> DataFrame:
    """Reference numbers that many products hang from. members: part, id, brand."""
    return members.groupBy("part").agg(F.count_distinct("id").alias("degree"), F.count_distinct("brand").alias("brands")).where(F.col("degree") >= least_degree)


def two_hops(links: DataFrame) -> DataFrame:
    """Pairs of products within two links, each once: a and brand_a, b and brand_b, a < b. links: a, b, brand_a, brand_b.

    Neighbours of a product meet in one order of the two alone, and brands come with the links: pairs are far more than links,
    so they are dealt out once, to be made one."""
    own = links.where("a is not null and b is not null").select("a", "b", "brand_a", "brand_b")
    one, other = ("a", "brand_a"), ("b", "brand_b")
    near = own.select(F.inline(F.array(F.struct(F.col("a").alias("mid"), F.col("b").alias("id"), F.col("brand_b").alias("brand")), F.struct(F.col("b").alias("mid"), F.col("a").alias("id"), F.col("brand_a").alias("brand")))))
    through = near.toDF("mid", "a", "brand_a").join(near.toDF("mid", "b", "brand_b"), "mid").where("a < b").select(*one, *other)
    turned = F.struct(F.col("b").alias("a"), F.col("brand_b").alias("brand_a"), F.col("a").alias("b"), F.col("brand_a").alias("brand_b"))
    direct = own.where("a <> b").select(F.when(F.col("a") < F.col("b"), F.struct(*one, *other)).otherwise(turned).alias("x")).select("x.*")
    return direct.unionByName(through).distinct()


def reached_brands(links: DataFrame) -> DataFrame:
    """Per brand: reached, the brands that its products come to within two links, and pairs, those of its products with others.
    links: a, b, brand_a, brand_b. Pairs of two brands are counted together, whichever comes first."""
    turn = F.coalesce(F.col("brand_a") > F.col("brand_b"), F.col("brand_a").isNull())
    p, q = F.when(turn, F.col("brand_b")).otherwise(F.col("brand_a")), F.when(turn, F.col("brand_a")).otherwise(F.col("brand_b"))
    n = two_hops(links).groupBy(p.alias("p"), q.alias("q")).agg(F.count("*").alias("n"))
    to = lambda x, y, m: F.struct(F.col(x).alias("brand"), F.col(y).alias("other"), (m * F.col("n")).alias("n"))
    rows = n.select(F.inline(F.when(F.col("p").eqNullSafe(F.col("q")), F.array(to("p", "q", 2))).otherwise(F.array(to("p", "q", 1), to("q", "p", 1)))))
    return rows.groupBy("brand").agg(F.count("other").alias("reached"), F.sum("n").alias("pairs"))


def widest(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (seed, target): the best bottleneck confidence of any chain between them, and the fewest links of
    a chain with it; pairs that no chain joins are left out."""
    found = closure(links, pairs.select("seed").distinct(), None)
    return pairs.join(found.withColumnRenamed("id", "target"), ["seed", "target"])


def spanning_forest(links: DataFrame) -> list[DataFrame]:
    """Breadth-first levels of each network from its least product: root, node, parent. A node of one level has
    neighbours in this, the last and the next level only, so a round looks back two levels."""
    step = staged(both_ways(canonical(links)).select("a", "b"), "steps")
    roots = components(step.toDF("u", "v")).where("node = root")
    levels = [staged(roots.select("root", "node", F.lit(None).cast("long").alias("parent")), "level")]
    while True:
        seen = levels[-1].select("node") if len(levels) == 1 else levels[-1].select("node").unionByName(levels[-2].select("node"))
        reached = levels[-1].join(step, F.col("node") == F.col("a")).select("root", F.col("b").alias("node"), F.col("a").alias("parent"))
        after = staged(reached.join(seen, "node", "left_anti").groupBy("root", "node").agg(F.min("parent").alias("parent")), "level")
        if after.isEmpty():
            return levels
        levels.append(after)


#: Links of a network that one task looks at by itself; larger networks go by rounds.
SMALL = 10_000


def by_size(links: DataFrame, nets: DataFrame, asked: DataFrame | None = None, steps: int = 0) -> tuple[DataFrame, DataFrame]:
    """net, a, b, conf of networks of SMALL links or fewer, and a, b, conf of the larger ones. links: a, b, conf; nets: node,
    root. asked: net, pairs; a network whose links times pairs are more than steps is a larger one too."""
    tagged = staged(links.join(nets, F.col("a") == F.col("node")).select(F.col("root").alias("net"), "a", "b", "conf"), "tagged_links")
    sizes, big = tagged.groupBy("net").agg(F.count("*").alias("n")), F.col("n") > SMALL
    if asked is not None:
        sizes, big = sizes.join(asked, "net", "left"), big | (F.col("n") * F.coalesce("pairs", F.lit(0)) > steps)
    large = staged(sizes.where(big).select("net"), "large_networks")
    return tagged.join(large, "net", "left_anti"), tagged.join(large, "net", "left_semi").select("a", "b", "conf")


def in_networks(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """The rows that run makes of the rows (tuples without net, in order of their other columns) of each net. A task holds one net at a time."""
    importable(rows.sparkSession)

    def every(batches):
        one = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        made = (x for _, g in groupby(one, lambda r: r[0]) for x in run([r[1:] for r in g]))
        while held := list(islice(made, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.repartition("net").sortWithinPartitions(*rows.columns).mapInArrow(every, schema)


def _bridges(links: list[tuple[int, int]], least_side: int) -> list[tuple[int, int, int]]:
    """a, b and smaller of one network's links: by the earliest node that a subtree's links lead back to."""
    step: dict[int, list[int]] = {}
    for a, b in set(links):
        step.setdefault(a, []).append(b)
        step.setdefault(b, []).append(a)
    start = links[0][0]
    order, low, size, up, out = {start: 0}, {start: 0}, {}, {start: None}, []
    todo = [(start, iter(step[start]))]
    while todo:
        x, after = todo[-1]
        for y in after:
            if y not in order:
                order[y] = low[y] = len(order)
                up[y] = x
                todo.append((y, iter(step[y])))
                break
            if y != up[x]:
                low[x] = min(low[x], order[y])
        else:
            todo.pop()
            size[x] = size.get(x, 0) + 1
            if (p := up[x]) is not None:
                size[p] = size.get(p, 0) + size[x]
                low[p] = min(low[p], low[x])
                if low[x] > order[p]:
                    out.append((min(x, p), max(x, p), size[x]))
    return [(a, b, s) for a, b, n in out if (s := min(n, len(order) - n)) >= least_side]


def cut_links(links: DataFrame, least_side: int = 3) -> DataFrame:
    """Links without which a network falls apart, where both sides have least_side products or more: a, b and smaller,
    the size of the smaller side. Networks of SMALL links or fewer are looked at where they lie, larger ones by levels."""
    # As they lie, links of one network are often in one task: pairs are made one again within the network.
    own = staged(links.where("a <> b").select("a", "b", "conf"), "pairs")
    small, large = by_size(own, labels(own.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    found = in_networks(small.select("net", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), lambda rows: _bridges(rows, least_side), "a long, b long, smaller long")
    return found if large.isEmpty() else found.unionByName(cut_by_levels(large, least_side).select("a", "b", F.col("smaller").cast("long").alias("smaller")))


def cut_by_levels(links: DataFrame, least_side: int = 3) -> DataFrame:
    """As cut_links(), for networks of any size.

    Every link outside a spanning forest gets a label, both its ends hold it, and labels are xored up the
    tree, level by level. A tree link that no other link passes by has nothing left; by chance of 64-bit labels only
    could another look so. Sizes of subtrees add up on the same way."""
    levels = spanning_forest(links)
    tree = levels[1:] and [x.select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b")) for x in levels[1:]]
    spare = canonical(links).select("a", "b")
    if tree:
        spare = spare.join(reduce(DataFrame.unionByName, tree), ["a", "b"], "left_anti")
    ends = staged(spare, "spare_links").select(F.explode(F.array("a", "b")).alias("node"), F.xxhash64("a", "b").alias("x"))
    labels = staged(ends.groupBy("node").agg(F.bit_xor("x").alias("x")), "labels")
    below, done = None, []
    for level in reversed(levels):
        rows = level.join(labels, "node", "left").select("root", "node", "parent", F.coalesce("x", F.lit(0)).alias("x"), F.lit(1).alias("n"))
        if below is not None:
            up = below.select("root", F.col("parent").alias("node"), F.lit(None).cast("long").alias("parent"), "x", "n")
            rows = rows.unionByName(up).groupBy("root", "node").agg(F.max("parent").alias("parent"), F.bit_xor("x").alias("x"), F.sum("n").alias("n"))
        below = staged(rows, "subtrees")
        done.append(below)
    size = done[-1].select("root", F.col("n").alias("whole"))
    cut = done[0].where("parent is not null and x = 0")
    for d in done[1:-1]:
        cut = cut.unionByName(d.where("parent is not null and x = 0"))
    rows = cut.join(size, "root").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"), F.least("n", F.col("whole") - F.col("n")).alias("smaller"))
    return rows.where(F.col("smaller") >= least_side)


def middles(links: DataFrame) -> DataFrame:
    """a, b: products that share a neighbour; how many they share, and the best of the weaker links by way of one. A
    neighbour with very many links is what hubs() finds; leave it out first."""
    step = both_ways(canonical(links))
    two = step.toDF("a", "mid", "c").join(step.toDF("mid", "b", "d"), "mid").where("a < b")
    return two.groupBy("a", "b").agg(F.count_distinct("mid").alias("shared"), F.max(F.least("c", "d")).alias("best"))
