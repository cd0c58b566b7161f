"""Near-duplicate vectors by random-hyperplane sign hashing.

Vectors of equal label (and length) fall into buckets by the signs of their products with random
hyperplanes, in as many tables as leave a pair at the limit unseen with at most a stated chance.
Within a bucket every pair is verified by cosine in double precision; a pair counts in the first
table in which it meets, so numbers of links add up and no list of pairs is made.

Equal vectors are one node. Groups of near copies become cells first: a vector within half the
limiting angle of a cell's leader is linked to every other such vector (the triangle inequality of
angles), so links within a cell are counted from its size, and buckets compare only what lies in
different cells. A bucket of very many vectors is dealt to several tasks, each with a part of it;
members of the cell that fills it stay in their part, all others visit every part.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, and one
whose label is null, links with nothing and is its own component. Vectors of different lengths do
not link. Repeated rows are vectors of their own, linked to one another. A null id takes part; a
component whose ids are all null has a null id, and its rows are kept. Ties: of cells that could
take a vector the largest does, then that of the least node; results do not depend on it. Other
columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.base import prepare, staged
from partloom.llm.simhash import _named
from partloom.operators.graph import components

#: Expected vectors of one label in a bucket, if directions are spread evenly.
BUCKET = 64
#: Tables whose buckets are dealt at a time, which bounds what lies on disk at once.
PASS = 4
#: Vectors of one bucket in one task; beyond that a bucket has several parts.
LARGE = 8192
#: Members from which vectors near a leader count as a cell.
CELL = 16
#: Rows whose cosines with a bucket are computed at once.
BLOCK = 1024
#: Angles and cosines nearer to a limit than this are not decided by rounded values.
MARGIN = 1e-7


def tables(n: int, similarity: float, miss: float) -> tuple[int, int]:
    """Bits of a code and number of tables for n vectors of one label: a pair at the limit meets in none with at most that chance."""
    bits = min(24, max(4, math.ceil(math.log2(max(1, n) / BUCKET))))
    same = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def hyperplanes(length: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, length)).normal(size=(length, number))


def usable(docs: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """i, label, v: the vector's values as bytes, of the column's own float type; null where it links with nothing."""
    single = docs.schema[embedding].dataType.elementType.simpleString() == "float"
    given = docs.select(F.col(f"`{vec_id}`").alias("i"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").cast("array<float>" if single else "array<double>").alias("e"))

    def run(batches):
        for b in batches:
            e, label = b.column("e"), b.column("label")
            ends, values = e.offsets.to_numpy(), e.values
            whole = values.is_valid().to_numpy(zero_copy_only=False)
            values = np.nan_to_num(values.to_numpy(zero_copy_only=False), nan=np.nan, posinf=np.nan, neginf=np.nan)
            whole &= ~np.isnan(values)
            out = []
            for k, ok in enumerate((e.is_valid().to_numpy(zero_copy_only=False) & label.is_valid().to_numpy(zero_copy_only=False)).tolist()):
                own = slice(ends[k], ends[k + 1])
                out.append(values[own].tobytes() if ok and whole[own].all() and values[own].any() else None)
            yield pa.RecordBatch.from_arrays([b.column("i"), label, pa.array(out, pa.binary())], names=["i", "label", "v"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:2])
    return given.mapInArrow(run, f"{head}, v binary")


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def coded(distinct: DataFrame, kind: str, bits: int, number: int, seed: int) -> DataFrame:
    """distinct with node, a number of its own, and codes, one for each table."""

    def run(batches):
        for b in batches:
            raw = b.column("v").to_pylist()
            lengths, codes = np.array([len(x) for x in raw]), np.zeros((len(raw), number), np.int32)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                x = unit([raw[k] for k in at], kind)
                signs = (x @ hyperplanes(x.shape[1], number * bits, seed) >= 0).reshape(len(at), number, bits)
                codes[at] = signs @ (1 << np.arange(bits, dtype=np.int32))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * number, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, listed], names=[*b.schema.names, "codes"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return distinct.mapInArrow(run, f"{head}, codes array<int>").withColumn("node", F.monotonically_increasing_id())


def bucketed(nodes: DataFrame, chosen: list[int], *columns: str) -> DataFrame:
    """The columns, t and k: the bucket of each chosen table, a hash of the label, the length, the table and the code."""
    rows = nodes.select("label", F.length("v").alias("length"), *columns, F.posexplode(F.array(*[F.get("codes", F.lit(t)) for t in chosen])).alias("at", "code"))
    t = F.get(F.array(*map(F.lit, chosen)), F.col("at"))
    return rows.select(*columns, t.alias("t"), F.xxhash64("label", "length", t, "code").alias("k"))


def by_runs(rows: DataFrame, key: list[str], columns: list[str], each, schema: str) -> DataFrame:
    """each(columns of one run of equal key) gives record batches. Rows are dealt by key."""
    dealt = rows.select(*key, *columns).repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in key], 1)
            heads = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, b.num_rows]
            for a, z in zip(heads[:-1].tolist(), heads[1:].tolist()):
                own = tuple(keys[a].tolist())
                if last is not None and own != last:
                    yield from each(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(a, z - a))
                last = own
        if held:
            yield from each(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def led(x: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """The row that leads each row, and the cosine with it: rows in turn take those not taken that are near enough."""
    leader, cosine, left = np.full(len(x), -1), np.ones(len(x)), np.arange(len(x))
    while len(left):
        with_first = x[left] @ x[left[0]]
        taken = with_first >= near
        taken[0] = True
        leader[left[taken]], cosine[left[taken]] = left[0], with_first[taken]
        left = left[~taken]
    return leader, cosine


def cells(nodes: DataFrame, kind: str, similarity: float, number: int) -> DataFrame | None:
    """node and cell, the leader's node: all members of a cell are within half the limiting angle of it. None if there is no cell.

    Buckets of the first table, in parts of at most LARGE, give cells; then of cells that meet in any
    table the larger one takes a smaller one whose members are all near enough."""
    half = math.acos(similarity) / 2
    near = math.cos(half) + MARGIN
    of = bucketed(nodes, [0], "node", "v", "least")
    parts = staged(of.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("k", F.ceil(F.col("n") / LARGE).alias("parts")), "large_buckets")
    of = of.join(parts, "k", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))

    def each(rows: pa.Table):
        if len(rows) < CELL:
            return
        leader, cosine = led(unit(rows["v"].to_pylist(), kind), near)
        size = np.bincount(leader, minlength=len(leader))
        node, kept = rows["node"].to_numpy(), size[leader] >= CELL
        yield pa.RecordBatch.from_pydict({"node": node[kept], "cell": node[leader[kept]], "angle": np.arccos(np.clip(cosine[kept], -1, 1))})

    members = staged(by_runs(of, ["k", "part"], ["node", "v"], each, "node long, cell long, angle double"), "cells")
    if members.isEmpty():
        return None
    leaders = members.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("size"))
    leaders = staged(nodes.join(leaders, nodes["node"] == leaders["cell"]).select("label", "v", "codes", "cell", "radius", "size"), "leaders")

    def larger(rows: pa.Table):
        cell, radius, size = (rows[c].to_numpy() for c in ("cell", "radius", "size"))
        if len(cell) < 2:
            return
        x, left = unit(rows["v"].to_pylist(), kind), np.lexsort((cell, -size))
        while len(left) > 1:
            first, left = left[0], left[1:]
            taken = np.arccos(np.clip(x[left] @ x[first], -1, 1)) + radius[left] <= half - MARGIN
            yield pa.RecordBatch.from_pydict({"cell": cell[left[taken]], "into": np.full(taken.sum(), cell[first]), "size": np.full(taken.sum(), size[first])})
            left = left[~taken]

    met = by_runs(bucketed(leaders, list(range(number)), "cell", "radius", "size", "v"), ["k"], ["cell", "radius", "size", "v"], larger, "cell long, into long, size long")
    best = staged(met.groupBy("cell").agg(F.max_by("into", F.struct("size", F.negative("into"))).alias("into")), "merged")
    # A cell that is taken itself takes none.
    final = best.join(best.select(F.col("cell").alias("into")), "into", "left_anti")
    return members.join(final, "cell", "left").select("node", F.coalesce("into", "cell").alias("cell"))


class Bucket:
    """Links between the rows of one bucket (or of one part of it) that lie in different cells and met in no earlier table."""

    def __init__(self, similarity: float, kind: str):
        self.similarity, self.kind = similarity, kind

    def __call__(self, rows: pa.Table):
        if len(rows) < 2:
            return
        node, cell, copies, home, part, filling, t = (rows[c].to_numpy() for c in ("node", "cell", "copies", "home", "part", "filling", "t"))
        own = home == part
        if (cell == cell[0]).all() or not own.any():
            return
        x = unit(rows["v"].to_pylist(), self.kind)
        # Codes of the tables before this one: a pair with an equal one has met.
        codes = rows["codes"].combine_chunks()
        codes = codes.values.to_numpy()[codes.offsets[0].as_py() :].reshape(len(rows), -1)[:, : int(t[0])]
        fills = cell == filling
        label = np.unique(cell, return_index=True, return_inverse=True)
        label = label[1][label[2]]
        n = np.zeros(len(rows))
        for at, against in ((np.flatnonzero(own & fills), np.flatnonzero(~fills)), (np.flatnonzero(own & ~fills), np.flatnonzero(~fills & (home <= part)))):
            for k in range(0, len(at) if len(against) else 0, BLOCK):
                here = at[k : k + BLOCK]
                near = x[here] @ x[against].T
                i, j = np.nonzero(near >= self.similarity - MARGIN)
                cosine, i, j = near[i, j], here[i], against[j]
                # Of two rows that are both at home the one that comes first finds the other.
                good = (cell[i] != cell[j]) & (fills[i] | ~own[j] | (i < j))
                doubt = np.flatnonzero(good & (np.abs(cosine - self.similarity) < MARGIN))
                good[doubt] = [self.exact(rows, a, b) for a, b in zip(i[doubt].tolist(), j[doubt].tolist())]
                i, j = i[good], j[good]
                if codes.shape[1]:
                    fresh = np.ones(len(i), bool)
                    for c in codes.T:
                        fresh &= c[i] != c[j]
                    i, j = i[fresh], j[fresh]
                n += np.bincount(i, copies[j], len(n)) + np.bincount(j, copies[i], len(n))
                label = joined(label, i, j)
        counted, linked = np.flatnonzero(n), np.flatnonzero(cell[label] != cell)
        yield pa.RecordBatch.from_pydict({
            "u": np.r_[node[counted], cell[linked]], "v": np.r_[np.zeros(len(counted), np.int64), cell[label[linked]]],
            "n": np.r_[n[counted].astype(np.int64), np.zeros(len(linked), np.int64)],
        })

    def exact(self, rows: pa.Table, a: int, b: int) -> bool:
        x, y = (np.frombuffer(rows["v"][k].as_py(), self.kind).astype(np.float64) for k in (a, b))
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return float((x * y).sum() / math.sqrt(float((x * x).sum()) * float((y * y).sum()))) >= self.similarity


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after rows i and j are joined; a label is the least row of what is joined."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while ((up := label[label]) != label).any():
            label = up


def near_vectors(
    docs: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", similarity: float = 0.93, miss: float = 1e-4, seed: int = 29
) -> DataFrame:
    """One row per input row: the id, n_links (other rows of equal label whose cosine is at least `similarity`), component_id
    (the least id that links reach) and kept (the id is its component's). miss: the chance that a pair at the limit is not
    found; more alike ones are found more surely."""
    prepare(docs.sparkSession)
    kind = "<f4" if docs.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"
    rows = staged(usable(docs, vec_id, embedding, label), "vectors")
    distinct = staged(rows.where("v is not null").groupBy("label", "v").agg(F.min("i").alias("least"), F.count("*").alias("copies")), "distinct")
    most = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, number = tables(most, similarity, miss)
    nodes = staged(coded(distinct, kind, bits, number, seed), "nodes")
    found = cells(nodes, kind, similarity, number)
    found = staged(found, "members") if found is not None else docs.sparkSession.createDataFrame([], "node long, cell long")
    held = found.join(nodes.select("node", "copies"), "node").groupBy("cell").agg(F.sum("copies").alias("within"))
    of = nodes.join(found.join(held, "cell"), "node", "left")
    nodes = staged(of.select(*nodes.columns, F.coalesce("cell", "node").alias("cell"), (F.coalesce("within", "copies") - 1).alias("within")), "nodes")

    # Buckets of very many rows: their parts, and the cell that fills them most.
    per_cell = bucketed(nodes, list(range(number)), "cell").groupBy("k", "cell").agg(F.count("*").alias("n"))
    large = per_cell.groupBy("k").agg(F.sum("n").alias("m"), F.max_by("cell", "n").alias("filling")).where(F.col("m") > LARGE)
    large = staged(large.select("k", "filling", F.ceil(F.col("m") / LARGE).alias("parts")), "large_buckets")
    columns = ["node", "cell", "copies", "v", "codes"]
    passes = []
    for k in range(0, number, PASS):
        spread = bucketed(nodes, list(range(k, min(number, k + PASS))), *columns).join(large, "k", "left")
        spread = spread.withColumn("home", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))).withColumn("filling", F.coalesce("filling", F.lit(-1)))
        every = F.when(F.col("parts").isNull() | (F.col("cell") == F.col("filling")), F.array("home")).otherwise(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))
        spread = spread.withColumn("part", F.explode(every))
        passes.append(staged(by_runs(spread, ["k", "part"], [*columns, "home", "filling", "t"], Bucket(similarity, kind), "u long, v long, n long"), "links"))
    out = reduce(DataFrame.unionByName, passes)
    links = out.where("n = 0").select("u", "v").unionByName(nodes.where("cell <> node").select(F.col("node").alias("u"), F.col("cell").alias("v")))
    named = _named(components(links), nodes.select("node", "least"))
    counts = out.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("more"))
    told = nodes.join(counts, "node", "left").join(named, "node").select("label", "v", (F.col("within") + F.coalesce("more", F.lit(0))).alias("n_links"), "component")
    with_v = rows.where("v is not null").join(told, ["label", "v"]).select("i", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("v is null").select("i", F.lit(0).cast("long").alias("n_links"), F.col("i").alias("component_id"))
    return with_v.unionByName(alone).select(F.col("i").alias(vec_id), "n_links", "component_id", F.col("i").eqNullSafe(F.col("component_id")).alias("kept"))
