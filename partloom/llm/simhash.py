"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints come from word shingles. To find the pairs that differ in at most `radius` bits, the 64
bits are grouped so that correlated bits share a partition, and each partition gets a threshold of
its own (-1 leaves it out). If thresholds add up to radius - partitions + 1, two fingerprints
within the radius differ within the threshold in some partition. How many partitions there are and
which thresholds they have is decided by dynamic programming on the candidates and probes to be
expected, from the bit statistics of all fingerprints. Probes are partition values with up to
threshold bits left out; fingerprints that share one are verified on all bits.

Equal fingerprints are one before the search, and links that add nothing to what a group's links
join already are not emitted, so copies and near copies by the thousand stay linear. Where a link
takes a comparison of texts as well (similar()), pairs are left out only once comparisons have
joined their members.

Defined results: a null or empty text, or one without a word, has fingerprint zero, which links as
any other. Repeated rows are equal fingerprints. Null ids take part; a component whose ids are all
null has a null id. Texts of any length are read whole, in memory in proportion to the longest. There
are no ties: the least id names a component. Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.staging import bucketed
from partloom.llm.base import prepare, staged
from partloom.operators.graph import components

SEED = 42
#: Relative cost of a probe row that is shuffled, and of comparing two fingerprints.
ROW_COST, PAIR_COST = 1.0, 0.004
#: Fingerprints that share a probe from which their group is divided by further bits.
LARGE = 20_000
CHUNK = 1 << 16
#: Columns of the fingerprints by which similar() searches.
FOUR = ["f", "f1", "f2", "f3"]
#: A bitmap of 512 bits in eight words: those at which a text has a shingle.
BITS = [f"s{k}" for k in range(8)]
#: Pairs for each member that a run makes in its first round of comparisons, and pairs that any run may make.
SHARE, FEW = 0.25, 64
#: The last node that is done in a run of which none is.
FIRST = -(1 << 63)


def shingles(text: str | None, words_in: int) -> list[bytes]:
    """All shingles in order, repeats included; the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - words_in + 1)
    starts, ends = starts[:n].tolist(), (ends[words_in - 1 :] if len(words) >= words_in else ends[-1:]).tolist()
    return [joined[a:b] for a, b in zip(starts, ends)]


def majority(hashes: bytes, width: int) -> np.ndarray:
    """Words of 64 bits; a bit is one if it is set in over half of the hashes of `width` bytes."""
    total, rows = np.zeros(8 * width, np.int64), np.frombuffer(hashes, np.uint8).reshape(-1, width)
    for i in range(0, len(rows), CHUNK):
        total += np.unpackbits(rows[i : i + CHUNK], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(rows), bitorder="little").view("<u8")


def fingerprint(text: str | None, words_in: int = 4) -> int:
    """A bit is one if it is set in over half of the XXH64 hashes of the shingles, repeats included."""
    found = shingles(text, words_in)
    return int(majority(np.array([xxhash.xxh64_intdigest(x, SEED) for x in found], "<u8").tobytes(), 8)[0]) if found else 0


def four_fingerprints(text: str | None, words_in: int) -> list[int]:
    """Four independent fingerprints of the distinct shingles, as likeness() has them, by the halves of XXH3's 128 bits
    under two seeds, the number of these shingles, and the eight words of their bitmap."""
    found = set(shingles(text, words_in))
    if not found:
        return [0] * (len(FOUR) + 1 + len(BITS))
    drawn = [b"".join([xxhash.xxh3_128_digest(x, seed) for x in found]) for seed in (SEED, SEED + 1)]
    marks = np.zeros(64 * len(BITS), np.uint8)
    marks[np.frombuffer(drawn[0], "<u8")[::2] % len(marks)] = 1
    return [int(x) for x in (*majority(drawn[0], 16), *majority(drawn[1], 16), len(found), *np.packbits(marks, bitorder="little").view("<u8"))]


def overlap(x: set[bytes], y: set[bytes]) -> float:
    """Jaccard similarity of two sets; two empty ones are alike."""
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def likeness(a: str | None, b: str | None, words_in: int) -> float:
    """Jaccard similarity of two texts' shingles."""
    return overlap(set(shingles(a, words_in)), set(shingles(b, words_in)))


class Shingles:
    """The shingle sets of nodes, each made once while at most HELD shingles are kept."""

    HELD = 400_000

    def __init__(self, words_in: int):
        self.words_in, self.sets, self.held = words_in, {}, 0

    def __call__(self, node: int, text: str) -> set[bytes]:
        found = self.sets.get(node)
        if found is None:
            found = set(shingles(text, self.words_in))
            if self.held + len(found) > self.HELD:
                self.sets, self.held = {}, 0
            self.sets[node] = found
            self.held += len(found)
        return found


def fingerprints(docs: DataFrame, text: str, words_in: int, keep: tuple[str, ...], four: bool = False) -> DataFrame:
    """c0, c1, ..., the columns of keep, and f, the fingerprint as a signed long; if four, f to f3 by other hashes,
    size, the number of distinct shingles, and s0 to s7, their bitmap."""
    given = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches):
        for b in batches:
            texts = b.column("t").to_pylist()
            rows = np.array([four_fingerprints(t, words_in) if four else [fingerprint(t, words_in)] for t in texts], np.uint64).view(np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=[*b.schema.names[:-1], *names])

    names = [*FOUR, "size", *BITS] if four else ["f"]
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, head + ", ".join(f"{n} long" for n in names))


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bits i and j, over all of them. 64 x 64 sums reach the driver."""

    def run(batches):
        total = np.zeros((64, 64))
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(f), CHUNK):
                bits = np.unpackbits(f[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_pydict({"i": np.arange(4096, dtype=np.int32), "n": total.ravel().astype(np.int64)})

    rows = distinct.select("f").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(4096)
    for r in rows:
        both[r.i] = r.n
    return distinct.count(), both.reshape(64, 64)


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in so many groups of equal size; each is filled with the bits most correlated with those it has."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    free, groups = set(range(64)), []
    for k in range(parts):
        size = 64 * (k + 1) // parts - 64 * k // parts
        rest = sorted(free)
        group = [max(rest, key=lambda b: near[b, rest].max())]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: near[b, group].mean()))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def within(differ: np.ndarray, t: int) -> float:
    """Chance that at most t of the bits differ, when bit k of two fingerprints differs with chance differ[k]."""
    dist = np.zeros(t + 1)
    dist[0] = 1
    for q in differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return float(dist.sum())


def allocate(n: int, both: np.ndarray, radius: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least expected cost."""
    p = np.diag(both) / max(1, n)
    differ = 2 * p * (1 - p)
    best = None
    for parts in range(1, min(12, radius + 4) + 1):
        groups = correlated_groups(n, both, parts)
        goal = radius - parts + 1
        # Least cost by the sum of the thresholds of the partitions so far.
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            after: dict[int, tuple[float, list[int]]] = {}
            for t in range(-1, min(radius, len(g)) + 1):
                if t > 3:
                    break
                probes = comb(len(g), t) if t >= 0 else 0
                pairs = n / 2 * within(differ[g], t) * max(1, probes / 4) if t >= 0 else 0
                cost = ROW_COST * probes + PAIR_COST * pairs
                for total, (had, chosen) in states.items():
                    if total + t not in after or had + cost < after[total + t][0]:
                        after[total + t] = (had + cost, [*chosen, t])
            states = after
        if goal in states and (best is None or states[goal][0] < best[0]):
            best = (states[goal][0], groups, states[goal][1])
    return best[1], best[2]


def probe_masks(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """One mask per probe: the partition's bits but for as many as its threshold."""
    masks = []
    for g, t in zip(groups, thresholds):
        if t >= 0:
            masks += [sum(1 << b for b in g if b not in out) for out in map(set, combinations(g, t))]
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def joined_links(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius, one for each fingerprint reached: a search from one that is left
    looks only at those not reached yet."""
    u, v, left = [], [], f
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                reached, left = left[near], left[~near]
                u.append(np.full(len(reached), x))
                v.append(reached)
                todo.extend(reached)
    return (np.concatenate(u), np.concatenate(v)) if u else (f[:0], f[:0])


def links_of_runs(key: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal key: all pairs, or in a run with very many, enough to join what they join."""
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[heads, len(key)])
    us, vs = [], []
    small = np.repeat((sizes > 1) & (sizes <= 128), sizes)
    at, number = np.flatnonzero(small), np.repeat(np.arange(len(sizes)), sizes)
    for step in range(1, int(sizes[(sizes <= 128)].max(initial=1))):
        at = at[at + step < len(key)]
        at = at[number[at] == number[at + step]]
        hit = at[np.bitwise_count(f[at] ^ f[at + step]) <= radius]
        us.append(hit)
        vs.append(hit + step)
    i, j = (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64),) * 2
    dense = np.bincount(number[i], minlength=len(sizes)) > 2 * sizes
    plain = ~dense[number[i]] if len(i) else np.empty(0, bool)
    out = [(f[i[plain]], f[j[plain]])]
    for k in np.flatnonzero(dense | (sizes > 128)):
        own = f[heads[k] : heads[k] + sizes[k]]
        # Each run searches in an order of its own, so that runs in common give different links.
        out.append(joined_links(own[np.argsort(own * (np.uint64(key[heads[k]] & 0x7FFFFFFFFFFFFFFF) | np.uint64(1)))], radius))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _links(probes: DataFrame, radius: int) -> DataFrame:
    """u, v from probes (g, f): those that share g are verified."""
    dealt = probes.select("g", "f").repartition("g").sortWithinPartitions("g")

    def run(batches):
        held = []

        def flush(rows):
            key, f = (np.concatenate([r[k] for r in rows]) for k in range(2))
            u, v = links_of_runs(key, f, radius)
            return pa.RecordBatch.from_pydict({"u": u.view(np.int64), "v": v.view(np.int64)})

        for b in batches:
            key = b.column("g").to_numpy()
            if not len(key):
                continue
            f = b.column("f").to_numpy().view(np.uint64)
            # The last run may go on in the next batch.
            cut = int(np.searchsorted(key, key[-1]))
            if cut or held and held[-1][0][-1] != key[0]:
                yield flush([*held, (key[:cut], f[:cut])])
                held = []
            held.append((key[cut:], f[cut:]))
        if held:
            yield flush(held)

    return dealt.mapInArrow(run, "u long, v long")


def probed(rows: DataFrame, radius: int, keep: tuple[str, ...] = ()) -> list[DataFrame]:
    """f, the columns of keep, and g: any two rows with f within the radius share a g in one of the frames."""
    n, both = bit_statistics(rows)
    groups, thresholds = allocate(n, both, radius)
    masks = probe_masks(groups, thresholds)

    def probes(rows: DataFrame, masks: list[int], *before: str) -> DataFrame:
        values = F.array(*[F.lit(signed(m)) for m in masks])
        spread = rows.select("f", *keep, *before, F.posexplode(values).alias("r", "mask"))
        return spread.select("f", *keep, F.xxhash64(*before, "r", F.col("f").bitwiseAND(F.col("mask"))).alias("g"))

    found = probes(rows, masks)
    sizes = staged(found.groupBy("g").count().where(F.col("count") > LARGE), "large_probes")
    if sizes.isEmpty():
        return [found]
    # Those that share a large probe differ in few of all bits, so they share one of radius + 1 further parts too.
    parts = [sum(1 << b for b in range(64 * k // (radius + 1), 64 * (k + 1) // (radius + 1))) for k in range(radius + 1)]
    large = found.join(sizes, "g", "left_semi")
    return [found.join(sizes, "g", "left_anti"), probes(large, parts, "g")]


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """u, v: links that join all fingerprints within the radius of one another. distinct: f, no value twice."""
    return reduce(DataFrame.unionByName, [_links(p, radius) for p in probed(distinct, radius)])


class Search:
    """Pairs to compare within runs of equal key. Members of a run are in the order of their nodes, and each in turn is
    paired with the later ones that are within the radius, that could be alike enough, and not yet joined to it.
    Two texts need s / (1 + s) of both sizes as common shingles. Each bit of one's bitmap that the other's lacks is a
    shingle not in common, so what bits leave bounds the common ones from above (exact; long texts fill all bits).
    With a share of 0, dense runs make no pair and are all left. Else a run that has made its share of pairs (`share` times its members, FEW at least) stops after a member; it goes on
    from there in the next round, when what the comparisons joined makes no more pairs."""

    def __init__(self, radius: int, similarity: float, share: int):
        self.radius, self.similarity, self.share = radius, similarity, share

    def near(self, f, size, bits, a, b) -> np.ndarray:
        """Whether the texts of pairs a, b are to be compared; a may be one for all of b."""
        found = np.zeros(len(f[b]), bool)
        found[self.hits(f, size, bits, None, a, b)] = True
        return found

    def hits(self, f, size, bits, label, a, b) -> np.ndarray:
        """The places of the pairs that are to be compared. Few are within the radius: only these are looked at further."""
        hit = np.flatnonzero(np.bitwise_count(f[a] ^ f[b]) <= self.radius)
        one = isinstance(a, slice)
        of = lambda v: v[a] if one else v[a[hit]]
        to = (lambda v: v[b][hit]) if isinstance(b, slice) else (lambda v: v[b[hit]])
        x, y = of(size), to(size)
        need = (self.similarity / (1 + self.similarity) - 1e-9) * (x + y)
        kept = np.minimum(x, y) >= need
        kept = np.flatnonzero(kept if label is None else kept & (of(label) != to(label)))
        hit = hit[kept]
        if bits is not None and len(hit):
            p, q, x, y = of(bits), to(bits), x if one else x[kept], y[kept]
            common = np.minimum(x - np.bitwise_count(p & ~q).sum(1, dtype=np.int64), y - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))
            hit = hit[common >= need[kept]]
        return hit

    def run(self, f, node, size, bits, label) -> tuple[np.ndarray, np.ndarray, int | None]:
        """Pairs of one run, and the last node paired with all others if some are left."""
        n, most = len(f), max(FEW, self.share * len(f))
        names, at, times = np.unique(label, return_inverse=True, return_counts=True)
        if len(names) == 1:
            return node[:0], node[:0], None
        if len(names) < n and (found := self._pivots(f, node, size, bits, label, np.flatnonzero(at != times.argmax()), most, False))[2] is None:
            return found  # all pairs of different labels have a member that is not of the commonest
        return self._pivots(f, node, size, bits, label, np.arange(n), most, True)

    def _pivots(self, f, node, size, bits, label, pivots, most, in_order) -> tuple[np.ndarray, np.ndarray, int | None]:
        u, v, made, open_ = [node[:0]], [node[:0]], 0, np.ones(len(f), bool)
        for k, x in enumerate(pivots):
            rest = slice(x + 1 if in_order else 0, None)
            open_[x] = False
            hit = self.hits(f, size, bits, label, slice(x, x + 1), rest) + rest.start
            hit = hit[open_[hit]]
            u.append(np.minimum(node[hit], node[x]))
            v.append(np.maximum(node[hit], node[x]))
            made += len(hit)
            if made >= most and k < len(pivots) - 1:
                return np.concatenate(u), np.concatenate(v), int(node[x])
        return np.concatenate(u), np.concatenate(v), None

    def runs(self, key, f, node, size, label=None, bits=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of all runs, and the keys and last nodes of the runs in which some are left."""
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[heads, len(key)])
        label = node if label is None else label
        at, number = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 128), sizes)), np.repeat(np.arange(len(sizes)), sizes)
        i, j = [node[:0]], [node[:0]]
        for step in range(1, int(sizes[(sizes <= 128)].max(initial=1))):
            at = at[at + step < len(key)]
            at = at[number[at] == number[at + step]]
            hit = at[self.hits(f, size, bits, label, at, at + step)]
            i.append(hit)
            j.append(hit + step)
        i, j = np.concatenate(i), np.concatenate(j)
        dense = np.bincount(number[i], minlength=len(sizes)) > np.maximum(FEW, (self.share or SHARE) * sizes)
        plain = ~dense[number[i]]
        us, vs, keys, last = [node[i[plain]]], [node[j[plain]]], [], []
        for k in np.flatnonzero(dense | (sizes > 128)):
            own = slice(heads[k], heads[k] + sizes[k])
            if not self.share:
                keys.append(key[heads[k]])
                last.append(FIRST)
                continue
            u, v, more = self.run(f[own], node[own], size[own], None if bits is None else bits[own], label[own])
            us.append(u)
            vs.append(v)
            if more is not None:
                keys.append(key[heads[k]])
                last.append(more)
        return np.concatenate(us), np.concatenate(vs), np.array(keys, np.int64), np.array(last, np.int64)

    def __call__(self, probes: DataFrame) -> DataFrame:
        """a, b: pairs of nodes; where more is true, a run's g and the last node that is done. probes: g, f, node,
        size, and label and the bitmap where some are joined."""
        names = ["g", "f", "node", "size", *(["label", *BITS] if "label" in probes.columns else [])]
        dealt = probes.select(*names).repartition("g").sortWithinPartitions("g", "node")

        def run(batches):
            held = []

            def flush(rows):
                key, f, node, size, *rest = (np.concatenate([r[k] for r in rows]) for k in range(len(names)))
                more = (rest[0], np.stack(rest[1:], 1).view(np.uint64)) if rest else ()
                a, b, keys, last = self.runs(key, f.view(np.uint64), node, size, *more)
                more = np.repeat([False, True], [len(a), len(keys)])
                return pa.RecordBatch.from_pydict({"a": np.r_[a, keys], "b": np.r_[b, last], "more": more})

            for b in batches:
                cols = [b.column(c).to_numpy() for c in names]
                key = cols[0]
                if not len(key):
                    continue
                # The last run may go on in the next batch.
                cut = int(np.searchsorted(key, key[-1]))
                if cut or held and held[-1][0][-1] != key[0]:
                    yield flush([*held, [c[:cut] for c in cols]])
                    held = []
                held.append([c[cut:] for c in cols])
            if held:
                yield flush(held)

        return dealt.mapInArrow(run, "a long, b long, more boolean").distinct()


def _text_key(text: str) -> Column:
    """A hash of the text; a null counts as the empty text."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words_in: int = 4, radius: int = 4, marks: bool = True) -> DataFrame:
    """One row per input row: the id, fingerprint (hex) and component_id, the least id that links reach; with marks,
    text_key and component_key too, by which one_of_each() tells rows and components apart whatever their ids are."""
    prepare(docs.sparkSession)
    given = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), _text_key(text).alias("text_key")) if marks else docs
    rows = staged(fingerprints(given, text, words_in, (doc_id, "text_key") if marks else (doc_id,)), "fingerprints")
    distinct = staged(rows.groupBy("f").agg(F.min("c0").alias("least")), "distinct")
    named = _named(components(links(distinct, radius)), distinct.select(F.col("f").alias("node"), "least"))
    of = named.select(F.col("node").alias("f"), F.col("component").alias("component_id"), F.col("root").alias("component_key"))
    out = rows.join(of, "f").withColumn("fingerprint", F.lower(F.lpad(F.hex("f"), 16, "0")))
    return out.select(F.col("c0").alias(doc_id), "fingerprint", "component_id", *([F.col("c1").alias("text_key"), "component_key"] if marks else []))


def _named(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component, the least id of a node's component, and root. roots: node, root of the linked; nodes: node, least."""
    least = roots.join(nodes, "node").groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(least, "root").select("node", "component", "root")
    return nodes.join(linked, "node", "left").select("node", F.coalesce("component", "least").alias("component"), F.coalesce("root", "node").alias("root"))


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words_in: int = 5, radius: int = 9, similarity: float = 0.8) -> DataFrame:
    """One row per input row: the id, component_id, the least id that links reach, and text_key and component_key, by
    which one_of_each() tells rows and components apart. A link is two texts whose shingles have a Jaccard similarity of at least `similarity`. Candidates are within the radius by one of four
    fingerprints; equal texts are one. Every candidate pair is compared in full, but for those that comparisons have
    joined already, or that their bitmaps of shingles show to be less alike. Of pairs between 0.8 and 0.85 the radius of 9 finds about 98 in 100 in trials; of more alike ones,
    all but a few in a thousand."""
    prepare(docs.sparkSession)
    keyed = docs.select(F.col(f"`{doc_id}`").alias("i"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), _text_key(text).alias("tk"))
    rows = staged(fingerprints(keyed, "t", words_in, ("i", "tk"), four=True), "fingerprints")
    nodes = staged(rows.groupBy(F.col("c1").alias("node")).agg(F.min("c0").alias("least"), *[F.min(c).alias(c) for c in (*FOUR, "size", *BITS)]), "nodes")
    runs = []
    for k, c in enumerate(FOUR):
        runs += [p.withColumn("g", F.xxhash64(F.lit(k), "g")) for p in probed(nodes.select(F.col(c).alias("f"), "node", "size"), radius, ("node", "size"))]
    runs = reduce(DataFrame.unionByName, runs)

    def compare(batches):
        of = Shingles(words_in)
        for b in batches:
            same = [overlap(of(a, x), of(c, y)) >= similarity for a, c, x, y in zip(*[b.column(k).to_pylist() for k in ("a", "b", "x", "y")])]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["u", "v"]).filter(pa.array(same, pa.bool_()))

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One text of each node, written in buckets by node: each round's join with it leaves the texts where they are.
    of_nodes = bucketed(keyed.groupBy(F.col("tk").alias("node")).agg(F.first("t").alias("t")), "node", tasks, "node_texts")
    share, labels, found = 0, None, staged(Search(radius, similarity, 0)(runs), "candidates")
    while True:
        # Dealt by number: pairs are few bytes, and comparing them is the work.
        pairs = found.where("not more").select("a", "b").repartition(tasks, "a")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = staged(of_nodes.join(wanted, "node"), "texts")
        checked = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(compare, "u long, v long")
        labels = staged(components(checked if labels is None else checked.unionByName(labels.toDF("u", "v"))), "labels")
        left = found.where("more").select(F.col("a").alias("g"), F.col("b").alias("done"))
        if left.isEmpty():
            break
        # The runs that are not through go on after their last node, with what is joined by now.
        rest = runs.join(left, "g").where((F.col("node") > F.col("done")) | (F.col("done") == FIRST)).drop("done")
        rest = rest.select("g", "f", "node", "size", *(BITS if share else []))
        runs = staged(rest if share else rest.join(nodes.select("node", *BITS), "node"), "runs")
        share = 4 * share or SHARE
        joined = runs.join(labels.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        found = staged(Search(radius, similarity, share)(joined), "candidates")
    named = _named(labels, nodes.select("node", "least"))
    return rows.join(named, rows["c1"] == named["node"]).select(F.col("c0").alias(doc_id), F.col("component").alias("component_id"), F.col("c1").alias("text_key"), F.col("root").alias("component_key"))


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of its least id, and of these the least text_key, all columns kept.
    Nulls come last. Of rows that share an id and a text, any one stays. found: doc_id, text_key and component_key of
    every row."""
    least = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("i"), "text_key")).alias("x")
    kept = found.groupBy("component_key").agg(least).select(F.xxhash64("x.i", "x.text_key").alias("h"), "x.i", F.col("x.text_key").alias("tk"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(F.xxhash64(F.col(f"`{doc_id}`"), _text_key(text)).alias("h"), F.col(f"`{doc_id}`").alias("i"), _text_key(text).alias("tk"), row)
    held = own.join(kept, (own.h == kept.h) & own.i.eqNullSafe(kept.i) & (own.tk == kept.tk), "left_semi")
    return held.groupBy("h", "i", "tk").agg(F.first("row").alias("row")).select("row.*")
