"""Removal of repeated byte strings by suffix arrays of shards.

Every byte covered by a string of `length` bytes that starts anywhere else is found, over all
documents. Strings meet as follows. Each window of `length` bytes has an anchor, its least hashed
k-mer (the leftmost of equals); equal windows have equal anchors at equal places. An anchor's
context is all windows whose anchor it is, which stand in a row. Contexts are counted by anchor and content:

* equal contexts repeat as a whole; their copies are marked where they stand, and one stands for all;
* contexts that differ but share an anchor are gathered, by anchor, into shards. A shard's suffix
  array is made by induced sorting, permuted longest common prefixes come from it, and runs of
  suffixes that agree in `length` bytes at two places or more are repeats;
* an anchor with more contexts than a shard should hold is split: its windows are halved by the
  place of the anchor in them, each half is keyed by the bytes that all its windows share, and
  counted again, until no group is too large. Halving ends at single windows, so the split is exact.

Contexts of anchors that occur once are never shuffled with their bytes.

Defined results: a null text counts as empty; texts under `length` bytes keep everything; rows that
repeat an id and text count as two documents, and both get the marks, whatever the id is (null too);
their spans are made once. Very long texts are read in blocks of STEP windows. There are no ties:
every copy of a repeat is marked. Columns to keep may have any names; an empty table gives no rows.
Equality of whole contexts is by 64-bit hashes within one anchor's group.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm import suffix
from partloom.llm.base import prepare, staged

#: Bytes of an anchor: a multiple of this, about a third of a window. Longer ones would be more, shorter ones would meet by chance.
KMER = 32
#: Bytes of contexts that make a shard, and contexts of one anchor from which it is split.
SHARD_BYTES, SPLIT_AT = 1_000_000, 1000
#: Window starts handled at a time, so that a very long text needs bounded memory.
STEP = 1 << 20
PLACE = np.uint64((1 << 22) - 1)
SEPARATOR = b"\xff"  # no byte of UTF-8
KEY = ["k1", "k2"]


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def kmer(length: int) -> int:
    return max(1, length // (3 * KMER)) * KMER


def anchors(buf: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all windows, ascending, the hashes of the k-mers there, and the first and last start
    of the windows that are the anchor's."""
    n, w = len(buf), length - kmer(length) + 1
    places, hashes, firsts = [], [], []
    for base in range(0, n - length + 1, STEP):
        stop = min(base + STEP, n - length + 1) + length - 1  # end of the last window
        part = buf[base:stop]
        m = len(part) - KMER + 1
        x = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        h = x[:m] * np.uint64(0x9E3779B97F4A7C15)
        for k, c in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5), 1):
            h = (h ^ (h >> np.uint64(29))) + x[8 * k : 8 * k + m] * np.uint64(c)
        m = len(part) - kmer(length) + 1
        first = h
        for k in range(KMER, kmer(length), KMER):
            h = (h[:m] ^ (h[:m] >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + first[k : k + m]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        v = (h & ~PLACE) | np.arange(m, dtype=np.uint64)
        # Least value of each w neighbours: running minima from both ends of blocks of w.
        blocks = -(-m // w)
        padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:m] = v
        grid = padded.reshape(blocks, w)
        fore = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: m - w + 1], fore[w - 1 : m])
        change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        at = (least[change] & PLACE).astype(np.int64)
        places.append(at + base)
        hashes.append(h[at])
        firsts.append(change + base)
    if not places:
        return (np.empty(0, np.int64),) * 4
    at, one = np.unique(np.concatenate(places), return_index=True)
    first = np.concatenate(firsts)[one]
    return at, np.concatenate(hashes)[one].view(np.int64), first, np.r_[first[1:] - 1, n - length]


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def keyed(docs: DataFrame, text: str, doc_id: str, more: tuple[str, ...] = ()) -> DataFrame:
    """k1, k2: hashes that tell documents apart; t: the text; then the columns named in more."""
    t, i = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.col(f"`{doc_id}`").cast("string")
    return docs.select(F.xxhash64(i).alias("k1"), F.xxhash64(t, i).alias("k2"), t.alias("t"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(more)])


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """One row per anchor: the document, the place p, the context's place s and bytes z, the anchor's hash g and the content c."""

    def run(batches):
        for b in batches:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            out = {"k1": [], "k2": [], "p": [], "s": [], "z": [], "g": [], "c": []}
            for row, t in enumerate(b.column("t").to_pylist()):
                buf = raw(t)
                if len(buf) < length:
                    continue
                p, g, s, last = anchors(buf, length)
                z = last - s + length
                c = signed([xxhash.xxh3_64_intdigest(buf[a : a + n], q - a) for a, n, q in zip(s.tolist(), z.tolist(), p.tolist())])
                for name, v in (("k1", np.full(len(p), k1[row])), ("k2", np.full(len(p), k2[row])), ("p", p), ("s", s), ("z", z), ("g", g), ("c", c)):
                    out[name].append(v)
            if out["p"]:
                yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()})

    return rows.where(F.octet_length("t") >= length).mapInArrow(run, "k1 long, k2 long, p long, s long, z long, g long, c long")


def _counted(rows: DataFrame) -> DataFrame:
    """rows that repeat, or whose group does: with n, how many have the same content, and kinds, how many
    contents the group has. Both counts add up within tasks first, and only groups of interest are joined back."""
    same = rows.groupBy("g", "c").agg(F.sum("n").alias("n"))
    kinds = same.groupBy("g").agg(F.count("*").alias("kinds"), F.max("n").alias("most"))
    of_note = kinds.where((F.col("kinds") > 1) | (F.col("most") > 1)).select("g", "kinds")
    return same.join(of_note, "g").where((F.col("kinds") > 1) | (F.col("n") > 1))


def _shard_repeats(length: int):
    """Repeats in a shard: rows k1, k2, s, n, x (a context's bytes, from place s) to merged spans."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])

    def run(shard: pa.Table) -> pa.Table:
        xs = shard.column("x").to_pylist()
        sizes = np.fromiter(map(len, xs), np.int64, len(xs))
        buf = SEPARATOR.join(xs) + SEPARATOR
        t = np.zeros(len(buf) + 1, np.int32)
        t[:-1] = np.frombuffer(buf, np.uint8)
        t[:-1] += 1
        sa = suffix.induced(t, 257)[1:]
        common = suffix.plcp(buf, sa)[sa]
        run_of = np.cumsum(common < length) - 1
        begin = np.cumsum(sizes + 1) - sizes - 1
        row = np.repeat(np.arange(len(xs)), sizes + 1)[sa]
        within = sa - begin[row]
        k1, k2, s, n = (shard.column(c).to_numpy() for c in ("k1", "k2", "s", "n"))
        doc = np.unique(np.stack([k1, k2]), axis=1, return_inverse=True)[1].ravel()
        place = doc[row].astype(np.int64) << 40 | (s[row] + within)
        heads = np.flatnonzero(np.r_[True, run_of[1:] != run_of[:-1]])
        twice = np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)
        twice |= np.maximum.reduceat(n[row], heads) > 1
        hit = twice[run_of] & (sizes[row] - within >= length) & (n[row] == 1)
        row, at = row[hit], (s[row] + within)[hit]
        by = np.lexsort((at, row))
        row, at = row[by], at[by]
        if not len(row):
            return schema.empty_table()
        first = np.r_[True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + length)]
        last = np.r_[first[1:], True]
        who = row[first]
        return pa.table([k1[who], k2[who], at[first], at[last] + length], schema=schema)

    return run


def spans(docs: DataFrame, length: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """k1, k2 and spans: the maximal runs [s, e) of all repeats of a document, in order; one row for rows that share an id and a text."""
    if length < 2 * KMER:
        raise ValueError(f"length must be at least {2 * KMER}")
    prepare(docs.sparkSession)
    rows = keyed(docs, text, doc_id)
    found = staged(_anchor_rows(rows, length), "anchors")
    noted = _counted(found.withColumn("n", F.lit(1).cast("long")))
    hits = staged(found.join(noted, ["g", "c"]), "repeated_anchors")
    marks = [hits.where("n > 1").select(*KEY, "s", (F.col("s") + F.col("z")).alias("e"))]

    # One of each content goes on, with its bytes.
    lone = hits.where("kinds > 1").groupBy("g", "c").agg(F.min(F.struct(*KEY, "s", "z", "p")).alias("w"), F.first("n").alias("n"), F.first("kinds").alias("kinds"))
    wanted = lone.groupBy(F.col("w.k1").alias("k1"), F.col("w.k2").alias("k2")).agg(F.collect_list(F.struct("w.s", "w.z", "w.p", "g", "n", "kinds")).alias("at"))
    texts = rows.where(F.octet_length("t") >= length).join(wanted, KEY)  # copies of id and text: one of them serves in each task

    def cut(batches):
        done = set()
        for b in batches:
            out = []
            for k1, k2, t, at in zip(*(b.column(c).to_pylist() for c in (*KEY, "t", "at"))):
                if (k1, k2) in done:
                    continue
                done.add((k1, k2))
                buf = raw(t)
                for a in at:
                    s = a["s"]
                    out.append((k1, k2, s, a["n"], buf[s : s + a["z"]], a["g"], a["kinds"], a["p"] - s, 0, length - kmer(length)))
            kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 5
            cols = list(zip(*out)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["k1", "k2", "s", "n", "x", "g", "kinds", "q", "lo", "hi"])

    parts = "k1 long, k2 long, s long, n long, x binary, g long, kinds long, q long, lo long, hi long"
    contexts = staged(texts.mapInArrow(cut, parts), "contexts")
    ready = [contexts.where(F.col("kinds") <= SPLIT_AT)]
    large = contexts.where(F.col("kinds") > SPLIT_AT)
    while not large.isEmpty():
        halves = staged(large.drop("kinds").mapInArrow(_halve(length), parts.replace("kinds long", "c long")), "halves")
        # A content stands for n places already; only the first row of each content goes on.
        noted = _counted(halves)
        met = staged(halves.withColumnRenamed("n", "m").join(noted, ["g", "c"]), "repeated_halves")
        marks.append(met.where("n > 1 and m = 1").select(*KEY, "s", (F.col("s") + F.octet_length("x")).alias("e")))
        one = met.where("kinds > 1").groupBy("g", "c").agg(F.min(F.struct(*KEY, "s", "q")).alias("w"))
        names = [x.split()[0] for x in parts.split(", ")]
        again = staged(met.join(one, ["g", "c"]).where((F.col("w.k1") == F.col("k1")) & (F.col("w.k2") == F.col("k2")) & (F.col("w.s") == F.col("s")) & (F.col("w.q") == F.col("q"))).select(*names), "split_contexts")
        ready.append(again.where(F.col("kinds") <= SPLIT_AT))
        large = again.where(F.col("kinds") > SPLIT_AT)

    gathered = ready[0]
    for r in ready[1:]:
        gathered = gathered.unionByName(r)
    size = gathered.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    dealt = gathered.select(*KEY, "s", "n", "x", F.pmod(F.xxhash64("g"), F.lit(shards)).alias("shard"))
    marks.append(dealt.groupBy("shard").applyInArrow(_shard_repeats(length), "k1 long, k2 long, s long, e long"))
    total = marks[0]
    for m in marks[1:]:
        total = total.unionByName(m)
    # Copies of an id and a text have given the same spans; they are one before any list is made.
    listed = total.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def merge(batches):
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for b in batches:
            out = [[{"s": s, "e": e} for s, e in merged([(a["s"], a["e"]) for a in at])] for at in b.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), pa.array(out, kind)], names=[*KEY, "spans"])

    return listed.mapInArrow(merge, "k1 long, k2 long, spans array<struct<s: long, e: long>>")


def _halve(length: int):
    """Contexts whose windows hold the anchor between lo and hi bytes after their start, to two halves each.
    A half's key is a hash of the bytes that all its windows would share."""

    def run(batches):
        for b in batches:
            out = []
            for k1, k2, s, n, x, g, q, lo, hi in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "s", "n", "x", "g", "q", "lo", "hi"))):
                mid = (lo + hi) // 2
                for a, z in ((lo, mid), (mid + 1, hi)):
                    # q: the anchor's place in x. Windows start at q - a down to q - z, as far as x has them.
                    first, final = max(0, q - z), min(q - a, len(x) - length)
                    if a > z or final < first:
                        continue
                    part = x[first : final + length]
                    key = xxhash.xxh3_64_intdigest(x[q - a : q - z + length], (g ^ (a << 20 | z)) & 0xFFFFFFFFFFFFFFFF)
                    content = xxhash.xxh3_64_intdigest(part, q - first)
                    out.append((k1, k2, s + first, n, part, key, content, q - first, a, z))
            cols = list(zip(*out)) or [()] * 10
            arrays = [pa.array(signed(list(c))) if k in (5, 6) else pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "s", "n", "x", "g", "c", "q", "lo", "hi"])

    return run


def merged(found: list[tuple[int, int]] | None, n: int | None = None) -> list[tuple[int, int]]:
    """Maximal runs, within n bytes if n is given."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(found or []):
        e = e if n is None else min(e, n)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        elif s < e:
            out.append((s, e))
    return out


def remaining(buf: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(buf)]
    return b"".join(buf[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _removed(docs: DataFrame, length: int, text: str, doc_id: str, keep: tuple[str, ...]) -> DataFrame:
    """c0, c1, ..., the columns of keep, and what remove() adds."""
    found = spans(docs, length, text, doc_id)
    given = keyed(docs, text, doc_id, keep).join(found, KEY, "left").drop(*KEY)
    own = [f"c{k}" for k in range(len(keep))]

    def run(batches):
        for b in batches:
            out = []
            for t, at in zip(b.column("t").to_pylist(), b.column("spans").to_pylist()):
                buf = raw(t)
                runs = merged([(a["s"], a["e"]) for a in at or []], len(buf))
                left = remaining(buf, runs)
                out.append((len(buf), len(buf) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            cols = list(zip(*out)) or [()] * 5
            made = [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *made], names=[*own, *ADDED])

    head = "".join(f"{c} {given.schema[c].dataType.simpleString()}, " for c in own)
    return given.mapInArrow(run, head + "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


ADDED = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def remove(docs: DataFrame, length: int, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the columns of keep, n_bytes, n_removed, n_spans, kept_sha256 and kept_text
    (the bytes left; what a cut leaves of a split character is dropped)."""
    return _removed(docs, length, text, doc_id, keep).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], *ADDED)


def cut_repeats(docs: DataFrame, length: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with repeats cut out of the text, all columns kept; rows whose whole text is cut away go."""
    done = _removed(docs, length, text, doc_id, tuple(docs.columns))
    cut = F.col("n_removed") > 0
    left = done.where(~(cut & (F.trim("kept_text") == "")))
    return left.select(*[(F.when(cut, F.col("kept_text")).otherwise(F.col(f"c{k}")) if c == text else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)])
