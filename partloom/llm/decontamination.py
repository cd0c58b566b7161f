"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with floor(rate * m) errors. It is split into one piece more than
that, so one piece at least occurs unchanged wherever the item does; an automaton finds all exact
piece hits in one pass over a text. A hit is verified by Myers' bit-parallel edit distance, first on
the pair of pieces around it, then on ever larger parts up to the whole item: a part of j pieces
may have j - 1 errors, and some hit passes at every level wherever the whole item passes.

Texts and items are compared in lower case with white space made single. Items of under WHOLE_WORDS characters would
match inside ordinary words with an error or two, so they are matched exactly, as whole words. Items are broadcast in
blocks of bounded size; every block meets every text, without a shuffle.

Defined results: null texts and null items match nothing, nor do items without a letter or sign; repeated rows give
repeated results; an empty table, or an empty benchmark, gives no rows (clean(): all of docs). Of several places with the
least distance the first is reported. Very long texts are read whole, in memory in proportion to the longest one.
Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.base import prepare

#: Bytes of item text that are broadcast at once, and characters from which an item may occur with errors, and within words.
BLOCK_BYTES, WHOLE_WORDS = 1_000_000, 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def letters(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(at: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of a pattern of m characters to any substring of text, and where the first such
    substring ends; None beyond most."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return (best, end) if best <= most else None


class Matcher:
    """items: (id, text). rate: errors allowed per character."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.automaton = ahocorasick.Automaton()
        self.known: dict[tuple[int, int, int], dict[str, int]] = {}
        pieces: dict[str, list] = {}
        self.budgets = []
        for k, (_, t) in enumerate(self.items):
            n = math.floor(rate * len(t)) + 1 if len(t) >= WHOLE_WORDS else 1
            self.budgets.append(n - 1)
            edges = [len(t) * j // n for j in range(n + 1)]
            stack = [(0, n, ())]
            while stack:
                lo, hi, above = stack.pop()
                if hi - lo == 1:
                    pieces.setdefault(t[edges[lo] : edges[hi]], []).append((k, edges[lo], above))
                    continue
                above = ((edges[lo], edges[hi], hi - lo - 1), *above)
                mid = (lo + hi) // 2
                stack += [(lo, mid, above), (mid, hi, above)]
        for p, where in pieces.items():
            self.automaton.add_word(p, (len(p), where))
        if pieces:
            self.automaton.make_automaton()

    def _verify(self, text: str, k: int, start: int, at: int, above: tuple) -> tuple[int, int] | None:
        """Distance and end of item k in text, given its piece from `start` at text[at:]."""
        item = self.items[k][1]
        if not above:
            end = at + len(item)
            inside = len(item) < WHOLE_WORDS and (at and text[at - 1].isalnum() and item[0].isalnum() or text[end : end + 1].isalnum() and item[-1].isalnum())
            return None if inside else (0, end)
        found = None
        for a, z, most in above:
            if (own := self.known.get((k, a, z))) is None:
                own = self.known[k, a, z] = letters(item[a:z])
            begin = max(0, at - (start - a) - most)
            found = myers(own, z - a, text[begin : at + (z - start) + most], most)
            if found is None:
                return None
        return found[0], begin + found[1]

    def leaks(self, text: str | None, any_one: bool = False) -> list[tuple[object, int, int]]:
        """Item, least distance and where it first ends (in the normal form) for all items that occur; if any_one, for one of them."""
        if not self.items or not text:
            return []
        text = normal(text)
        best: dict[int, tuple[int, int]] = {}
        upto: dict[int, int] = {}
        for last, (size, where) in self.automaton.iter(text):
            at = last - size + 1
            for k, start, above in where:
                if at < upto.get(k, 0):
                    continue  # inside an occurrence that is verified
                if hit := self._verify(text, k, start, at, above):
                    upto[k] = hit[1] if hit[0] == 0 else at + 1
                    best[k] = min(best.get(k, hit), hit)
                    if any_one:
                        return [(self.items[k][0], *hit)]
        return [(self.items[k][0], *best[k]) for k in sorted(best)]


def _blocks(benchmark: DataFrame, item: str, item_id: str) -> list:
    """The items in broadcasts of about BLOCK_BYTES."""
    items = benchmark.where(F.col(f"`{item}`").isNotNull()).select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item}`").alias("t")).distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    out = []
    for number in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == number).collect()
        out.append(benchmark.sparkSession.sparkContext.broadcast(sorted(((r.i, r.t) for r in mine), key=lambda r: (str(r[0]), r[1]))))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, text: str = "text", doc_id: str = "doc_id", item: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per document row and item that occurs in it: the ids, distance and end."""
    prepare(docs.sparkSession)
    given = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    own = benchmark.schema[item_id].dataType
    kinds = (given.schema["d"].dataType.simpleString(), own.simpleString())

    def block(shared) -> DataFrame:
        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_type

            matcher, kind = Matcher(shared.value, rate), to_arrow_type(own)
            for b in batches:
                rows, found = [], []
                for k, t in enumerate(b.column("t").to_pylist()):
                    hits = matcher.leaks(t)
                    rows += [k] * len(hits)
                    found += hits
                cols = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([b.column("d").take(pa.array(rows, pa.int32())), pa.array(cols[0], kind), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["d", "i", "distance", "end"])

        return given.mapInArrow(run, f"d {kinds[0]}, i {kinds[1]}, distance int, end long")

    found = reduce(DataFrame.unionByName, map(block, _blocks(benchmark, item, item_id)))
    return found.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "distance", "end")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, text: str = "text", item: str = "text", item_id: str = "item_id") -> DataFrame:
    """docs without the rows whose text holds an item, all columns kept. Each row is judged by its own text, whatever ids
    repeat or are null; no shuffle."""
    prepare(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text)
    left = docs.toDF(*[f"c{k}" for k in range(len(names))])

    def without(rows: DataFrame, shared) -> DataFrame:
        def run(batches):
            matcher = Matcher(shared.value, rate)
            for b in batches:
                yield b.filter(pa.array([not matcher.leaks(t, any_one=True) for t in b.column(at).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    return reduce(without, _blocks(benchmark, item, item_id), left).toDF(*names)
