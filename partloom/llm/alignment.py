"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

A state says which side leads and which of its bytes the other side has not matched yet. The side
that is behind gives the next token; what is left over of the longer one is the next state, and an
empty rest closes a group. Transitions are memoised by state and token, and those two that close a
group of one token each by both tokens.

Tokens of a group are all linked with one another. How many documents hold a pair of ids linked is
counted over the whole corpus: distinct pairs of each document are added up within tasks before a
shuffle. Counts of the most frequent pairs, by whole levels of frequency and at most KNOWN of them,
are broadcast; the others meet their documents in a join, in which no pair is frequent.

Defined results: a text that is null or empty, or whose joined tokens of either side are not the
space and the text (a U+2581 in it, say), has no tokens: zeros, and no groups. Special tokens' strings are ordinary
text. Repeated rows count as documents of their own. Texts of any length are done; a group of very
many tokens is counted by its distinct ids. Ties: all pairs whose count is their first id's highest are best. Columns
to keep may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.base import prepare, staged
from partloom.llm.class_lm import LEVEL, level_within
from partloom.llm.packing import _byte_letters, encoder

#: Pairs whose counts are broadcast, at most: 17 bytes each.
KNOWN = 1_000_000
#: Distinct pairs of documents that a task adds up at a time, transitions that a worker remembers, and links of a
#: group from which it is counted by distinct ids.
GATHERED, REMEMBERED, WIDE = 4_000_000, 2_000_000, 4096
#: Bits of the second id in a pair.
SHIFT = 20


class Transducer:
    """Tokens of both sides to groups."""

    def __init__(self, first: str, second: str):
        """Paths of a tokenizers file of byte-level BPE, and of a sentencepiece model."""
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=second)
        known = encoder(first)
        if known.fast:
            self.first, words = known.fast.encode_ordinary, known.words
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(first)
            slow.encode_special_tokens = True
            self.first, words = (lambda t: slow.encode(t, add_special_tokens=False).ids), {i: w for w, i in slow.get_vocab().items()}
        letters = _byte_letters()
        self.a = {i: bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for i, w in words.items()}
        piece = self.model.id_to_piece
        self.b = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]
        self.forget()

    def forget(self) -> None:
        """State 0 has no residual; of the others, whether the first side leads, and its unmatched bytes."""
        self.states, self.leads, self.rest = {(True, b""): 0}, [True], [b""]
        self.moves: dict[int, int] = {}
        self.single: dict[int, str] = {}

    def move(self, state: int, token: int) -> int:
        """The state after a token of the side that is behind; in state 0 it is one of the first side."""
        rest = self.rest[state]
        ahead = self.leads[state]
        own = self.a[token] if not state or not ahead else self.b[token]
        if rest.startswith(own):
            after = (ahead, rest[len(own) :])
        elif own.startswith(rest):
            after = (not ahead if state else True, own[len(rest) :])
        else:
            raise ValueError("the sides have different bytes")
        if not after[1]:
            after = (True, b"")
        found = self.states.setdefault(after, len(self.leads))
        if found == len(self.leads):
            self.leads.append(after[0])
            self.rest.append(after[1])
        self.moves[state << SHIFT | token] = found
        return found

    def alike(self, x: int, y: int) -> str:
        """The group of one token each as text, or nothing if two tokens don't close one."""
        state = self.moves.get(x)
        state = self.moves.get((self.move(0, x) if state is None else state) << SHIFT | y)
        text = f"{x}|{y}" if (self.a[x] == self.b[y] if state is None else state == 0) else ""
        self.single[x << SHIFT | y] = text
        return text

    def groups(self, a: list[int], b: list[int]) -> tuple[list[str], list[int], list[tuple[np.ndarray, np.ndarray]]]:
        """Each group as text, its pairs (x << SHIFT | y, repeats included), and distinct pairs with their numbers of very large groups."""
        if len(self.moves) + len(self.single) > REMEMBERED:
            self.forget()
        single, moves, leads = self.single, self.moves, self.leads
        texts, pairs, wide, i, j, n = [], [], [], 0, 0, len(a)
        while i < n:
            key = a[i] << SHIFT | b[j]
            text = single.get(key)
            if text is None:
                text = self.alike(a[i], b[j])
            if text:
                texts.append(text)
                pairs.append(key)
                i += 1
                j += 1
                continue
            x, y, state = i, j, moves[a[i]]
            i += 1
            while state:
                if leads[state]:
                    token = b[j]
                    j += 1
                else:
                    token = a[i]
                    i += 1
                after = moves.get(state << SHIFT | token)
                state = self.move(state, token) if after is None else after
            own, other = a[x:i], b[y:j]
            texts.append(f"{','.join(map(str, own))}|{','.join(map(str, other))}")
            if len(own) * len(other) <= WIDE:
                pairs += [p << SHIFT | q for p in own for q in other]
            else:
                (p, m), (q, k) = (np.unique(np.array(v, np.int64), return_counts=True) for v in (own, other))
                wide.append(((p[:, None] << SHIFT | q).ravel(), np.outer(m, k).ravel()))
        return texts, pairs, wide

    def encoded(self, text: str | None, second: list[int]) -> tuple[list[int], list[int]]:
        """Ids of both sides, or none where the joined bytes are not the space and the text."""
        if not text:
            return [], []
        first, raw = self.first(" " + text), (" " + text).encode("utf-8", "surrogatepass")
        if b"".join([self.b[y] for y in second]) != raw or b"".join([self.a[x] for x in first]) != raw:
            return [], []
        return first, second


def weighed(pairs: list[int], wide: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how many links each has."""
    keys, n = np.unique(np.array(pairs, np.int64), return_counts=True)
    if wide:
        every, at = np.unique(np.concatenate([keys, *[k for k, _ in wide]]), return_inverse=True)
        return every, np.bincount(at, np.concatenate([n, *[m for _, m in wide]])).astype(np.int64)
    return keys, n


_transducers: dict[tuple[str, str], Transducer] = {}


def transducer(first: str, second: str) -> Transducer:
    """One for each Python worker and pair of files."""
    if (first, second) not in _transducers:
        _transducers[first, second] = Transducer(first, second)
    return _transducers[first, second]


def align(docs: DataFrame, first: str, second: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False, pairs: bool = False) -> DataFrame:
    """One row per input row: the columns of keep, n_a, n_b, n_groups, n_links and groups (`a1,a2|b1;a3|b2,b3`), or with
    digest groups_sha256 in its place; with pairs, the distinct linked pairs and their numbers too, as bytes."""
    prepare(docs.sparkSession)
    kept = [f"k{j}" for j in range(len(keep))]
    given = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], F.col(f"`{text}`").cast("string").alias("t"))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256" if digest else "groups", *(["pairs", "times"] if pairs else [])]

    def run(batches):
        of = transducer(first, second)
        for b in batches:
            texts, rows = b.column("t").to_pylist(), []
            for t, ids in zip(texts, of.model.encode([t or "" for t in texts], num_threads=1)):
                x, y = of.encoded(t, ids)
                made, plain, wide = of.groups(x, y)
                said = ";".join(made)
                links = len(plain) + sum(int(n.sum()) for _, n in wide)
                row = [len(x), len(y), len(made), links, hashlib.sha256(said.encode()).hexdigest() if digest and made else said]
                if pairs:
                    keys, n = weighed(plain, wide)
                    row += [keys.astype("<i8").tobytes(), n.astype("<i8" if wide else "<u4").tobytes()]
                rows.append(row)
            cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], *cols], names=[*kept, *names])

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields[: len(keep)])
    kinds = ["long"] * 4 + ["string"] + ["binary"] * 2
    out = given.mapInArrow(run, head + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], *names)


def _pairs(b: pa.RecordBatch):
    """For each row its pairs and their numbers."""
    for k, n in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist()):
        keys = np.frombuffer(k, "<i8")
        yield keys, np.frombuffer(n, "<i8" if len(n) == len(k) else "<u4").astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (the documents that hold it linked) and best (no pair of its first id is in more). rows: pairs, as align() has them."""

    def run(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"pair": keys, "n": n})

        for b in batches:
            for keys, _ in _pairs(b):
                held.append(keys)
                size += len(keys)
                if size >= GATHERED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = staged(rows.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    first = F.shiftright("pair", SHIFT)
    # At most as many rows as the first tokenizer has ids.
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def linked(docs: DataFrame, first: str, second: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), known: int = KNOWN) -> DataFrame:
    """One row per input row: the columns of keep, n_a, n_b, n_groups, n_links, n_best (links whose pair is best), count_sum
    (the sum of their pairs' counts) and groups_sha256."""
    spark = docs.sparkSession
    prepare(spark)
    kept = [f"k{j}" for j in range(len(keep))]
    names = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], F.col(f"`{text}`").alias("t"))
    rows = staged(align(names, first, second, "t", tuple(kept), digest=True, pairs=True).withColumn("r", F.monotonically_increasing_id()), "aligned")
    counts = staged(pair_counts(rows), "best_pairs").withColumn("level", F.expr(LEVEL))
    levels = {r.level: r.n for r in counts.groupBy("level").agg(F.count("*").alias("n")).collect()}
    cut = level_within(levels, known)
    common = counts.where(F.col("level") >= cut).select("pair", "n", "best").toArrow()
    order = np.argsort(common["pair"].to_numpy())
    shared = spark.sparkContext.broadcast(tuple(common[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def run(batches):
        pair, count, best = shared.value
        for b in batches:
            got = []
            for keys, n in _pairs(b):
                at = np.searchsorted(pair, keys)
                at[at == len(pair)] = 0
                hit = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
                at, m = at[hit], n[hit]
                got.append((int((m * best[at]).sum()) if len(at) else 0, int((m * count[at]).sum()) if len(at) else 0, keys[~hit], n[~hit]))
            ends = pa.array(np.cumsum([0, *[len(g[2]) for g in got]]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([g[k] for g in got]) if got else [], pa.int64())) for k in (2, 3)]
            sums = [pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in plain], *sums, *lists], names=[*plain, "n_best", "count_sum", "rare", "times"])

    plain = ["r", *kept, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    head = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in plain)
    partly = staged(rows.select(*plain, "pairs", "times").mapInArrow(run, f"{head}, n_best long, count_sum long, rare array<long>, times array<long>"), "known_pairs")
    rare = partly.select("r", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("r", F.col("x.rare").alias("pair"), F.col("x.times").alias("m"))
    met = rare.join(counts.where(F.col("level") < cut), "pair")
    more = met.groupBy("r").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("b"), F.sum(F.col("m") * F.col("n")).alias("s"))
    none = F.lit(0).cast("long")
    out = partly.join(more, "r", "left").withColumn("n_best", F.col("n_best") + F.coalesce("b", none)).withColumn("count_sum", F.col("count_sum") + F.coalesce("s", none))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
