"""Brown class-based n-gram language model.

Exchange clustering assigns words to classes so as to maximise the likelihood of the corpus's class bigrams, in three
steps that together give every training word a class:

* the most frequent words are exchanged between classes until a sweep moves none, by the full likelihood;
* every other known word (known: counts held in a broadcast of stated size) makes one exchange step: it goes to the class
  of greatest gain, given the classes on both sides of all its occurrences and the classes as they stand;
* every word beyond these makes the same step, in Spark: its occurrences are gathered by word.

Words never seen are a class of their own, and so is the end of a text. A text's score is the sum over its tokens of
log10 P(class | class before) + log10 P(word | class), both smoothed by adding one, with counts of classes over all
training tokens.

Counts cover all training rows. Words beyond the known ones stay in Spark: in scoring they meet their counts and classes
in a join, with the classes on their sides at hand, so that no text is shuffled.

Defined results: a null text counts as empty (its only token is the end). Repeated rows count as often as they occur, and
give repeated results. With nothing to train on, all counts are zero. An empty table gives no rows. Of words with equal
counts those that come first in the order of bytes are exchanged; of classes with equal gain the first is taken. Very
long texts are read whole, in memory in proportion to the longest. Only the columns named are read, so others may clash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.base import prepare, staged

#: Words that a task counts before it hands its counts on, and occurrences whose gains are worked out at a time.
HELD, TOGETHER = 400_000, 50_000


@dataclass(frozen=True)
class Settings:
    """top_words: words exchanged until none moves. known_words: most words whose counts and classes are broadcast (about
    50 bytes each), taken by whole levels of frequency. longest: words of more bytes are never broadcast, whatever their count."""

    top_words: int = 1500
    classes: int = 48
    known_words: int = 150_000
    longest: int = 256


@dataclass
class ClassModel:
    """ids: known words to places in counts and kinds (their classes). Classes, then the unseen, then the end. step: log10
    P(class | class before); below: log10 of what an emission's count is divided by. The class before a text's first token
    is the end's. rest: a staged table (w, n, c) of all other training words."""

    ids: dict[bytes, int]
    counts: np.ndarray
    kinds: np.ndarray
    step: np.ndarray
    below: np.ndarray
    n: int
    v: int
    ends: int
    rest: DataFrame

    @property
    def unseen(self) -> int:
        return len(self.below) - 2

    @property
    def end(self) -> int:
        return len(self.below) - 1


def tokens(text: str | None) -> list[bytes]:
    """Words, lower-cased in A-Z only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(train: DataFrame, text: str) -> DataFrame:
    """(w binary, n long): how often each word occurs. Each task adds up what it has read."""

    def run(batches):
        held: Counter = Counter()

        def out():
            keys, n = list(held), list(held.values())
            for i in range(0, len(keys), 20000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 20000], pa.binary()), pa.array(n[i : i + 20000], pa.int64())], names=["w", "n"])
            held.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(tokens(t))
                if len(held) > HELD:
                    yield from out()
        yield from out()

    return train.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def bigram_counts(train: DataFrame, text: str, ids: dict[bytes, int], size: int) -> np.ndarray:
    """Counts of neighbouring ids (most frequent words, any other, end), end before the first. Bounded: size**2."""
    shared = train.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        of, rare, end = shared.value, size - 2, size - 1
        total = np.zeros(size * size, np.int64)
        for b in batches:
            codes = []
            for t in b.column(0).to_pylist():
                row = np.fromiter((of.get(w, rare) for w in tokens(t)), np.int64)
                row = np.r_[end, row, end]
                codes.append(row[:-1] * size + row[1:])
            if codes:
                at, n = np.unique(np.concatenate(codes), return_counts=True)
                total[at] += n
        used = np.flatnonzero(total)
        for i in range(0, len(used), 50000):
            at = used[i : i + 50000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    rows = train.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size * size)
    total[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return total.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, words: int, classes: int) -> np.ndarray:
    """Class of each of the first `words` ids, by exchange: each word in turn, most frequent first, moves
    to the class that raises the class-bigram likelihood most, until a sweep moves none. The
    last two ids keep classes of their own."""
    k = max(1, min(classes, words))
    of = np.r_[np.arange(words) % k, k, k + 1]
    size = k + 2
    out_of, into = np.zeros((len(of), size)), np.zeros((size, len(of)))
    for c in range(size):
        out_of[:, c] = bigrams[:, of == c].sum(1)
        into[c] = bigrams[of == c].sum(0)
    both = np.zeros((size, size))
    for c in range(size):
        both[c] = out_of[of == c].sum(0)
    own = np.diag(bigrams)
    order = np.argsort(-bigrams[:words].sum(1), kind="stable")
    targets, moved = np.arange(k), 1
    while moved:
        moved = 0
        for w in order:
            a = of[w]
            o, i, s = out_of[w].copy(), into[:, w].copy(), own[w]
            o[a] -= s  # to and from the other words; the word's own pairs apart
            i[a] -= s
            both[a] -= o
            both[:, a] -= i
            both[a, a] -= s
            rows, cols = both.sum(1), both.sum(0)
            # Gain of adding the word to class c: rows and columns of c, their crossing, and the class totals.
            gain_row = (_xlogx(both[:k] + o) - _xlogx(both[:k])).sum(1)
            gain_col = (_xlogx(both[:, :k] + i[:, None]) - _xlogx(both[:, :k])).sum(0)
            d = both[targets, targets]
            crossing = _xlogx(d + o[:k] + i[:k] + s) - _xlogx(d + o[:k]) - _xlogx(d + i[:k]) + _xlogx(d)
            # Totals of the other classes grow by what goes to and comes from the word, whatever c is.
            had_row, had_col = rows[:k] + i[:k], cols[:k] + o[:k]
            totals = _xlogx(had_row) - _xlogx(had_row + o.sum() + s) + _xlogx(had_col) - _xlogx(had_col + i.sum() + s)
            gain = gain_row + gain_col + crossing + totals
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            both[b] += o
            both[:, b] += i
            both[b, b] += s
            if b != a:
                moved += 1
                of[w] = b
                out_of[:, a] -= bigrams[:, w]
                out_of[:, b] += bigrams[:, w]
                into[a] -= bigrams[w]
                into[b] += bigrams[w]
    return of


#: Counts by size: eight levels for each doubling.
LEVEL = "cast(floor(log2(n) * 8) as int)"


def level_within(levels: dict[int, int], most: int) -> int:
    """The lowest level from which upwards there are at most so many words."""
    lowest, total = max(levels, default=0) + 1, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > most:
            break
        lowest = level
    return lowest


def level_reaching(levels: dict[int, int], least: int) -> int:
    """The highest level from which upwards there are so many words, or the lowest of all."""
    total = 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total >= least:
            return level
    return min(levels, default=0)


class Places:
    """Class of every known word, as seen at the places of a text; words that are not known are of class unseen."""

    def __init__(self, ids: dict[bytes, int], kinds: np.ndarray, size: int):
        self.ids, self.size, self.end = ids, size, size - 1
        self.kinds = np.r_[kinds, size - 2]  # at -1: any other word

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words in the known ones (-1: none), and classes with the end's on both sides."""
        of = self.ids.get
        at = np.fromiter((of(w, -1) for w in words), np.int64, len(words))
        return at, np.r_[self.end, self.kinds[at], self.end]


def known_sides(train: DataFrame, text: str, places: Places, top: int) -> DataFrame:
    """(w long, codes, ns): for known words beyond the first `top`, how often each pair of classes stands on their sides."""
    shared, square = train.sparkSession.sparkContext.broadcast(places), places.size**2

    def run(batches):
        seen = shared.value
        for b in batches:
            codes = [np.empty(0, np.int64)]
            for t in b.column(0).to_pylist():
                at, c = seen(tokens(t))
                hit = np.flatnonzero(at >= top)
                codes.append(at[hit] * square + c[hit] * seen.size + c[hit + 2])
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    rows = train.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    code = F.col("code")
    return rows.groupBy(F.expr(f"code div {square}").alias("w")).agg(F.collect_list(code % square).alias("codes"), F.collect_list("n").alias("ns"))


def all_sides(train: DataFrame, text: str, places: Places) -> DataFrame:
    """Rows (w, v, code, n): w and v null: how often classes follow each other; v null: how often a pair of classes stands
    on the sides of w, which is not known; neither null: how often v follows w, both not known. Added up within tasks."""
    shared = train.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        seen = shared.value
        size, total = seen.size, np.zeros(seen.size**2, np.int64)
        sides, pairs = Counter(), Counter()

        def out(rows):
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            for i in range(0, len(rows), 20000):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + 20000]), kinds)], names=["w", "v", "code", "n"])

        def flush():
            yield from out([(w, None, code, n) for (w, code), n in sides.items()] + [(w, v, None, n) for (w, v), n in pairs.items()])
            sides.clear()
            pairs.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                words = tokens(t)
                at, c = seen(words)
                total += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
                hit = np.flatnonzero(at < 0)
                own = [words[i] for i in hit.tolist()]
                sides.update(zip(own, (c[hit] * size + c[hit + 2]).tolist()))
                pairs.update((own[i], own[i + 1]) for i in np.flatnonzero(np.diff(hit) == 1).tolist())
                if len(sides) + len(pairs) > HELD:
                    yield from flush()
        yield from flush()
        used = np.flatnonzero(total)
        yield from out([(None, None, int(i), int(total[i])) for i in used])

    return train.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "w binary, v binary, code long, n long")


def gains(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a word gains by class (columns) for each occurrence after, and before, a class (rows): the logarithm by which the
    two classes follow each other more often than by chance, all counts with one added."""
    size = len(pairs)
    k = size - 2
    before, after = pairs.sum(1) + size, pairs.sum(0) + size
    near = np.log((pairs + 1) / np.outer(before, after))
    return near[:, :k], near[:k].T.copy()


def placed(sides: DataFrame, pairs: np.ndarray, kind: str) -> DataFrame:
    """w, n and c, the class of greatest gain, from (w, codes, ns); then, with w null, rows that add up by c, the code of two
    classes, to how often they follow each other by way of these words: occurrences beside an unseen word left out."""
    size = len(pairs)
    after, before = gains(pairs)

    def run(batches):
        for b in batches:
            total = np.zeros(size * size, np.int64)
            lens = np.asarray(b.column("codes").value_lengths(), dtype=np.int64)
            starts = np.r_[0, np.cumsum(lens)]
            codes, ns = (np.asarray(b.column(x).flatten(), dtype=np.int64) for x in ("codes", "ns"))
            out = np.zeros(len(lens), np.int64)
            first = 0
            while first < len(lens):
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + TOGETHER, "right")) - 1)
                part = slice(starts[first], starts[last])
                gain = (after[codes[part] // size] + before[codes[part] % size]) * ns[part, None]
                out[first:last] = np.add.reduceat(gain, starts[first:last] - starts[first]).argmax(1)
                first = last
            own = np.repeat(out, lens)
            left, right = codes // size, codes % size
            for code, ok in ((left * size + own, left != size - 2), (own * size + right, right != size - 2)):
                np.add.at(total, code[ok], ns[ok])
            used = np.flatnonzero(total)
            n = np.add.reduceat(ns, starts[:-1]) if len(lens) else ns
            blank = pa.nulls(len(used), b.column("w").type)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column("w"), blank]), pa.array(np.r_[n, total[used]]), pa.array(np.r_[out, used])], names=["w", "n", "c"])

    return sides.select("w", "codes", "ns").mapInArrow(run, f"w {kind}, n long, c long")


def matrix(rows: DataFrame, size: int) -> np.ndarray:
    """rows (code, n), added up, as a matrix of classes. size**2 rows at most reach the driver."""
    out, found = np.zeros(size * size), rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def fit(train: DataFrame, text: str = "text", settings: Settings = Settings()) -> ClassModel:
    spark = train.sparkSession
    prepare(spark)
    s = settings
    counts = staged(word_counts(train, text), "word_counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_docs = train.count()
    short = counts.where(F.length("w") <= s.longest).withColumn("level", F.expr(LEVEL))
    levels = {r.level: r.n for r in short.groupBy("level").agg(F.count("*").alias("n")).collect()}
    common = short.where(F.col("level") >= level_within(levels, s.known_words)).toArrow()
    # Words of the levels that hold the most frequent ones; which of equals are taken is by order.
    top = short.where(F.col("level") >= level_reaching(levels, s.top_words)).orderBy(F.desc("n"), "w").limit(s.top_words).toArrow()
    n_of = {bytes(w): n for t in (top, common) for w, n in zip(t.column("w").to_pylist(), t.column("n").to_pylist())}
    ids = {w: k for k, w in enumerate(n_of)}  # the most frequent ones first
    m = top.num_rows
    bigrams = bigram_counts(train, text, {w: k for w, k in ids.items() if k < m}, m + 2)
    of = exchange(bigrams, m, s.classes)
    size = int(of[-1]) + 1
    pairs = np.zeros((size, size))
    np.add.at(pairs, (of[:, None], of[None, :]), bigrams)
    kinds = np.r_[of[:m], np.full(len(ids) - m, size - 2)]
    if len(ids) > m:
        found = placed(known_sides(train, text, Places(ids, kinds, size), m), pairs, "long").where("w is not null").toArrow()
        kinds[found.column("w").to_numpy()] = found.column("c").to_numpy()

    seen = staged(all_sides(train, text, Places(ids, kinds, size)), "sides")
    pairs = matrix(seen.where("w is null"), size)
    # Dealt by word once, and added up by code before any list: a word has a bounded number of codes, whatever the number of its rows.
    others = seen.where("w is not null and v is null").repartition("w").groupBy("w", "code").agg(F.sum("n").alias("n")).groupBy("w").agg(F.collect_list("code").alias("codes"), F.collect_list("n").alias("ns"))
    others = staged(placed(others, pairs, "binary"), "placed")
    rest = others.where("w is not null")
    follow = seen.where("v is not null").select("w", "v", "n")
    follow = follow.join(rest.select("w", F.col("c").alias("a")), "w").join(rest.select(F.col("w").alias("v"), F.col("c").alias("b")), "v")
    # Pairs beside words that are not known, by their own classes now.
    pairs[size - 2] = pairs[:, size - 2] = 0
    pairs += matrix(others.where("w is null").select(F.col("c").alias("code"), "n").unionByName(follow.select((F.col("a") * size + F.col("b")).alias("code"), "n")), size)

    words = np.bincount(kinds, minlength=size).astype(float)
    for r in rest.groupBy("c").agg(F.count("*").alias("n")).collect():
        words[r.c] += r.n
    words[size - 2] = words[size - 1] = 1
    below = np.log10(pairs.sum(0) + words)
    step = np.log10((pairs + 1) / (pairs.sum(1, keepdims=True) + size))
    v = (total.v or 0) + (n_docs > 0)
    return ClassModel(ids, np.fromiter(n_of.values(), np.int64, len(n_of)), kinds, step, below, (total.n or 0) + n_docs, v, n_docs, rest)


def _fixed(values: np.ndarray) -> Column:
    """An array of doubles as one literal."""
    return F.split(F.lit(",".join(map(repr, values.ravel().tolist()))), ",").cast("array<double>")


def score(docs: DataFrame, model: ClassModel, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: the columns of keep, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    prepare(spark)
    keep = keep if keep is not None else {"doc_id": F.col("doc_id")}
    given = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(f"`{text}`").alias("t"))
    m, size = model, len(model.below)
    shared = spark.sparkContext.broadcast((Places(m.ids, m.kinds, size), np.log10(np.r_[m.counts, 0] + 1.0), m.step, m.below, float(np.log10(m.n + m.v + 1)), m.ends))

    def run(batches):
        places, logs, step, below, base, ends = shared.value
        for b in batches:
            rows = []
            for t in b.column("t").to_pylist():
                words = tokens(t)
                at, c = places(words)
                hit = np.flatnonzero(at < 0)
                known = logs[at].sum() + np.log10(ends + 1.0)
                sure = (c != size - 2).astype(float)
                # Words that are not known here add their emissions and the steps beside them after the join.
                value = known + (step[c[:-1], c[1:]] * sure[:-1] * sure[1:]).sum() - (below[c[1:]] * sure[1:]).sum()
                own = [words[i] for i in hit.tolist()]
                sides = Counter(zip(own, (c[hit] * size + c[hit + 2]).tolist()))
                pairs = Counter((own[i], own[i + 1]) for i in np.flatnonzero(np.diff(hit) == 1).tolist())
                other = [(w, None, code, n) for (w, code), n in sides.items()] + [(w, v, None, n) for (w, v), n in pairs.items()]
                rows.append((
                    len(words) + 1, len(words) - len(hit) + (ends > 0), float(known - (len(words) + 1) * base), float(value), *(zip(*other) if other else ((),) * 4),
                ))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            made = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "nt", "nk", "bs", "sc", "w", "v", "code", "n"])

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    first = given.mapInArrow(run, f"{head}nt long, nk long, bs double, sc double, w array<binary>, v array<binary>, code array<long>, n array<long>")
    first = staged(first.withColumn("r", F.monotonically_increasing_id()), "scores")
    other = first.select("r", F.explode(F.arrays_zip("w", "v", "code", "n")).alias("x")).select("r", "x.*")
    step, below, unseen = _fixed(m.step), _fixed(m.below), F.lit(m.unseen).cast("long")
    at = lambda a, b: F.get(step, (a * size + b).cast("int"))
    rest = m.rest.select("w", F.col("n").alias("had"), "c")
    alone = other.where("v is null").join(rest, "w", "left").withColumns({"c": F.coalesce("c", unseen), "left": F.expr(f"code div {size}"), "right": F.col("code") % size})
    gain = F.log10(F.coalesce("had", F.lit(0)) + 1.0)
    beside = F.when(F.col("left") != unseen, at(F.col("left"), F.col("c"))).otherwise(0.0) + F.when(F.col("right") != unseen, at(F.col("c"), F.col("right"))).otherwise(0.0)
    alone = alone.select("r", F.when(F.col("had").isNotNull(), F.col("n")).otherwise(0).alias("more"), (F.col("n") * gain).alias("add"), (F.col("n") * (gain - F.get(below, F.col("c").cast("int")) + beside)).alias("sum"))
    both = other.where("v is not null").join(rest.select("w", F.col("c").alias("a")), "w", "left").join(rest.select(F.col("w").alias("v"), F.col("c").alias("b")), "v", "left")
    both = both.select("r", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("add"), (F.col("n") * at(F.coalesce("a", unseen), F.coalesce("b", unseen))).alias("sum"))
    found = alone.unionByName(both).groupBy("r").agg(*[F.sum(c).alias(c) for c in ("more", "add", "sum")])
    done = first.drop("w", "v", "code", "n").join(found, "r", "left")
    return done.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("nt").alias("n_tokens"), (F.col("nk") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(m.n).cast("long").alias("train_tokens"), (F.col("bs") + F.coalesce("add", F.lit(0.0))).alias("base_score"), (F.col("sc") + F.coalesce("sum", F.lit(0.0))).alias("score"),
    )
