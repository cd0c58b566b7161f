"""Pairs of alike names by rare words: a set-similarity join whose keys are never frequent.

Words are put in order of frequency, rarest first. Two names that share a word of at most `most` rows have as their first
common word one of at most so many rows, and if their words are alike enough it stands among the first of both. So names
meet at such words only. What meets there is short: sizes, places, and a bitmap of all words that shows for most pairs that too
many of their words differ. The words themselves are compared for the pairs that are left, each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.staging import ROWS, importable, staged

#: Bits for a word in a bitmap of words, least and most bytes of one, and first rare words of a name, that others have too, which
#: tell whether two have met before.
BITS, LEAST, MOST, LEAD = 2, 32, 1024, 3
#: Pairs that are looked at together.
TOGETHER = 500_000


def frequencies(items: DataFrame) -> DataFrame:
    """word and n, the items that have it. items: id, words (each once)."""
    return items.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def hubs(items: DataFrame, most: int = 250) -> DataFrame:
    """Words of more than `most` items, which make no pairs."""
    return frequencies(items).where(F.col("n") > most)


def pairs(items: DataFrame, alike: float = 0.5, most: int = 250, since: int | None = None) -> DataFrame:
    """a, b and common, the number of words of both: items of different brands that share a word of at most `most` items and at
    least the share `alike` of all their words. items: id, brand, words (each once). since: pairs with an id beyond it alone."""
    importable(items.sparkSession)
    words = staged(frequencies(items).withColumn("at", F.monotonically_increasing_id()), "words")
    known, base = _numbered(words)
    # A word is one number: its count times `base`, and a number below that of its own. So numbers are in the order of words.
    ordered = items.select("id", "brand", F.explode("words").alias("word")).join(known, "word").groupBy("id", "brand").agg(F.array_sort(F.collect_list("number")).alias("w"))
    sets = staged(ordered.select(F.col("id").cast("long").alias("id"), F.col("brand").cast("string").alias("brand"), "w"), "word_sets")
    # Words are dealt to tasks, and a name goes to each task that has some of its words once, with its bitmap. There all rows of
    # a word lie together: what is held of them is bounded by `most`.
    rows = words.where(F.col("n").between(2, most)).agg(F.sum("n")).first()[0] or 0
    tasks = max(4 * items.sparkSession.sparkContext.defaultParallelism, rows // (4 * ROWS))
    keys = sets.mapInArrow(lambda batches: _keys(batches, alike, most, base, tasks), "task int, id long, brand string, size int, bitmap binary, lead binary, words array<long>, ats array<int>")
    keys = keys.repartitionById(tasks, F.col("task")).select(F.inline(F.arrays_zip("words", "ats")).alias("word", "at"), "id", "brand", "size", "bitmap", "lead")
    met = keys.select("word", "id", "brand", "size", "at", "bitmap", "lead").sortWithinPartitions("word").mapInArrow(lambda batches: _met(batches, alike), "a long, b long")
    if since is not None:
        met = met.where((F.col("a") > since) | (F.col("b") > since))
    own = F.transform("w", lambda x: (x % base).cast("int")) if base < 1 << 31 else F.transform("w", lambda x: x % base)
    of = lambda x: sets.select(F.col("id").alias(x), own.alias(f"w{x}"))
    both, common = F.size("wa") + F.size("wb"), F.size(F.array_intersect("wa", "wb"))
    compared = staged(met.distinct(), "met").join(of("b"), "b").join(of("a"), "a").select("a", "b", common.alias("common"), both.alias("both"))
    return compared.where(F.col("common") >= alike * (F.col("both") - F.col("common")) - 1e-9).select("a", "b", "common")


def _numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """word and number, its count n times the base that is returned, and a number below it. words: word, n, at (numbers with
    the partition's in the upper bits); a number for each partition reaches the driver."""
    own, of = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("at", 33)
    sizes = {r.p: r.size for r in words.groupBy(of.alias("p")).agg((F.max(own) + 1).alias("size")).collect()}
    starts, base = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(base)
        base += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), of.cast("int") + 1)
    return words.select("word", (F.col("n") * F.lit(max(1, base)).cast("long") + start + own).alias("number")), max(1, base)


def _keys(batches: Iterator[pa.RecordBatch], alike: float, most: int, base: int, tasks: int) -> Iterator[pa.RecordBatch]:
    """The rare words among the first of a name, with their places, in a row for each task to which some are dealt; the name's
    size, a bitmap of all its words, and the first of these words."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], [], []]
        for id_, brand, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            numbers = w.values.to_numpy()
            n, w = numbers // base, numbers % base
            size = len(w)
            first = size - int(np.ceil(size * alike - 1e-9)) + 1
            places = np.flatnonzero((n[:first] >= 2) & (n[:first] <= most))
            if not len(places):
                continue
            mixed = (w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            bits = np.zeros(8 * min(MOST, max(LEAST, 1 << (size * BITS // 8).bit_length())), np.uint8)
            bits[mixed % np.uint64(len(bits))] = 1
            bitmap, lead = np.packbits(bits).tobytes(), w[places[:LEAD]].tobytes()
            to = (w[places] % tasks).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            for part in np.split(order, cuts):
                for c, x in zip(out, (int(to[part[0]]), id_, brand, size, bitmap, lead, w[places[part]], places[part].astype(np.int32))):
                    c.append(x)
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["task", "id", "brand", "size", "bitmap", "lead", "words", "ats"])


def _met(batches: Iterator[pa.RecordBatch], alike: float) -> Iterator[pa.RecordBatch]:
    """a, b: pairs of names of one word that may be alike, but those that have met at one of their first words. Rows lie in
    order of their words."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[-1].as_py()
        cut = int(np.searchsorted(batch.column(0).to_numpy(), last))
        if cut or (held and held[0].column(0)[0].as_py() != last):
            yield from _pairs_of(pa.Table.from_batches([*held, batch.slice(0, cut)]), alike)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _pairs_of(pa.Table.from_batches(held), alike)


def _pairs_of(rows: pa.Table, alike: float) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    word, id_, size, at = (rows.column(c).to_numpy() for c in ("word", "id", "size", "at"))
    # A null brand is unlike every other, and like another null.
    brand = rows.column("brand").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    bitmap = rows.column("bitmap").to_pylist()
    wide = np.array([len(x) for x in bitmap], np.int64)
    # By width: the bitmaps of it, and wider ones with their halves laid over each other, and where each row's is.
    widths = np.unique(wide).tolist()
    own = {w: np.frombuffer(b"".join(bitmap[k] for k in np.flatnonzero(wide == w)), np.uint64).reshape(-1, 1, w // 8) for w in widths}
    folded = {}
    for width in widths:
        place, parts = np.zeros(len(wide), np.int64), []
        for w in widths[widths.index(width) :]:
            place[wide == w] = sum(map(len, parts)) + np.arange(len(own[w]))
            parts.append(np.bitwise_or.reduce(own[w].reshape(-1, w // width, width // 8), axis=1))
        folded[width] = np.concatenate(parts), place
    leads = rows.column("lead").to_pylist()
    # Where there is no word, -1, which is like nothing.
    lead = np.full((len(leads), LEAD), -1, np.int64)
    for k, x in enumerate(leads):
        if x:
            lead[k, : len(x) // 8] = np.frombuffer(x, np.int64)
    lead[np.maximum.accumulate(lead == word[:, None], axis=1)] = -1  # only those before this word
    # Each row meets those after it of its word.
    after = np.searchsorted(word, word, side="right") - np.arange(len(word)) - 1
    total, start = np.cumsum(after), 0
    while start < len(word):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + TOGETHER, side="right")))
        n = after[start:stop]
        x = np.repeat(np.arange(start, stop), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        start = stop
        ok = (brand[x] != brand[y]) & (id_[x] != id_[y])
        x, y = x[ok], y[ok]
        least = (alike * (size[x] + size[y]) - 1e-9) / (1 + alike)
        ok = (np.minimum(size[x], size[y]) >= np.maximum(size[x], size[y]) * alike - 1e-9) & (np.minimum(size[x] - at[x], size[y] - at[y]) >= least - 1e-9)
        x, y, least = x[ok], y[ok], least[ok]
        # A bit that one has alone is a word that one has alone.
        narrow, ok = np.minimum(wide[x], wide[y]), np.zeros(len(x), bool)
        for width, (bits, place) in folded.items():
            k = np.flatnonzero(narrow == width)
            ok[k] = np.bitwise_count(bits[place[x[k]]] ^ bits[place[y[k]]]).sum(1, dtype=np.int64) <= size[x[k]] + size[y[k]] - 2 * least[k] + 1e-6
        x, y = x[ok], y[ok]
        before = np.zeros(len(x), bool)
        for i in range(LEAD):
            mine = lead[x, i]
            before |= (mine[:, None] == lead[y]).any(1) & (mine >= 0)
        x, y = x[~before], y[~before]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(id_[x], id_[y])), pa.array(np.maximum(id_[x], id_[y]))], names=["a", "b"])


def best(pairs: DataFrame, top: int = 3) -> DataFrame:
    """The `top` pairs of each a with the most words in common; of equals the least b."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("common"), "b"))
    return pairs.withColumn("place", place).where(F.col("place") <= top).drop("place")
