"""Fill-in-the-middle transformation by a parallel automaton scan.

Texts are cut at boundaries of units: runs of ASCII letters, and every other character. Where units
begin depends on what stands before, so a piece of a text can't be scanned alone from one state. Each
piece is scanned from every state of the automaton instead: it gives a state-transition function and,
for each start state, how many units begin and how many markers end in it. Functions compose
associatively, which resolves the state in which each piece is entered and the units before it;
then the pieces that hold a wanted cut are found and only they are looked into.

The same is done at two sizes: blocks of 64 characters within a piece, all blocks of a batch at once,
and pieces of a giant text, which are dealt to all tasks.

Defined results: a null text counts as empty; an empty one, and one that contains a marker, stays as it
is (plain). A null id counts as the empty string in the draws. Repeated rows are changed alike, and each
gives a row. Texts of any length are done; what one task holds of a giant text is a piece, until the
output is written as one value. Columns to keep are taken before names are given, so their names may be
any. There are no ties: draws fix each cut, and two equal cuts leave an empty middle. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.base import prepare, staged

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters of a piece, and of a block. Texts of more than a piece are dealt to several tasks.
PIECE, BLOCK = 1 << 15, 64

#: States: after a character that is neither a letter nor "<"; after "<"; after "<" and one of P, S, M; within letters otherwise.
OUTSIDE, OPENED, NAMED, LETTERS = range(4)
STATES = 4
#: Classes of characters; NONE pads blocks and changes nothing.
OPEN, NAME, LETTER, CLOSE, OTHER, NONE = range(6)
CLASSES = 6


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and count, by state * CLASSES + class. A count holds units begun in its low byte, markers ended in its high one."""
    after, count = np.zeros(STATES * CLASSES, np.uint8), np.zeros(STATES * CLASSES, np.uint16)
    for s in range(STATES):
        in_word = s in (NAMED, LETTERS)
        for c, (to, units, marks) in {
            OPEN: (OPENED, 1, 0), NAME: (NAMED if s == OPENED else LETTERS, 0 if in_word else 1, 0), LETTER: (LETTERS, 0 if in_word else 1, 0),
            CLOSE: (OUTSIDE, 1, 1 if s == NAMED else 0), OTHER: (OUTSIDE, 1, 0), NONE: (s, 0, 0),
        }.items():
            after[s * CLASSES + c], count[s * CLASSES + c] = to, units | marks << 8
    return after, count


AFTER, COUNT = _automaton()


def _classes() -> np.ndarray:
    kind = np.full(128, OTHER, np.uint8)
    for c in range(128):
        if chr(c).isalpha():
            kind[c] = NAME if chr(c) in "PSM" else LETTER
    kind[ord("<")], kind[ord(">")] = OPEN, CLOSE
    return kind


KINDS = _classes()


class Scan:
    """Texts, all scanned at once, from every state."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        blocks = -(-sizes // BLOCK)
        self.ends = np.cumsum(blocks)
        self.heads = self.ends - blocks
        padded = np.full(int(blocks.sum()) * BLOCK, NONE, np.uint8)
        shift = self.heads * BLOCK - (np.cumsum(sizes) - sizes)
        padded[np.arange(len(codes)) + np.repeat(shift, sizes)] = KINDS[np.minimum(codes, 127)]
        self.kinds = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
        state = np.tile(np.arange(STATES, dtype=np.uint8), (self.kinds.shape[1], 1))
        count = np.zeros(state.shape, np.uint16)
        for kinds in self.kinds:
            at = state * np.uint8(CLASSES) + kinds[:, None]
            count += COUNT[at]
            state = AFTER[at]
        self._compose(state, (count & 255).astype(np.int64), (count >> 8).astype(np.int64), np.arange(len(state)) - np.repeat(self.heads, blocks))

    def _compose(self, state, units, marks, place) -> None:
        """From each block's function to that of all blocks of its text up to it, by doubling."""
        step = 1
        while (later := np.flatnonzero(place >= step)).size:
            before = later - step
            middle = state[before].astype(np.int64)
            state_, units_, marks_ = (np.take_along_axis(x[later], middle, 1) for x in (state, units, marks))
            state, units, marks = state.copy(), units.copy(), marks.copy()
            state[later], units[later], marks[later] = state_, units_ + units[before], marks_ + marks[before]
            step *= 2
        self.state, self.units, self.marks = state, units, marks

    def functions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text, by start state: the end state, the units that begin and the markers that end."""
        full = self.ends > self.heads
        out = [np.tile(np.arange(STATES), (len(full), 1)), *np.zeros((2, len(full), STATES), np.int64)]
        for x, made in zip(out, (self.state, self.units, self.marks)):
            x[full] = made[self.ends[full] - 1]
        return tuple(out)

    def begins(self, text: np.ndarray, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Where, in characters, unit number `unit` (from 0) of each text begins, if the text is entered in state entry."""
        at = np.empty(len(text), np.int64)
        for k, (t, s, u) in enumerate(zip(text.tolist(), entry.tolist(), unit.tolist())):
            at[k] = self.heads[t] + np.searchsorted(self.units[self.heads[t] : self.ends[t], s], u, "right")
        first = at == self.heads[text]
        state = np.where(first, entry, self.state[at - 1, entry]).astype(np.uint8)
        left = unit - np.where(first, 0, self.units[at - 1, entry])
        place = np.full(len(text), -1, np.int64)
        for j in range(BLOCK):
            move = state * np.uint8(CLASSES) + self.kinds[j, at]
            begun = (COUNT[move] & 255) > 0
            place[begun & (left == 0) & (place < 0)] = j
            left = left - begun
            state = AFTER[move]
        return (at - self.heads[text]) * BLOCK + place


def draws(doc_id, units: int, plain_of_100: int, spm_of_100: int) -> tuple[int, int, bool, bool]:
    """The units before the middle and before the end of it, whether the text stays plain, and whether its suffix comes first."""
    h = np.frombuffer(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()[:16], ">u4").tolist()
    a, b = sorted((h[0] % (units + 1), h[1] % (units + 1)))
    return a, b, h[2] % 100 >= 100 - plain_of_100, h[3] % 100 < spm_of_100


def written(text: str, form: str, a: int, b: int) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def _decided(ids, units, marks, plain: int, spm: int):
    """form, and the units before and up to the end of the middle."""
    for i, n, m in zip(ids, units, marks):
        a, b, stays, turned = draws(i, n, plain, spm)
        yield ("plain" if not n or m or stays else "spm" if turned else "psm"), a, b


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), plain_of_100: int = 10, spm_of_100: int = 20) -> DataFrame:
    """One row per input row: the columns of keep, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    prepare(docs.sparkSession)
    kept = [f"k{j}" for j in range(len(keep))]
    given = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], F.col(f"`{doc_id}`").alias("i"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields[: len(keep)])
    schema = f"{head}n long, form string, prefix_chars long, middle_chars long, output string"

    def batch(b, n, form, a, z):
        """a, z: where the middle begins and ends, in characters."""
        plain = np.array([f == "plain" for f in form], bool)
        made = [written(*x) for x in zip(b.column("t").to_pylist(), form, a.tolist(), z.tolist())]
        cols = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64(), mask=plain), pa.array(z - a, pa.int64(), mask=plain), pa.array(made, pa.string())]
        return pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], *cols], names=[*kept, "n", "form", "prefix_chars", "middle_chars", "output"])

    def whole(batches):
        for b in batches:
            texts = b.column("t").to_pylist()
            scan = Scan(texts)
            _, units, marks = (x[:, OUTSIDE] for x in scan.functions())
            form, first, last = map(list, zip(*_decided(b.column("i").to_pylist(), units.tolist(), marks.tolist(), plain_of_100, spm_of_100))) if texts else ([], [], [])
            places = []
            for wanted in (np.array(first, np.int64), np.array(last, np.int64)):
                place, at = np.array([len(t) for t in texts], np.int64), np.flatnonzero(wanted < units)
                if len(at):
                    place[at] = scan.begins(at, np.full(len(at), OUTSIDE), wanted[at])
                places.append(place)
            yield batch(b, units, form, *places)

    small = given.where(F.length("t") <= PIECE).mapInArrow(whole, schema)
    giant = staged(given.where(F.length("t") > PIECE).withColumn("r", F.monotonically_increasing_id()), "giant_texts")
    out = small if giant.isEmpty() else small.unionByName(_giants(giant, batch, schema, plain_of_100, spm_of_100))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], "n", "form", "prefix_chars", "middle_chars", "output")


def _giants(giant: DataFrame, batch, schema: str, plain: int, spm: int) -> DataFrame:
    """The rows of texts of more than a piece, whose pieces are dealt to all tasks. giant: as transform() has it, and r."""

    def cut(batches):
        for b in batches:
            for r, t in zip(b.column("r").to_pylist(), b.column("t").to_pylist()):
                n = -(-len(t) // PIECE)
                for k in range(0, n, 64):
                    c = range(k, min(n, k + 64))
                    yield pa.RecordBatch.from_pydict({"r": [r] * len(c), "c": list(c), "piece": [t[j * PIECE : (j + 1) * PIECE] for j in c]})

    pieces = staged(giant.select("r", "t").mapInArrow(cut, "r long, c long, piece string").repartition("r", "c"), "pieces")

    def emitted(batches):
        for b in batches:
            made = Scan(b.column("piece").to_pylist()).functions()
            yield pa.RecordBatch.from_pydict({"r": b.column("r"), "c": b.column("c"), **{c: pa.array(x.astype(np.int64).tolist(), pa.list_(pa.int64())) for c, x in zip(("state", "units", "marks"), made)}})

    functions = pieces.mapInArrow(emitted, "r long, c long, state array<long>, units array<long>, marks array<long>")

    def composed(batches):
        """Each piece's entry state and the units and markers up to its end, in the order of pieces."""
        r, state, units, marks = None, OUTSIDE, 0, 0
        for b in batches:
            rows = []
            for own, c, f, n, m in zip(*[b.column(x).to_pylist() for x in ("r", "c", "state", "units", "marks")]):
                if own != r:
                    r, state, units, marks = own, OUTSIDE, 0, 0
                rows.append((r, c, state, units, units + n[state], marks + m[state]))
                units, marks, state = units + n[state], marks + m[state], f[state]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("r", "c", "entry", "before", "up_to", "marks"), map(list, zip(*rows)))))

    resolved = functions.repartition("r").sortWithinPartitions("r", "c").mapInArrow(composed, "r long, c long, entry long, before long, up_to long, marks long")
    resolved = staged(resolved, "resolved")
    totals = giant.select("r", "i", F.length("t").alias("chars")).join(resolved.groupBy("r").agg(F.max("up_to").alias("n"), F.max("marks").alias("marks")), "r")

    def decide(batches):
        for b in batches:
            made = list(_decided(*[b.column(c).to_pylist() for c in ("i", "n", "marks")], plain, spm))
            form, a, z = map(list, zip(*made)) if made else ([], [], [])
            yield pa.RecordBatch.from_pydict({"r": b.column("r"), "n": b.column("n"), "chars": b.column("chars"), "form": pa.array(form, pa.string()), "a": pa.array(a, pa.int64()), "z": pa.array(z, pa.int64())})

    decided = staged(totals.mapInArrow(decide, "r long, n long, chars int, form string, a long, z long"), "decided")
    wanted = decided.select("r", F.posexplode(F.array("a", "z")).alias("which", "unit"))
    hit = wanted.join(resolved, "r").where("unit >= before and unit < up_to").select("r", "c", "which", "entry", (F.col("unit") - F.col("before")).alias("unit"))

    def found(batches):
        for b in batches:
            scan = Scan(b.column("piece").to_pylist())
            place = scan.begins(np.arange(b.num_rows), *[b.column(c).to_numpy() for c in ("entry", "unit")]) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({"r": b.column("r"), "which": b.column("which"), "place": place + PIECE * b.column("c").to_numpy()})

    places = pieces.join(hit, ["r", "c"]).select("r", "c", "piece", "which", "entry", "unit").mapInArrow(found, "r long, which int, place long")
    places = places.groupBy("r").agg(F.max(F.when(F.col("which") == 0, F.col("place"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("place"))).alias("z"))
    # A cut after the last unit is the text's end.
    cuts = decided.select("r", "n", "form", "chars").join(places, "r", "left").select("r", "n", "form", F.coalesce("a", "chars").alias("a"), F.coalesce("z", "chars").alias("z"))

    def write(batches):
        for b in batches:
            yield batch(b, b.column("n").to_pylist(), b.column("form").to_pylist(), *[b.column(c).to_numpy() for c in ("a", "z")])

    return giant.join(cuts, "r").mapInArrow(write, schema)
