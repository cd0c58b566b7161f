"""Quality rules with suffix-array repetition.

Base counts of a text, and a verdict on its repetition: over the suffix array of the text's UTF-8
bytes, longest-common-prefix intervals give the maximal repeated substrings; the union of their
spans and the longest of them are limited as fractions of the text.

Defined results: a null text counts as the empty text (no words, so base_failed); repeated rows give
repeated results; an empty table gives no rows; other columns of any name pass by unread.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm import suffix
from partloom.llm.base import SPACES, prepare

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
GRAM = 32

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_bytes long, covered_bytes long, longest_repeat long, n_repeats long"
)


@dataclass(frozen=True)
class Limits:
    """min_repeat: bytes from which a repeated substring counts. The fractions are of the text's bytes."""

    min_words: int = 50
    max_repeat_words_pct: int = 50
    min_repeat: int = GRAM
    max_covered: float = 0.50
    max_longest: float = 0.35

    def __post_init__(self):
        if self.min_repeat < GRAM:
            raise ValueError(f"min_repeat must be at least {GRAM}")


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def may_repeat(buf: bytes) -> bool:
    """Whether any GRAM bytes may occur twice: their hashes do. False is certain."""
    n = len(buf) - GRAM + 1
    if n < 2:
        return False
    x = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    h = np.uint64(0)
    for k, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
        h = h + x[8 * k : 8 * k + n] * np.uint64(c)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    bits = min(28, max(8, (8 * n).bit_length()))
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    twice = np.bincount(slot, minlength=1 << bits)[slot] > 1
    some = np.sort(h[twice])
    return bool((some[1:] == some[:-1]).any())


def repetition(buf: bytes, least: int) -> tuple[int, int, int]:
    """Bytes covered by repeated substrings of at least so many bytes, the longest of these, and the
    number of places where a maximal one begins."""
    if not may_repeat(buf):
        return 0, 0, 0
    sa = suffix.of_bytes(buf)
    back = suffix.plcp(buf, sa)
    ahead = np.zeros_like(back)
    ahead[sa[:-1]] = back[sa[1:]]
    longest = np.maximum(back, ahead)
    at = np.flatnonzero(longest >= least)
    if not len(at):
        return 0, 0, 0
    # A span that begins one byte after another and ends with it lies inside a longer repeat.
    starts = at[(at == 0) | (longest[at - 1] != longest[at] + 1)]
    ends = np.maximum.accumulate(starts + longest[starts])
    covered = ends - np.maximum(starts, np.r_[0, ends[:-1]])
    return int(np.maximum(covered, 0).sum()), int(longest[at].max()), len(starts)


def judge(text: str | None, limits: Limits) -> tuple:
    text = text or ""
    buf = text.encode("utf-8", "surrogatepass")
    words = buf.split()
    blanks = len(buf) - len(buf.translate(None, SPACES))
    symbols = len(buf) - len(buf.translate(None, SYMBOLS))
    lines = [x for x in buf.split(b"\n") if x and not x.isspace()] if b"\n" in buf else []
    repeated = repeat_words(words)
    failed = len(words) < limits.min_words or 100 * repeated > limits.max_repeat_words_pct * len(words)
    covered, longest, n = repetition(buf, limits.min_repeat)
    fine = covered <= limits.max_covered * len(buf) and longest <= limits.max_longest * len(buf)
    return (
        len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated, failed,
        not failed and fine, len(buf), covered, longest, n,
    )


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _judged(docs: DataFrame, text: str, keep: tuple[str, ...], limits: Limits) -> DataFrame:
    """k0, k1, ..., the columns of keep, and those of SCHEMA."""
    prepare(docs.sparkSession)
    given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches):
        for b in batches:
            rows = [judge(t, limits) for t in b.column("t").to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(NAMES)
            made = [pa.array(c, pa.bool_() if m in ("base_failed", "kept") else pa.int64()) for m, c in zip(NAMES, cols)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], *NAMES])

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{head}{SCHEMA}")


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limits: Limits = Limits()) -> DataFrame:
    """One row per input row: the columns named in keep, the base counts and the verdict. No shuffle:
    each text is judged where it is read."""
    return _judged(docs, text, keep, limits).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *NAMES)


def filter_rules(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows whose text the rules keep, with all their columns."""
    return _judged(docs, text, tuple(docs.columns), limits).where("kept").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
