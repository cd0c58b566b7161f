"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in its features. Preference pairs (a document labelled good over one
labelled bad) are fitted by logistic loss on their feature differences; the cut is the quantile of
the scores of the fitting sample below which its share of bad labels lies.

Defined results: a null text counts as empty; empty texts get the score of their (zero) features.
Null labels are skipped. Where a label is missing altogether there are no pairs, and every score is
0.5. Repeated rows give repeated results; an empty table gives no rows. Labels that appear more
than once for an id are averaged, 0.5 or more being good.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.base import SPACES, prepare

GRAMS = 256
PLAIN = 20
FEATURES = PLAIN + GRAMS
#: Byte classes that features count.
CLASSES = [bytes(range(65, 91)), b"0123456789", b".,;:!?", b"#*$%&|<>", b"!", b"|", b"\"'()[]{}", b"=_@/\\"]


def features(text: str | None) -> np.ndarray:
    """Shares of character classes, word and line shapes, repetition, and hashed byte bigrams."""
    out = np.zeros(FEATURES)
    buf = (text or "").encode("utf-8", "surrogatepass")
    words = buf.split()
    if not words:
        return out
    n, raw = len(buf), np.frombuffer(buf, np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in buf.split(b"\n") if x and not x.isspace()]
    counts = Counter(words)
    out[: len(CLASSES)] = [(n - len(buf.translate(None, c))) / n for c in CLASSES]
    out[len(CLASSES) : PLAIN] = [
        np.log1p(len(words)) / 10, sizes.mean() / 20, sizes.std() / 20, len(counts) / len(words), counts.most_common(1)[0][1] / len(words),
        1 - len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)) / 5, (raw > 127).mean(),
        1 - len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2), np.mean([w[-1:].isalnum() for w in words]),
        (n - len(buf.translate(None, SPACES))) / n, 1.0,
    ]
    if n > 1:
        low = np.frombuffer(buf.lower(), np.uint8).astype(np.uint32)
        h = ((low[:-1] << np.uint32(8) | low[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(24)
        out[PLAIN:] = np.sqrt(np.bincount(h, minlength=GRAMS) / (n - 1))
    return out


class Ranker:
    """score(x) = 1 / (1 + exp(-(x.w - cut) / scale)); 0.5 is the quantile cut."""

    def __init__(self, weights: np.ndarray, cut: float, scale: float):
        self.weights, self.cut, self.scale = weights, cut, scale

    def score(self, text: str | None) -> float:
        if not self.weights.any():
            return 0.5
        z = (features(text) @ self.weights - self.cut) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = 20000, l2: float = 1e-3, rounds: int = 20, seed: int = 7) -> Ranker:
    """Logistic loss on feature differences of (good, bad) pairs, by Newton's method."""
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Ranker(np.zeros(x.shape[1]), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    spread = x.std(0)
    spread[spread < 1e-9] = np.inf
    z = x / spread
    d = z[rng.choice(up, pairs)] - z[rng.choice(down, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # chance that the pair is the wrong way round
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(d.shape[1])
        step = np.linalg.solve(curve, d.T @ p / pairs - l2 * w)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    w = w / spread
    s = x @ w
    share = (~good).mean()
    lo, hi = np.quantile(s, [max(0, share - 0.005), min(1, share + 0.005)])
    return Ranker(w, float((lo + hi) / 2), float(max(s.std(), 1e-9)))


def fit(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 12000) -> Ranker:
    """Fit on at most max_labelled labelled rows, the first in the order of a hash of the id. train: a
    condition on labels. Only the sample's ids meet the documents, and only features reach the driver."""
    spark = docs.sparkSession
    prepare(spark)
    marks = labels.where(train & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg((F.avg(label) >= 0.5).alias("good"))
    sample = marks.orderBy(F.xxhash64("i"), "i").limit(max_labelled)
    texts = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t")).join(F.broadcast(sample), "i").select("i", "good", "t")

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column("t").to_pylist()], np.float32).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("good"), pa.array([r.tobytes() for r in x], pa.binary())], names=["i", "good", "x"])

    # One row for each id, however often it occurs among the documents; of different texts the one with the least features.
    one = texts.mapInArrow(run, f"i {texts.schema['i'].dataType.simpleString()}, good boolean, x binary").groupBy("i").agg(F.first("good").alias("good"), F.min("x").alias("x"))
    rows = one.select("good", "x").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
    good = np.array(rows.column("good").to_pylist(), bool)
    by = np.lexsort((*x.T[::-1], good)) if len(good) else []  # rows come in any order
    return fit_pairs(x[by], good[by])


def score(docs: DataFrame, model: Ranker, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: the columns of keep, score and predicted (1 from the cut upwards)."""
    spark = docs.sparkSession
    prepare(spark)
    keep = keep if keep is not None else {"doc_id": F.col("doc_id")}
    given = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(f"`{text}`").alias("t"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            s = pa.array([m.score(t) for t in b.column("t").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], s], names=[*b.schema.names[:-1], "score"])

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    out = given.mapInArrow(run, f"{head}score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
