"""Language identification: multinomial naive Bayes over hashed character n-grams.

Spark counts hashed n-grams by language over all training texts; the matrix of log probabilities
(languages x buckets, bounded by max_languages and bits) is broadcast, and texts are scored in
batches by sparse sums over the matrix's rows.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if
no training row has a language. Training skips null languages and null texts; of more than max_languages
names the most frequent ones are learned (of equals those that sort first), as a column with so many is dirty.
Ties go to the language that sorts first. Repeated rows count as often as they occur. Texts of any length are
read whole, in memory in proportion to the longest. Columns to keep may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.base import prepare

UNKNOWN = "und"
#: Odd multipliers, one for each place in an n-gram.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def buckets(text: str, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    """The hashed n-grams of a whole text, lower-cased, with a space at either end."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for n in sizes:
        if len(cp) >= n:
            h = np.full(len(cp) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ cp[k : k + len(h)]) * np.uint32(MULTIPLIERS[k])
                h ^= h >> np.uint32(15)
            found.append(h >> np.uint32(32 - bits))
    return np.concatenate(found)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class LanguageModel:
    """languages: sorted names; logp: float32 [buckets, languages]; prior: [languages]."""

    def __init__(self, languages: list[str], logp: np.ndarray, prior: np.ndarray, bits: int, sizes: tuple[int, ...]):
        self.languages, self.logp, self.prior, self.bits, self.sizes = languages, logp, prior, bits, sizes

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        counts = np.bincount(buckets(text, self.bits, self.sizes), minlength=1 << self.bits)
        used = np.flatnonzero(counts)
        score = counts[used].astype(np.float64) @ self.logp[used] + self.prior
        best = int(score.argmax())
        return self.languages[best], float(1 / np.exp(score - score[best]).sum())


#: Languages whose counts a task holds at a time.
HELD = 64


def fit(train: DataFrame, text: str = "text", lang: str = "lang", bits: int = 15, sizes: tuple[int, ...] = (1, 2, 3), alpha: float = 0.5, max_languages: int = 512) -> LanguageModel:
    """Count over all rows of train. What reaches the driver is bounded by max_languages * 2**bits counts."""
    prepare(train.sparkSession)
    names = train.groupBy(F.col(f"`{lang}`").cast("string").alias("l")).count().where("l is not null").orderBy(F.desc("count"), "l").limit(max_languages + 1).collect()
    if len(names) > max_languages:
        train = train.where(F.col(f"`{lang}`").cast("string").isin([r.l for r in names[:max_languages]]))
    rows = train.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{text}`").alias("t"))

    def count(batches):
        held: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def out():
            for name, own in held.items():
                used = np.flatnonzero(own)
                yield pa.RecordBatch.from_pydict({"l": [name] * (len(used) + 1), "b": np.r_[used, -1].astype(np.int32), "n": np.r_[own[used], docs[name]]})
            held.clear()
            docs.clear()

        for b in batches:
            for name, t in zip(b.column("l").to_pylist(), b.column("t").to_pylist()):
                own = held.setdefault(name, np.zeros(1 << bits, np.int64))
                own += np.bincount(buckets(t, bits, sizes), minlength=1 << bits)
                docs[name] = docs.get(name, 0) + 1
                if len(held) > HELD:
                    yield from out()
        yield from out()

    sums = rows.mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("l", (F.col("b") / 4096).cast("int").alias("part")).agg(F.collect_list("b").alias("b"), F.collect_list("n").alias("n"))
    parts = packed.collect()
    languages = sorted({r.l for r in parts})
    counts, docs = np.zeros((1 << bits, len(languages))), np.zeros(len(languages))
    for r in parts:
        b, n, k = np.array(r.b), np.array(r.n), languages.index(r.l)
        counts[b[b >= 0], k] = n[b >= 0]
        docs[k] += n[b < 0].sum()
    logp = np.log(counts + alpha) - np.log(counts.sum(0) + alpha * (1 << bits))
    return LanguageModel(languages, logp.astype(np.float32), np.log(docs / docs.sum()) if len(docs) else docs, bits, sizes)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: the columns of keep (name to expression), lang_pred and score."""
    spark = docs.sparkSession
    prepare(spark)
    keep = keep if keep is not None else {"doc_id": F.col("doc_id")}
    given = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], F.col(f"`{text}`").alias("t"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            out = [m.predict(t) for t in b.column("t").to_pylist()]
            made = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "lang_pred", "score"])

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    out = given.mapInArrow(run, f"{head}lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
