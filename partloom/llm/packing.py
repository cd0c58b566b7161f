"""Packing along a space-filling curve.

Each text's token ids give a hashed vector, projected to a few dimensions; documents are
range-sorted by the Hilbert key of that point, and neighbours along the curve are packed into
sequences with no gap. Each range holds its own sequences: full ones, and at its end what is left,
cut into powers of two, so that nothing is padded.

Defined results: a null text counts as empty (its one token is the end id); repeated rows are
packed as often as they occur, told apart by a row number; equal vectors fall back to the order of
ids, so a group of copies is dealt to as many ranges as its size needs. Null ids take part. Texts of any length
are encoded whole, in memory in proportion to the longest. Columns to keep may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.base import prepare, staged

HASHED, DIMENSIONS, BITS = 256, 4, 15
#: Token ids of one range, and the most ranges (ranges grow beyond that).
RANGE_TOKENS, MAX_RANGES = 2_000_000, 20_000
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves,
    the others, in order, for the letters from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a tokenizers file, without special tokens added. A byte-level BPE file whose ids
    follow its merges is run by tiktoken, which gives the same ids several times faster; any other
    by tokenizers itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.size = max([*model.get("vocab", {"": 0}).values(), *(a["id"] for a in spec.get("added_tokens", []))]) + 1 if isinstance(model.get("vocab"), dict) else 1 << 31
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.fast = self.slow = None
        if model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer"):
            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in self.special}
            merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
            made = [model["vocab"]["".join(x)] for x in merges]
            if made == list(range(256, 256 + len(made))) and sorted(ranks.values())[:256] == list(range(256)):
                import public_tokenizers
                import tiktoken

                self.words = {i: word for word, i in model["vocab"].items() if word not in self.special}
                self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        if self.fast is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)

    def __call__(self, text: str) -> list[int]:
        if self.slow:
            return self.slow.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of rows of points, whose coordinates have so many bits (at most 63 in all)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(counts: np.ndarray, bits: int = BITS, dims: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    """Rows of hashed token counts to keys: square roots, unit length, fixed random projection, grid."""
    v = np.sqrt(counts)
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    at = v @ np.random.default_rng(seed).normal(size=(counts.shape[1], dims))
    grid = np.clip((at + 4) / 8 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
    return hilbert(grid, bits)


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), end_id: int = 0) -> DataFrame:
    """k0, k1, ..., the columns of keep; key, the curve key; n, the number of ids with the end; ids, little-endian."""
    given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))

    def run(batches):
        enc = encoder(vocabulary)
        kind = "<u2" if enc.size <= 1 << 16 else "<u4"
        for b in batches:
            rows = [np.array([*enc(t or ""), end_id], kind) for t in b.column("t").to_pylist()]
            counts = np.zeros((len(rows), HASHED))
            for k, r in enumerate(rows):
                counts[k] = np.bincount((r[:-1].astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=HASHED)
            made = [pa.array(curve_keys(counts)), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "key", "n", "ids"])

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{head}key long, n long, ids binary").withColumn("r", F.monotonically_increasing_id())


def pack(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: the columns of keep, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    prepare(docs.sparkSession)
    ids = staged(encoded(docs, vocabulary, text, keep, end_id), "token_ids")
    total = ids.agg(F.sum("n")).first()[0] or 0
    ranges = min(MAX_RANGES, max(1, math.ceil(total / RANGE_TOKENS)))
    placed = ids.repartitionByRange(ranges, "key", *[f"k{i}" for i in range(len(keep))], "r").sortWithinPartitions("key", *[f"k{i}" for i in range(len(keep))], "r")
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"]
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        sequence = TaskContext.get().partitionId() << 32
        open_, filled = [], 0  # the pieces of the sequence that is not full yet

        def rows(pieces, number):
            out, at = [], 0
            for own, start, part, n, key in pieces:
                out.append((*own, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), n, number, at, key))
                at += len(part)
            return out

        def batch(found, schema):
            cols = list(zip(*found)) or [()] * (len(kept) + len(names))
            arrays = [pa.array(c, t) for c, t in zip(cols, [schema.field(k).type for k in kept] + [pa.int64()] * len(names))]
            return pa.RecordBatch.from_arrays(arrays, names=[*kept, *names])

        schema = None
        for b in batches:
            schema, found = b.schema, []
            for own, key, n, raw in zip(zip(*[b.column(k).to_pylist() for k in kept]) if kept else [()] * b.num_rows, b.column("key").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist()):
                doc = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
                start = 0
                while start < n:
                    part = doc[start : start + length - filled]
                    open_.append((own, start, part, n, key))
                    start, filled = start + len(part), filled + len(part)
                    if filled == length:
                        found += rows(open_, sequence)
                        sequence, open_, filled = sequence + 1, [], 0
            yield batch(found, schema)
        found, size = [], length
        while filled:
            size //= 2
            if filled < size:
                continue
            taken, room = [], size
            while room:
                own, start, part, n, key = open_.pop(0)
                taken.append((own, start, part[:room], n, key))
                if len(part) > room:
                    open_.insert(0, (own, start + room, part[room:], n, key))
                room -= min(room, len(part))
            found += rows(taken, sequence)
            sequence, filled = sequence + 1, filled - size
        if found:
            yield batch(found, schema)

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in ids.schema.fields[: len(keep)])
    out = placed.mapInArrow(run, head + ", ".join(f"{c} long" for c in names))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names)
