"""The fill-in-the-middle transformation against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import fill_in_middle


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, drawn = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(seed, sizes):
    rng = random.Random(seed)
    parts = ["<", "P", ">", "S", "M", "ab", "é", " ", "\n", "𝒳", "\0", "<S", "longer"]
    for k, n in enumerate(sizes):
        yield "".join(rng.choice([*parts, "<P>"] if k % 3 == 0 else parts[:2] + parts[5:]) for _ in range(n))


def same(spark, rows, keep=("doc_id",)):
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, output string")
    out = fill_in_middle.transform(df).withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in out.collect()), key=repr)
    assert got == sorted(((i, *plain_version(i, t), t or "") for i, t, *_ in rows), key=repr)
    return [r[2] for r in got]


def test_short_texts_and_odd_rows(spark):
    rows = [(k, t, "x", "y") for k, t in enumerate(texts(3, [0, 1, 2, 3, 30, 63, 64, 65, 200] * 12))]
    rows += [(None, "a b c", "x", None), (None, None, None, None), (7, None, "x", "y"), (8, "same text", "x", "y"), (8, "same text", "x", "y")]
    assert set(same(spark, rows)) == {"plain", "psm", "spm"}


@pytest.mark.parametrize("piece", [64, 100, 1000])
def test_giant_texts_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(fill_in_middle, "PIECE", piece)
    rows = [(k, t, None, None) for k, t in enumerate(texts(piece, [900, 1000, 2000, 50, 3333] * 6))]
    rows += [(900, "a" * 5000, None, None), (901, " " * 5000, None, None), (902, "a" * 63 + "<P>" + "b" * 2000, None, None), (903, "a" * 99 + "<" + "P>" * 700, None, None)]
    same(spark, rows)


def test_a_very_long_text(spark):
    same(spark, [(k, "".join(texts(k, [150_000])), None, None) for k in (1, 2)] + [(3, "word " * 200_000, None, None)])


def test_empty_table(spark):
    assert fill_in_middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_functions_compose_from_every_state():
    """A text's function is the composition of its parts', for each start state."""
    for t in texts(5, [1, 40, 130, 700]):
        for cut in (1, len(t) // 3, len(t) - 1):
            state, units, marks = fill_in_middle.Scan([t, t[:cut], t[cut:]]).functions()
            middle = state[1]
            assert (state[0] == state[2][middle]).all()
            assert (units[0] == units[1] + units[2][middle]).all()
            assert (marks[0] == marks[1] + marks[2][middle]).all()


def test_where_units_begin():
    t = "".join(texts(9, [0, 500])) + "end"
    starts = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", t)]
    n = np.arange(len(starts))
    assert fill_in_middle.Scan([t]).begins(0 * n, 0 * n, n).tolist() == starts
