"""Alignment of two tokenizers against byte offsets and plain counts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from partloom.llm import alignment

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    def __init__(self):
        self.first, self.second = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
        self.first.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def groups(self, text):
        if not text:
            return []
        a, b = self.first.encode(" " + text, add_special_tokens=False).ids, self.second.encode(text)
        of_a = [bytes(self.letters[c] for c in self.first.id_to_token(x)) for x in a]
        of_b = [bytes([int(self.second.id_to_piece(y)[3:5], 16)]) if self.second.is_byte(y) else self.second.id_to_piece(y).replace("▁", " ").encode() for y in b]
        if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            return []
        ends = []
        for of in (of_a, of_b):
            at, found = 0, {}
            for k, x in enumerate(of):
                at += len(x)
                found[at] = k + 1
            ends.append(found)
        out, i, j = [], 0, 0
        for cut in sorted(ends[0].keys() & ends[1].keys()):
            out.append((a[i : ends[0][cut]], b[j : ends[1][cut]]))
            i, j = ends[0][cut], ends[1][cut]
        return out


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(rows):
    plain, found, count = Plain(), [], Counter()
    for i, text in rows:
        groups = plain.groups(text)
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        count.update(links.keys())
        found.append((i, groups, links))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for i, groups, links in found:
        yield (
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if count[k] == best[k[0]]),
            sum(n * count[k] for k, n in links.items()), hashlib.sha256(written(groups).encode()).hexdigest() if groups else "",
        )


def rows_of(seed):
    rng = random.Random(seed)
    parts = ["<s>", "</s>", "<unk>", "<|endoftext|>", "ab", "é", " ", "  ", "the ", "nation", "𝒳", "\n", "\t", "=====", "漢字", "tion", "don't ", "12345", "​", "é", "ﬁ"]
    texts = ["".join(rng.choice(parts + (["▁"] if k % 10 == 0 else [])) for _ in range(rng.choice([1, 2, 30, 300]))) for k in range(120)]
    texts += [None, "", " ", "  ", "\n", "▁", "=-" * 3000 + " " * 3000, "same text", "same text"]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, "an id again")]


@pytest.mark.parametrize("known", [0, 200, alignment.KNOWN])
def test_links(spark, monkeypatch, known):
    monkeypatch.setattr(alignment, "GATHERED", 500)
    rows = rows_of(known)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, r string")
    got = sorted((tuple(r) for r in alignment.linked(df, FIRST, SECOND, known=known).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_groups_as_text(spark):
    rows = rows_of(5)
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), FIRST, SECOND).collect()
    plain = Plain()
    assert sorted(((r.doc_id, r.groups) for r in got), key=repr) == sorted(((i, written(plain.groups(t))) for i, t in rows), key=repr)


def test_very_large_groups_and_forgotten_transitions(monkeypatch):
    of = alignment.Transducer(FIRST, SECOND)
    text = "a long  line,\tof the nation " * 300 + "漢字𝒳" * 200
    first, second = of.encoded(text, of.model.encode(text))
    want = of.groups(first, second)
    keys, n = alignment.weighed(want[1], want[2])
    monkeypatch.setattr(alignment, "WIDE", 1)
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    texts, pairs, wide = of.groups(first, second)
    again = alignment.weighed(pairs, wide)
    assert texts == want[0] and wide and again[0].tolist() == keys.tolist() and again[1].tolist() == n.tolist()


def test_empty_table(spark):
    assert alignment.linked(spark.createDataFrame([], "doc_id long, text string"), FIRST, SECOND).count() == 0
