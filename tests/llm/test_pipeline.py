"""The whole pipeline on planted rows: what goes, what stays, and that every token left is packed once."""

import random

import corpus_pipeline
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    clean = [prose(rng, 150) for _ in range(8)]
    item, passage = prose(rng, 25), prose(rng, 70)
    near = clean[0].split()
    near[40] = "changed"
    spoiled = item.replace("a", "e", 2)
    texts = [
        *((i, t) for i, t in enumerate(clean)), (20, clean[0]), (21, " ".join(near)), (22, clean[1]), (30, None), (31, ""), (32, "too short"), (33, "again and again " * 60),
        (40, clean[2][:400] + " " + prose(rng, 100) + " " + item + " " + prose(rng, 20)), (41, prose(rng, 80) + " " + spoiled), (50, prose(rng, 80) + " " + passage + " " + prose(rng, 30)), (51, prose(rng, 60) + " " + passage),
        (None, prose(rng, 90)), (None, prose(rng, 95)), (60, prose(rng, 85)), (60, prose(rng, 88)),
    ]
    texts[15] = (40, prose(rng, 100) + " " + item + " " + prose(rng, 20))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append(sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect()))
    ids = [[i for i, _ in rows] for rows in left]
    assert ids[0] == [-1, -1, 0, 1, 2, 3, 4, 5, 6, 7, 20, 21, 22, 40, 41, 50, 51, 60, 60]  # rules
    assert ids[1] == [-1, -1, 0, 1, 2, 3, 4, 5, 6, 7, 40, 41, 50, 51, 60, 60]  # one of each group
    cut = [t for i, t in left[2] if i in (50, 51)]
    assert ids[2] == ids[1] and not any(passage[5:-5] in t for t in cut) and {t for i, t in left[2] if 0 <= i < 8} == set(clean)
    assert ids[3] == [-1, -1, 0, 1, 2, 3, 4, 5, 6, 7, 50, 51, 60, 60]  # leaks
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    want = sum(len(encode.encode(t, add_special_tokens=False).ids) + 1 for _, t in left[3])
    assert sum(r.length for r in packed) == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
