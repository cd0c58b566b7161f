"""A corpus pipeline from the operators of partloom.llm; each stage's rows are written and reread as the next one's."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from partloom.llm import decontamination, exact_spans, packing, quality_rules, simhash
from partloom.llm.base import prepare, staged, table

#: Shingles of five words; candidates differ in few bits of one of four fingerprints, and are then compared in full.
SHINGLE, RADIUS, SIMILARITY = 5, 9, 0.8
#: Bytes from which a passage that repeats across documents is cut: under fifty words of prose.
PASSAGE = 200
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def rules_stage(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality_rules.filter_rules(docs)


def near_stage(spark, docs, sf_dir):
    """One document of each group of near duplicates stays, that of the least id."""
    return simhash.one_of_each(docs, simhash.similar(docs, words_in=SHINGLE, radius=RADIUS, similarity=SIMILARITY))


def repeats_stage(spark, docs, sf_dir):
    """Passages that repeat are cut out of the texts, wherever they stand; n_chars follows. Documents of which
    nothing is left go."""
    cut = exact_spans.cut_repeats(docs, PASSAGE)
    if "n_chars" not in cut.columns:
        return cut
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(cut.schema["n_chars"].dataType))


def benchmark_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    """All that is left, packed along the curve."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality rules", rules_stage),
    ("SimHash near-dedup", near_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
