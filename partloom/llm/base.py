"""What the corpus operators share: session settings, staged tables, readers, word rules."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions.staging import staged  # noqa: F401  (operators take it from here)

#: The six white-space characters that part words, as bytes.split() has them.
SPACES = b" \t\n\x0b\x0c\r"

#: Bounds of one Arrow batch sent to a Python worker.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes (texts may be very long), free shuffle files when a write has
    ended, and let Python workers import this package from where the driver has it."""
    for key, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
    ):
        spark.conf.set(key, str(value))
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulo: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulo


def free_name(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
