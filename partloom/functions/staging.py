"""Tables written to the shared folder between the rounds of iterative operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Where the setting is absent and Spark is local
    (tests), a temporary folder that is set for the session; on a cluster that would be each machine's own, so it is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="partloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


#: Folders of staged tables that this process has written and not removed.
_written: dict[str, SparkSession] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return it as reread: lineage ends there, so a
    lost executor costs no recomputation of what came before, and its shuffle files are freed. The table lies there until
    dropped(), release() or the end of the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/partloom/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    _written[path] = spark
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: those of past rounds of an iteration."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            _remove(path)


def release(spark: SparkSession) -> None:
    """Remove all tables that this session has staged. Results that read them must have been written before."""
    for path in [p for p, s in _written.items() if s is spark]:
        _remove(path)


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _at_exit() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  (the session may be gone; the folder is then the cluster's to clear)
            return


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to four tasks a core. A table of few bytes is read in one task, which is no place for costly expressions."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: Rows that a task groups at most, about.
ROWS = 1_000_000


def by_rows(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to as many tasks as there are ROWS of it, so that what a task holds does not grow with the table."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS)), *keys)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """As staged(), in so many buckets by key: a join by key with the table that is returned deals out the other side only."""
    spark = df.sparkSession
    table = f"partloom_{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.option("compression", "zstd").bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(spark)}/partloom/{table}").saveAsTable(table)
    return spark.table(table)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
