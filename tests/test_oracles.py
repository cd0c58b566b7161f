"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from partloom.plans import decisions, registry, searches, structures, texts, verdicts  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def canonical(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return "null"
        return f"{float(x):.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


#: Iterations of many small jobs, which take longest here; each has tests of its own against a plain version.
ITERATED = {"widest_path", "widest_in_cycles", "path_links", "list_scales", "free_places", "suggested_places", "rescored_links"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - ITERATED))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA)).toPandas()
    want = duck.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
