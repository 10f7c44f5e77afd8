"""Every registered query of the library against its SQL on the smallest tables, and the driver contract."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewire.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normalised(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return float(f"{v:.9g}") if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    columns = sorted(df.columns)
    return sorted((tuple(cell(v) for v in row) for row in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(map(str, r)) for r in map(floats, normalised(got))] == [tuple(map(str, r)) for r in map(floats, normalised(want))]


def floats(row: tuple) -> tuple:
    return tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in row)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["source_region", "subject_region", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
