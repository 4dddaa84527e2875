"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from gristmill.plans import ORACLE_SQL, QUERIES
from gristmill.sources.scans import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list:
    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return [columns, *sorted(tuple(map(one, r)) for r in frame[columns].itertuples(index=False))]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
