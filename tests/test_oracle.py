import pathlib

import duckdb
import pytest

import __spark_entry__
from gristmill import catalog

SF = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    mine, theirs = catalog.QUERIES[name](spark, str(SF)).toPandas(), con.sql(catalog.ORACLES[name]).df()
    names = sorted(theirs.columns)
    assert sorted(mine.columns) == names
    key = lambda d: sorted(repr(tuple(map(plain, r))) for r in d[names].astype(object).itertuples(index=False))
    assert key(mine) == key(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
