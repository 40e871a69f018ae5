"""Each catalog query against its SQL in DuckDB, on the smallest driver tables."""

import glob
import os
from pathlib import Path

import pytest

from helixframe.plans import catalog

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(SF)).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(map(str, f[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_oracles_name_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
