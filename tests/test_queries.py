"""Every registered query of the core against its DuckDB SQL."""

import os

import duckdb
import pytest

from kilnwork.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("part", "conversations", "documents", "pages")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = con.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[cols].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)
