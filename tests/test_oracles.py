"""Every reference-side query with SQL is held against DuckDB at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

from itemforge.plans import extended, further, queries

QUERIES, ORACLES = queries.QUERIES | extended.QUERIES | further.QUERIES, queries.ORACLES | extended.ORACLES | further.ORACLES
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def plain(df: pd.DataFrame) -> list:
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    assert len(found)
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).fetchdf()
        assert sorted(found.columns) == sorted(want.columns)
        assert plain(found) == plain(want)
