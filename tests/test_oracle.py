"""Every query of the core with an SQL twin, on the smallest tables; skipped where those are not."""

import os
from pathlib import Path

import pytest

from citeloom.plans import catalogue

DATA = Path(os.environ.get("CITELOOM_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df, names):
    return sorted(map(str, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(catalogue.SQL[name]).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    assert rows(ours, names) == rows(theirs, names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).columns
