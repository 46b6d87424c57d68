"""Every registered lineage query against its SQL, on the smallest tables there are."""

import os
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(rows):
    return sorted(tuple(f"{round(v, 6)}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)
