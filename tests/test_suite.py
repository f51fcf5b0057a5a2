"""Every query of the suite against its SQL on the smallest test tables."""

import os
from pathlib import Path

import duckdb
import pytest

from assayer import suite

DATA = Path(os.environ.get("ASSAYER_TESTDATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = suite.QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.execute(suite.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    assert got == sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 9
    assert set(suite.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
