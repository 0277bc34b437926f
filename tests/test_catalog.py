"""Every catalogue query against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from verbflow.catalog import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    values = frame[sorted(frame.columns)].astype(object)
    values = values.where(values.notna(), None)
    return sorted(repr([builtin(v) for v in r]) for r in values.itertuples(index=False, name=None))


def builtin(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, expected = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry_works_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
