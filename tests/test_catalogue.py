"""Every query against its SQL in DuckDB, or for its columns and rows."""

import os

import duckdb
import pytest

from lexmill.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def canon(frame):
    frame = frame[sorted(frame.columns)]
    return frame.astype(str).sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert len(found) and len(set(found.columns)) == len(found.columns)
    if name in catalogue.ORACLE_SQL:
        want = db.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert canon(found).values.tolist() == canon(want).values.tolist()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
