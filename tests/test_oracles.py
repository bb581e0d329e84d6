"""Every registered query against its SQL at the smallest scale; queries without SQL must give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import SAME_TYPE, TABLES, rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, con, name):
    frame = entry_module.queries()[name](spark, SF)
    left = frame.toPandas()
    sql = entry_module.oracle_sql().get(name)
    assert frame.columns
    if sql is None:
        assert len(left) > 0
        return
    right = con.execute(sql).df()
    types = {r[0]: r[1] for r in con.execute(f"describe ({sql})").fetchall()}
    assert {c: SAME_TYPE.get(t) for c, t in frame.dtypes} == types
    assert rows(left) == rows(right)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
