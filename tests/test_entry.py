"""Every query beside its SQL on the smallest tables, as the driver compares them."""

import glob
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows as ordered

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


LLM = set(entry.llm.QUERIES) if importlib.util.find_spec("foliant.llm") and entry.llm else set()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in LLM])
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == ordered(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
