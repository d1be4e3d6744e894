import importlib

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows_of
from tidemark.sources.tables import TABLES

LLM = importlib.util.find_spec("tidemark.llm") is not None
CORE = {k for part, _ in entry._PARTS[:7] for k in part}


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p2_found", "p5_found"} <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", sorted(CORE))
def test_core_query_against_sql(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    if name in entry.oracle_sql():
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        cur = con.execute(entry.oracle_sql()[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())
