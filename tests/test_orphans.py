import datetime as dt

import pytest

from tidemark.functions.text import norm_id
from tidemark.operators.orphans import Child, orphan_counts, orphan_rows

D = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def tables(spark):
    parents = spark.createDataFrame([("a", D(0), None), ("b", D(0), D(10)), ("b", D(20), None), ("b", D(20), None), ("c", None, None), (None, D(0), None)], "key string, since timestamp_ntz, until timestamp_ntz")
    rows = [
        ("1", "a", D(5)), ("2", " A ", D(-1)), ("3", "b", D(9)), ("4", "B", D(10)), ("5", "b", D(15)), ("6", "b", D(20)), ("7", "c", D(3)), ("8", "zz", D(3)), ("9", None, D(3)), ("10", "", D(3)),
        ("11", "a", None), ("12", "zz", None), ("4", "B", D(10)), (None, "zz", D(40)),
    ]
    return parents, spark.createDataFrame([(*r, "x") for r in rows], "k string, ref string, t timestamp_ntz, spans string")


def test_rows(spark, tables):
    parents, rows = tables
    child = Child("t", rows, "k", norm_id("ref"), "t")
    got = sorted((r.row_key or "") for r in orphan_rows([child], parents).collect())
    assert got == sorted(["2", "4", "4", "5", "7", "8", "12", ""])
    assert orphan_rows([child._replace(rows=rows.limit(0))], parents).count() == 0
    assert orphan_rows([child], parents.limit(0)).count() == 12  # every row with a reference


def test_counts(tables):
    parents, rows = tables
    kids = [Child("t", rows, "k", norm_id("ref"), "t"), Child("u", rows.where("k = '8'"), "k", norm_id("ref"), "t")]
    got = {(r.source_table, r.period): (r.orphans, r.orphan_keys) for r in orphan_counts(kids, parents).collect()}
    assert got[("u", dt.date(2024, 1, 1))] == (1, 1)
    assert got[("t", dt.date(2024, 1, 1))] == (4, 3)  # 4, 5 (b), 7 (c), 8 (zz)
    assert got[("t", dt.date(2023, 12, 1))] == (1, 1)
    assert got[("t", None)] == (1, 1)
