"""The last day in scope as an argument, and what is refused."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows_of
from tidemark.operators.sizes import lookup_join
from tidemark.plans import base, composition, overview, provenance
from tidemark.sources.tables import TABLES

NAMES = ("launch_events", "lifecycle", "sharing_summary", "diffusion_horizons", "overview_summary", "domain_trend", "release_counts_smoothed", "fingerprints", "review_leverage", "axis_shares", "cascade_metrics", "release_strategy")


@pytest.mark.parametrize("day", ["2024-03-31", "2022-12-31"])
@pytest.mark.parametrize("name", NAMES)
def test_as_of(spark, folder, name, day):
    df = entry.queries()[name](spark, folder, as_of=day)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name].replace(base.SCOPE, f"select date '{day}' c"))
    cols = [c[0] for c in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def test_default_and_bad_days(spark, folder):
    last = base.cutoff(spark, folder)
    assert overview.launch_events(spark, folder, as_of=last).count() == overview.launch_events(spark, folder).count()
    assert overview.launch_events(spark, folder, as_of="1990-01-01").count() == 0
    assert base.cutoff(spark, folder) == last
    for bad in ("soon", 20240101, dt.datetime(2024, 1, 1)):
        with pytest.raises(ValueError):
            provenance.adoption_events(spark, folder, as_of=bad)
    for bad in (0, -3, True, 1.5):
        with pytest.raises(ValueError, match="positive"):
            composition.domain_trend(spark, folder, window_days=bad)


def test_windows(spark, folder):
    narrow, wide = (composition.domain_trend(spark, folder, window_days=n).where("share is not null").count() for n in (5, 400))
    assert narrow < wide


def test_undated_rows_are_refused(spark):
    rows = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (2, None)], "k int, release_date date")
    token = base._AS_OF.set(dt.date(2021, 1, 1))
    try:
        with pytest.raises(Exception, match="no release date: k 2"):
            base.in_scope(rows, spark, "", "k").collect()
        assert base.in_scope(rows.where("k = 1"), spark, "", "k").count() == 1
    finally:
        base._AS_OF.reset(token)


def test_lookup_is_many_to_one(spark):
    rows, side = spark.createDataFrame([(1,), (1,), (None,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "k int, v string")
    with pytest.raises(ValueError, match="k 1 stands 2 times"):
        lookup_join(rows, side, "k", check=True)
    assert lookup_join(rows, side.where("v <> 'b'"), "k", "left", check=True).count() == 3
