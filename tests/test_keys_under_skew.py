import datetime as dt
import random
from collections import Counter

import pytest

from tidemark.operators.keyfigures import key_figures, key_quantiles
from tidemark.operators.sizes import heavy_keys, lookup_join

random.seed(3)
ROWS = [(random.choice(["hot"] * 40 + ["warm"] * 8 + [f"k{i}" for i in range(60)] + [None] * 4), random.choice(["a", "b", None]), None if random.random() < 0.05 else random.randrange(-10**9, 10**9)) for _ in range(6000)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "key string, member string, v bigint, n string").repartition(6)


def test_heavy(df):
    counts, n = Counter(r[0] for r in ROWS), len(ROWS)
    for share in (0.03, 0.3, 0.0005, 1.0):
        want = {(k, c, n) for k, c in counts.items() if k is not None and c >= share * n}
        assert {tuple(r) for r in heavy_keys(df, "key", share, bins=16).collect()} == want
    assert heavy_keys(df.limit(0), "key", 0.1).count() == 0
    assert heavy_keys(df.where("key is null"), "key", 0.1).count() == 0
    with pytest.raises(ValueError, match="share"):
        heavy_keys(df, "key", 0)


def test_threshold_is_exact(spark):
    df = spark.createDataFrame([("a",)] * 3 + [(f"b{i}",) for i in range(97)], "key string")
    assert [r.key for r in heavy_keys(df, "key", 0.03).collect()] == ["a"]
    assert heavy_keys(df.unionByName(df.limit(1).selectExpr("'z' as key")), "key", 0.03).count() == 0


def test_figures(df):
    got = {r.key: tuple(r)[1:] for r in key_figures(df, "key", "member", "v").collect()}
    assert set(got) == {r[0] for r in ROWS} - {None}
    for k, g in got.items():
        mine = [r for r in ROWS if r[0] == k]
        vs = [r[2] for r in mine if r[2] is not None]
        assert g == (len(mine), len({r[1] for r in mine} - {None}), min(vs), max(vs))


@pytest.mark.parametrize("hot", [0.002, 0.2, 1.0])
def test_quantiles(df, hot):
    probs = (0.0, 0.25, 0.5, 0.999, 1.0)
    got = {(r.key, r.prob): r.value for r in key_quantiles(df, "key", "v", probs, hot_share=hot, bins=7).collect()}
    for k in {r[0] for r in ROWS} - {None}:
        vs = sorted(r[2] for r in ROWS if r[0] == k and r[2] is not None)
        for p in probs:
            rank = next(i for i in range(1, len(vs) + 1) if i / len(vs) >= p)
            assert got[k, p] == vs[rank - 1], (k, p)


def test_quantile_types_and_ties(spark):
    day = dt.date(2024, 1, 31)
    df = spark.createDataFrame([("a", day, dt.datetime(2024, 1, 1, 0, 0, 0, 7))] * 5 + [("b", None, None)], "key string, d date, t timestamp_ntz")
    assert [tuple(r) for r in key_quantiles(df, "key", "d").collect()] == [("a", 0.5, day)]
    assert [r.value for r in key_quantiles(df, "key", "t").collect()] == [dt.datetime(2024, 1, 1, 0, 0, 0, 7)]
    with pytest.raises(TypeError):
        key_quantiles(df, "key", "key")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join(spark, df, how):
    side = spark.createDataFrame([("hot", 1), ("k3", 2), ("k5", 3), ("none", 4)], "key string, w int")
    rows = df.select("key", "v")
    want = sorted(map(tuple, rows.join(side, "key", how).collect()), key=repr)
    for limit, share in ((100, 0.5), (1, 0.1), (1, 0.9)):
        assert sorted(map(tuple, lookup_join(rows, side, "key", how, limit, share).collect()), key=repr) == want
