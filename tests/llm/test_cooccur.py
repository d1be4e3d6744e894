import random
from collections import Counter
from itertools import combinations

import pytest

from tidemark.llm.cooccur import PairTable, signed_pairs

random.seed(8)


def _baskets(n, seed):
    rng = random.Random(seed)
    return {f"b{i}": {f"i{min(int(rng.expovariate(0.2)), 40)}" for _ in range(rng.randrange(0, 9))} for i in range(n)}


def _counts(baskets):
    return Counter(p for s in baskets.values() for p in combinations(sorted(s), 2)), Counter(x for s in baskets.values() for x in s), sum(bool(s) for s in baskets.values())


def _check(table, baskets, least=1, lift=0.0):
    pairs, items, total = _counts(baskets)
    want = {(a, b): (n, items[a], items[b]) for (a, b), n in pairs.items() if n >= least and n * total >= lift * items[a] * items[b]}
    rows = table.scores(least, lift).collect()
    assert {(r.item_a, r.item_b): (r.n, r.n_a, r.n_b) for r in rows} == want
    assert all(abs(r.lift - r.n * total / (r.n_a * r.n_b)) < 1e-9 for r in rows)


def _df(spark, baskets):
    rows = [(b, i) for b, s in baskets.items() for i in s]
    return spark.createDataFrame([(*r, 1) for r in rows + rows[:20] + [(None, "i1"), ("b1", None)]], "basket string, item string, n int")


def test_incremental(spark, tmp_path):
    now = _baskets(150, 1)
    table = PairTable(spark, f"file://{tmp_path}/t", buckets=4)
    table.apply(_df(spark, now))
    _check(table, now)
    _check(table, now, 3, 1.5)
    change = {k: v for k, v in _baskets(40, 2).items() if v}
    now |= change
    table.apply(_df(spark, change), spark.createDataFrame([("b100",), ("b5",), ("none",), (None,)], "basket string"))
    now["b100"] = set()
    if "b5" not in change:
        now["b5"] = set()
    _check(table, now)
    again = PairTable(spark, f"file://{tmp_path}/t", buckets=4)  # the state outlives the object
    _check(again, now, 2)
    touched = spark.createDataFrame([("i0",)], "item string")
    assert {(r.item_a, r.item_b) for r in again.scores(1, touching=touched).collect()} == {p for p in _counts(now)[0] if "i0" in p}
    again.apply(_df(spark, {}).where("false"), spark.createDataFrame([(b,) for b in now], "basket string"))
    assert again.scores().count() == 0 and again.items().count() == 0


def test_empty(spark):
    table = PairTable(spark)
    table.apply(spark.createDataFrame([], "basket string, item string"))
    assert table.scores().count() == 0


@pytest.mark.parametrize("block", [256, 5])
def test_huge_basket(spark, block):
    sets = spark.createDataFrame([(list(range(40)), 1), (list(range(3)), -1), ([7], 1), ([], 1)], "items array<bigint>, sign bigint")
    got = {(r.a, r.b): r.n for r in signed_pairs(sets, block).collect()}
    want = Counter(combinations(range(40), 2))
    want.subtract(combinations(range(3), 2))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_layers_and_compaction(spark):
    """Many small changes: layers are merged where they are too many, and a change writes only the buckets that it alters."""
    now = _baskets(80, 4)
    table = PairTable(spark, buckets=8, layers=2)
    table.apply(_df(spark, now))
    for step in range(4):
        change = {f"b{step}": {"i1", "i2", f"new{step}"}}
        now |= change
        table.apply(_df(spark, change).where(f"basket = 'b{step}'"))
    depth = Counter(b for _, _, live in table.state["pairs"] for b in live)
    assert max(depth.values()) <= 2 and len(table.state["sets"]) <= 2 and len(table.state["items"]) <= 2
    _check(table, now)
    table.compact()
    assert set(table._depth().values()) == {1} and len(table.state["items"]) == 1
    _check(table, now, 2, 1.1)


def test_pair_budget():
    """However many pairs a batch has, no more than the budget and one row's are held."""
    import numpy as np
    import pandas as pd

    from tidemark.llm.cooccur import _pairs

    rng = np.random.default_rng(1)
    rows = [sorted(rng.choice(500, rng.integers(2, 90), replace=False).tolist()) for _ in range(400)]
    b = pd.DataFrame({"left": rows, "right": [[] for _ in rows], "same": True, "sign": 1})
    b.loc[3, "same"], b.at[3, "right"], b.at[4, "right"] = False, [1001, 1002], [1003]
    parts = list(_pairs(iter([b]), budget=20_000))
    assert len(parts) > 10 and all(len(p) <= 20_000 + 90 * 89 // 2 for p in parts)
    got = pd.concat(parts).groupby(["a", "b"])["n"].sum().to_dict()
    want = Counter(p for i, r in enumerate(rows) if i != 3 for p in combinations(r, 2)) + Counter((x, y) for x in rows[3] for y in (1001, 1002)) + Counter((x, 1003) for x in rows[4])
    assert got == want


def test_exact_bound(spark):
    """A lift of four decimals and more is neither rounded nor cut."""
    table = PairTable(spark)
    table.apply(_df(spark, {f"b{i}": {"x", "y"} if i < 30 else {f"z{i}"} for i in range(90)}).where("n = 1"))
    assert table.scores(10, 3).count() == 1 and table.scores(10, 3.000001).count() == 0
    with pytest.raises(ValueError, match="lift"):
        table.scores(1, 1e-9)


@pytest.mark.parametrize("loads", [1, 4])
def test_loads(spark, loads):
    """Rows that come in several loads, also into baskets that are there, give the table of all at once."""
    import datetime as dt

    from tidemark.llm.cooccur import apply_in_loads

    now = _baskets(60, 6)
    rng = random.Random(2)
    rows = [(b, i, dt.datetime(2025, 1, 1) + dt.timedelta(days=rng.randrange(90))) for b, s in now.items() for i in sorted(s)]
    rows[5] = (*rows[5][:2], None)
    table = PairTable(spark)
    last = apply_in_loads(table, spark.createDataFrame(rows, "basket string, item string, at timestamp"), loads)
    _check(table, now)
    assert table.state["version"] == loads and last.count() > 0


@pytest.mark.parametrize("block", [256, 4])
def test_items_with_others(spark, block):
    """Pairs within the items and of items with others, whole or in blocks, and none within the others."""
    from tidemark.llm.cooccur import pair_rows

    sets = spark.createDataFrame([(list(range(9)), list(range(20, 31)), 1), ([1, 2], [3], -1), ([5], [], 1), ([], [1, 2], 1)], "items array<bigint>, others array<bigint>, sign bigint")
    got = {(r.a, r.b): r.n for r in pair_rows(sets, block).groupBy("a", "b").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    want = Counter([*combinations(range(9), 2), *((x, y) for x in range(9) for y in range(20, 31))])
    want.subtract([(1, 2), (1, 3), (2, 3)])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
