import random
from itertools import combinations

import pytest

from tidemark.llm import setjoin

random.seed(5)
HOT = [f"h{i}" for i in range(6)]


def _data():
    out, rare = {}, [f"r{i}" for i in range(300)]
    for i in range(500):
        out[i] = set(random.sample(HOT, random.randrange(0, 6))) | set(random.sample(rare, random.randrange(0, 9)))
    for i in range(500, 700):  # near copies and copies
        s = set(out[random.randrange(500)])
        for _ in range(random.randrange(0, 3)):
            s ^= {random.choice(rare)}
        out[i] = s
    out[900], out[901] = set(rare), set(rare) - {"r1", "r2"}
    return out


DATA = _data()


def _rows():
    return [(k, v) for k, s in DATA.items() for v in s] + [(1, v) for v in DATA[1]] + [(None, "h1"), (3, None)]


@pytest.mark.parametrize(("threshold", "least"), [(0.7, 4), (0.5, 1), (0.9, 2), (1.0, 1), (0.35, 3)])
def test_brute_force(spark, threshold, least):
    df = spark.createDataFrame([(*r, "x") for r in _rows()], "rec bigint, tok string, id string")
    pairs, members = setjoin.similar_records(df, "rec", "tok", threshold, least)
    sets = {k: s for k, s in DATA.items() if len(s) >= least}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}
    for block in (1024, 1):
        got = [tuple(r) for r in setjoin.expand(pairs, members, block).collect()]
        assert set(got) == want and len(got) == len(want)
    links = {r.id: r.links for r in setjoin.links(pairs, members).collect()}
    assert links == {k: sum(k in p for p in want) for k in sets}


def test_empty(spark):
    df = spark.createDataFrame([], "rec bigint, tok string")
    pairs, members = setjoin.similar_records(df, "rec", "tok", 0.7)
    assert pairs.count() == 0 and members.count() == 0


def test_string_ids_and_copies(spark):
    df = spark.createDataFrame([(x, t) for x in "abcde" for t in "pqrs"], "rec string, tok string")
    pairs, members = setjoin.similar_records(df, "rec", "tok", 0.7)
    assert pairs.count() == 0 and {r.class_id for r in members.collect()} == {"a"}
    assert setjoin.expand(pairs, members, 2).count() == 10
    assert {r.links for r in setjoin.links(pairs, members).collect()} == {4}


def test_bad_threshold(spark):
    with pytest.raises(ValueError, match="threshold"):
        setjoin.similar_classes(spark.createDataFrame([(1, ["a"])], "id bigint, tokens array<string>"), 0)


def _between(a, b, t):
    return {(x, y) for x in a for y in b if a[x] and b[y] and len(a[x] & b[y]) >= t * len(a[x] | b[y]) - 1e-12}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_between_two_tables(spark, threshold):
    """Pairs across two tables whose ids clash, copies and equal sets included, and no pair within either."""
    a = {k: s for k, s in DATA.items() if k % 2}
    b = {k // 2: s for k, s in DATA.items() if k % 3}
    da, db = (spark.createDataFrame([(k, v) for k, s in x.items() for v in s] + [(None, "h1"), (3, None)], "rec bigint, tok string") for x in (a, b))
    pairs, ma, mb = setjoin.similar_between(da, db, "rec", "tok", threshold)
    ca, cb = ({r.id: r.class_id for r in m.collect()} for m in (ma, mb))
    got = {(r.id_a, r.id_b) for r in pairs.collect()}
    assert {(x, y) for x in ca for y in cb if (ca[x], cb[y]) in got} == _between(a, b, threshold)
    assert setjoin.similar_between(da.limit(0), db, "rec", "tok", threshold)[0].count() == 0


def test_hot_class_and_hot_signatures(spark, monkeypatch):
    """A third of the records equal, and a token in nine of ten sets: classes and signatures are cut into blocks, and every pair comes out once."""
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", 20)
    monkeypatch.setattr(setjoin, "HOT", 0.002)
    rng = random.Random(12)
    sets = {i: {"hot", "a", "b", "c"} for i in range(200)}
    for i in range(200, 600):
        sets[i] = ({"hot"} if rng.random() < 0.9 else set()) | set(rng.sample([f"r{j}" for j in range(12)], rng.randrange(1, 5)))
    df = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "rec bigint, tok string")
    pairs, members = setjoin.similar_records(df, "rec", "tok", 0.6)
    got = [tuple(r) for r in setjoin.expand(pairs, members, 16).collect()]
    want = {(x, y) for x, y in combinations(sets, 2) if len(sets[x] & sets[y]) >= 0.6 * len(sets[x] | sets[y]) - 1e-12}
    assert len(got) == len(want) and set(got) == want


def test_large_class_is_not_gathered(spark):
    """The parts of a class of 50,000 are small, and its records are counted, not paired."""
    rows = spark.range(50_000).selectExpr("id as rec", "explode(array('p', 'q', 'r', 's')) as tok").unionByName(spark.createDataFrame([(60_000, t) for t in "pqrst"], "rec bigint, tok string"))
    pairs, members = setjoin.similar_records(rows, "rec", "tok", 0.7, 4)
    assert [tuple(r)[:3] for r in pairs.collect()] == [(0, 60_000, 4)]
    sizes = [len(r.ids) for r in setjoin._in_blocks(members.where("n > 1"), setjoin.BLOCK).collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= 3 * 50_000 / len(sizes)
    links = {r.id: r.links for r in setjoin.links(pairs, members).where("id in (7, 60000)").collect()}
    assert links == {7: 50_000, 60_000: 50_000}
