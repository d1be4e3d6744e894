import random

import pytest

from tidemark.llm.packing import BestFit, pack, token_counts, tokenizer


def test_tokens(spark):
    texts = [None, "", "Hello world, it's 12 o'clock.", "ünï — 漢字 😀\n\n  x", "a " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc bigint, id string").toDF("doc", "tokens")
    enc = tokenizer()
    assert {r.id: r.tokens for r in token_counts(df, "doc", "tokens").collect()} == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def _bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return bins


@pytest.mark.parametrize(("capacity", "open_bins", "shard_bins"), [(100, 8, 10_000), (100, 1, 5), (7, 3, 20)])
def test_whole_and_tight(spark, capacity, open_bins, shard_bins):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, capacity, capacity + 1, 3 * capacity, rng.randrange(1, capacity)]) for _ in range(1500)]
    rows = [(i, n) for i, n in enumerate(sizes)] + [(3, sizes[3]), (None, 5), (9000, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id bigint, tokens bigint, bin int")
    got = pack(df, capacity, open_bins, shard_bins).collect()
    bins = _bins(got, capacity)
    total = sum(n or 0 for _, n in rows)
    assert sum(r.length for r in got) == total
    parts = {}
    for r in got:
        parts.setdefault(r.id, []).append((r.part, r.start, r.length))
    for i, n in enumerate(sizes):
        if n == 0:
            assert i not in parts
            continue
        mine = sorted(parts[i])[:: 2 if i == 3 else 1]
        assert sum(x[2] for x in mine) == n
        assert len(mine) == -(-n // capacity)  # split only where it exceeds the capacity
    shards = len({r.shard for r in got})
    assert len(bins) <= total / capacity / 0.75 + open_bins * shards + shards
    again = pack(df.repartition(7), capacity, open_bins, shard_bins).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_best_fit_order():
    b = BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 3, 4, 10, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    b = BestFit(10, 2)
    assert [b.place(n)[0] for n in (5, 6, 7, 5)] == [0, 1, 2, 0]  # the third bin closes the fullest, bin 1
    with pytest.raises(ValueError, match="at least 1"):
        BestFit(0, 1)


def test_empty(spark):
    df = spark.createDataFrame([], "id string, tokens bigint")
    assert pack(df).count() == 0
