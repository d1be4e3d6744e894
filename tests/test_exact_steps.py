"""Operators that take one way or another give the same rows."""

import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from tidemark.functions.keys import alias_pattern, snippet
from tidemark.operators import keyfigures, listfield, pages, resolve, trends


def test_large_catalogue_as_small(spark, folder):
    """Names are protected alike by one pattern and by the join, however long they are and wherever they stand."""
    models, names = spark.read.parquet(f"{folder}/models.parquet"), spark.read.parquet(f"{folder}/benchmarks.parquet").select(F.col("benchmark_name").alias("name"))
    more = spark.createDataFrame([("Deep, Wide and Long Reading of Very Old Legal Texts, Part One, Two and Three",), ("A / B",), ("x and y",)], "name string")
    odd = spark.createDataFrame([(10**9, "MMLU; Deep, Wide and Long Reading of Very Old Legal Texts, Part One, Two and Three; GSM8K, a  /  b, X AND Y"), (None, "x and y, z")], "model_row_id bigint, benchmarks string")
    rows, catalogue = models.select("model_row_id", "benchmarks").unionByName(odd), names.unionByName(more)
    small, large = (sorted(map(repr, listfield.split_list_field(rows, "model_row_id", "benchmarks", catalogue, limit=n).collect())) for n in (20_000, 0))
    assert small == large and any("Three'" in r for r in small)


@pytest.mark.parametrize("share", [None, 0.05, 1.0])
def test_quantiles_hot_and_light(spark, share):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(30)}", rng.choice([None, *range(-50, 50)])) for _ in range(3000)]
    probs = (0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0)
    got = {(r.key, r.prob): r.value for r in keyfigures.key_quantiles(spark.createDataFrame(rows, "k string, v int"), "k", "v", probs, hot_share=share).collect()}
    for k in {k for k, _ in rows}:
        values = sorted(v for x, v in rows if x == k and v is not None)
        for p in probs:
            ranks = [(i + 1) / len(values) for i in range(len(values))]
            assert got[k, p] == values[min(len(values) - 1, bisect_left(ranks, p - 1e-12))], (k, p)


def test_weights_are_not_rounded(spark):
    rel = spark.createDataFrame([(1, "p", "m", "2020-01-01", "a,b,c")], "model_row_id int, provider string, model_name string, release_date string, benchmarks string")
    names = spark.createDataFrame([(x, x) for x in "abc"], "name_key string, benchmark_id string")
    got = resolve.build_resolved_mentions(rel, names, spark.createDataFrame([], "alias_key string, target string, match_type string"))[0].agg(F.sum("release_weight")).first()[0]
    assert abs(got - 1) < 1e-12


def test_lanes_by_force(spark):
    """Each entry has the first lane of its group that no earlier entry's footprint still covers."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"2024-{rng.randrange(1, 7):02d}-{rng.randrange(1, 28):02d}", f"n{i:03d}") for i in range(150)] + [(None, "2024-01-05", "x"), ("c", None, "y")]
    df = spark.createDataFrame(rows, "g string, day string, n string").withColumn("day", F.col("day").cast("date"))
    got = {r.n: r for r in trends.lanes(df, "g", "day", "n", 12.0).collect()}
    assert len(got) == len(rows)
    for g in "ab":
        placed: list = []
        for r in sorted((r for r in got.values() if r.g == g), key=lambda r: (r.day, r.n)):
            busy = {lane for day, lane in placed if (r.day - day).days < 12}
            assert r.lane == next(i for i in range(200) if i not in busy)
            placed.append((r.day, r.lane))


def test_isolated_and_stacked(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5), (3, None), (4, 0.1), (5, 0.2)], "day int, share double")
    assert [r.isolated for r in trends.isolated_days(df, "day", "share").orderBy("day").collect()] == [False, True, False, False, False]
    got = trends.stacked(spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 1.0)], "g string, k int, v double"), ["g"], "v", ["k"]).orderBy("g", "k").collect()
    assert [(r.low, r.high) for r in got] == [(0.0, 2.0), (2.0, 5.0), (0.0, 1.0)]


def test_alias_hits_in_any_number_of_passes(spark, folder):
    """Of equal hits the one that sorts first wins, with the aliases at once and in passes."""
    docs = spark.createDataFrame([(1, "table", "Foo-Bar and foo bar, then FOO  BAR; Quux here. " * 3), (1, "other", "quux"), (2, None, None)], "p int, k string, t string")
    al = spark.createDataFrame([("Foo Bar", "x"), ("foo-bar", "x"), ("Quux", "q"), ("quux", "q"), (None, "z"), (" ", "z")], "alias string, benchmark_id string")
    one, many = (sorted(map(repr, pages.scan_aliases(docs, "p", "k", "t", al, limit=n).collect())) for n in (100, 1))
    assert one == many and len(one) == 2


def test_alias_pattern():
    import re

    for alias, text, hit in (("GPQA", "the GPQA set", True), ("GPQA", "the gpqa set", False), ("Foo Bar", "foo \n bar", True), ("Foo-Bar", "foo – bar", True), ("Foo Bar", "foo-bar", False), ("C++", "in C++.", True), ("abc", "xabc", False), ("abc", "abc1", False), ("Arc", "ARC", True)):
        assert bool(re.search(alias_pattern(alias), text)) is hit, alias
    assert not re.search(alias_pattern("Swing", cased=("Swing",)), "a swing")
    assert snippet("abcdefghij", 4, 5, 2) == "...cdefg..." and snippet("abc", 0, 3, 5) == "abc"


def test_fragments_are_whole(spark):
    """Fragments that begin alike are kept apart, unless fewer characters are to be compared."""
    long = "x" * 300
    page = f"<p>{long}</p><script>{long}1</script><script>{long}2</script><script>{long}2</script>"
    df = spark.createDataFrame([(1, page), (2, None)], "p int, h string")
    assert pages.page_fragments(df, "p", "h").where("source_kind = 'script_text'").count() == 2
    assert pages.page_fragments(df, "p", "h", compared=200).where("source_kind = 'script_text'").count() == 1


@pytest.mark.parametrize("share", [0.03, 0.2, 0.5, 1.0, 1 / 3])
def test_heavy_by_ranks(spark, share):
    """The selected ranks hit every key that has the share, at the very bound too, and no other key comes out."""
    rng = random.Random(7)
    rows = [(rng.choice([None, "a", "a", "b", *[f"k{i}" for i in range(40)]]),) for _ in range(1500)] + [("exact",)] * 300
    for part in (rows, [("exact",)] * 3 + [(f"x{i}",) for i in range(97)], [("one",)], [(None,)], []):
        df = spark.createDataFrame(part, "k string")
        got = {r.key: (r.n, r.total) for r in keyfigures.heavy_by_ranks(df, "k", share, bins=8).collect()}
        counts = {k: sum(x == k for (x,) in part) for (k,) in part if k is not None}
        assert got == {k: (n, len(part)) for k, n in counts.items() if n >= keyfigures._ceil(share, len(part))}


def test_select_ranks(spark):
    rng = random.Random(8)
    values = {k: sorted(rng.choice([rng.randrange(-5, 5), rng.randrange(-(2**62), 2**62)]) for _ in range(400)) for k in "ab"}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "key string, v bigint")
    ranks = [(k, r) for k in "ab" for r in (1, 2, 57, 200, 399, 400)]
    assert keyfigures.select_ranks(df, {k: (v[0], v[-1]) for k, v in values.items()}, ranks, 16) == {(k, r): values[k][r - 1] for k, r in ranks}
