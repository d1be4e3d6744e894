"""Pairs of names that look like the same entity written twice."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import edit_name, name_tokens

#: The ratio above which two names are near duplicates, and the least length of a contained name.
RATIO, CONTAINED = 0.92, 7


def most_edits(a: int, b: int, ratio: float) -> int:
    """Insertions and deletions that strings of these lengths may differ by if their matching ratio exceeds `ratio`."""
    bound = (1 - ratio) * (a + b)
    return max(0, int(bound) - (bound == int(bound)))


def _segments(n: int, k: int) -> list[tuple[int, int]]:
    """k even parts of a string of length n: (start, length)."""
    base, more = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = base + (i >= k - more)
        out.append((at, size))
        at += size
    return out


def _signatures(ratio: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, s in zip(b["id"], b["s"], strict=True):
                n = len(s)
                top = int(n * (1 + (2 - 2 * ratio) / ratio)) + 1
                for other in range(n, top + 1):  # s is the shorter
                    d = most_edits(n, other, ratio)
                    if other - n <= d:
                        out += [(False, f"{n} {other} {k} {s[a : a + size]}", i) for k, (a, size) in enumerate(_segments(n, min(d + 1, n)))]
                for other in range(max(1, int(n / (1 + (2 - 2 * ratio) / ratio)) - 1), n + 1):  # s is the longer
                    d = most_edits(other, n, ratio)
                    if n - other <= d:
                        for k, (a, size) in enumerate(_segments(other, min(d + 1, other))):
                            out += [(True, f"{other} {n} {k} {s[x : x + size]}", i) for x in range(max(0, a - d), min(n - size, a + d) + 1)]
            yield pd.DataFrame(out, columns=["longer", "sig", "id"])

    return run


@F.pandas_udf(T.DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Ratcliff-Obershelp ratio of two strings."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def near_duplicates(names: DataFrame, ratio: float = RATIO, contained: int = CONTAINED) -> DataFrame:
    """(id_a, name_a, id_b, name_b, ratio), id_a < id_b: pairs of names (id, name) whose plain letters match by more than `ratio`, or of which the one of
    fewer letters, `contained` at least, stands in the other as whole words.

    Candidates share a part: names that differ in at most d insertions and deletions share one of d + 1 parts of the shorter, shifted by d at most;
    a contained name equals a run of the other's words. No other pairs are looked at. Null and letterless names match nothing.
    """
    n = names.select("id", "name", edit_name(F.col("name")).alias("s"), name_tokens(F.col("name")).alias("w")).where("s <> ''").dropDuplicates(["id", "name"])
    sig = n.select("id", "s").mapInPandas(_signatures(ratio), f"longer boolean, sig string, id {dict(names.dtypes)['id']}").distinct()
    close = sig.where("not longer").select("sig", F.col("id").alias("x")).join(sig.where("longer").select("sig", F.col("id").alias("y")), "sig").where("x <> y").select("x", "y")
    runs = n.select("id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("a")).select("id", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("a") + 1)).alias("len"))
    runs = runs.select(F.col("id").alias("y"), F.array_join(F.slice("w", F.col("a"), F.col("len")), " ").alias("run"), F.col("len"), F.size("w").alias("all")).where("len < all").distinct()
    whole = n.where(F.length("s") >= contained).select(F.col("id").alias("x"), F.array_join("w", " ").alias("run"))
    inside = whole.join(runs, "run").where("x <> y").select("x", "y")
    pairs = close.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    a, b = (n.select(F.col("id").alias(f"id_{k}"), F.col("name").alias(f"name_{k}"), F.col("s").alias(f"s_{k}"), F.array_join("w", " ").alias(f"w_{k}")) for k in "ab")
    full = pairs.join(a, "id_a").join(b, "id_b").withColumn("ratio", match_ratio("s_a", "s_b"))
    short, long = F.when(F.length("s_a") <= F.length("s_b"), F.col("w_a")).otherwise(F.col("w_b")), F.when(F.length("s_a") <= F.length("s_b"), F.col("w_b")).otherwise(F.col("w_a"))
    holds = (F.length(F.replace(short, F.lit(" "), F.lit(""))) >= contained) & (short != long) & F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))
    return full.where((F.col("ratio") > ratio) | holds).select("id_a", "name_a", "id_b", "name_b", F.round("ratio", 6).alias("ratio"))
