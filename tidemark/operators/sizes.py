"""Joins whose broadcast side is measured first, with another way beyond the bound."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast side may have; they are counted before it is broadcast.
BROADCAST_ROWS = 100_000


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; counting ends one row beyond."""
    return df.limit(rows + 1).count() <= rows


def heavy_keys(df: DataFrame, key: str, share: float, bins: int = 4096, level: str = "n") -> DataFrame:
    """Keys that hold at least `share` of all rows of df, with their exact number of rows and the total:
    (key, n, total). A row with a null key counts in the total only; an empty df gives no rows.

    Exact selection by refined histograms: the rows are counted by a hash of their key, only bins that
    reach the share are split again by another hash, and the keys of the last bins are counted themselves.
    Counts are merged before each shuffle, so a pass moves at most `bins` counts a task, however many rows a
    key or how many keys the table has. At most 1/share bins survive a pass, which bounds what is broadcast.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    spark, s = df.sparkSession, F.lit(Decimal(str(share)))
    rows = df.select(F.col(key).alias("key")).withColumn("h", F.xxhash64("key"))
    rows = rows.withColumn("b1", F.when(F.col("key").isNotNull(), F.pmod("h", F.lit(bins))))
    rows = rows.withColumn("b2", F.pmod(F.shiftrightunsigned("h", 32), F.lit(bins)))
    first = rows.groupBy("b1").agg(F.count("*").alias("n")).collect()  # at most bins + 1 rows
    total = sum(r.n for r in first)
    least = Decimal(str(share)) * total
    kept = [(r.b1,) for r in first if r.b1 is not None and r.n >= least]
    out = "key string, n bigint, total bigint".replace("string", dict(rows.dtypes)["key"])
    if not kept:
        return spark.createDataFrame([], out)
    rows = rows.where(F.col("b1").isin([b for (b,) in kept]))
    second = [(r.b1, r.b2) for r in rows.groupBy("b1", "b2").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(least)).collect()]
    if not second:
        return spark.createDataFrame([], out)
    rows = rows.where(F.struct("b1", "b2").isin([F.struct(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")) for a, b in second]))
    return rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("total", F.lit(total).cast("bigint")).where(F.col("n") >= s * F.col("total"))


def lookup_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", limit: int = BROADCAST_ROWS, share: float = 0.001, check: bool = False) -> DataFrame:
    """rows joined to `side`, which has one row per key; how: inner or left.

    Up to `limit` rows, counted first, `side` is broadcast. Beyond it, the keys that hold at least `share` of the
    rows (at most 1/share keys) get their part of `side` broadcast, and only the rest, in which no key is
    large, is shuffled by key; so no task gets the rows of a hot key. Null keys match nothing. check: raises where `side` has a key twice, instead of trusting it.
    """
    if check and (twice := side.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").first()) is not None:
        raise ValueError(f"{key} {twice[0]!r} stands {twice.n} times in a table that should have it once")
    if at_most(side, limit):
        return rows.join(F.broadcast(side), key, how)
    hot = [r.key for r in heavy_keys(rows, key, share).select("key").collect()]
    if not hot:
        return rows.join(side, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    light, null = rows.where(~is_hot & F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    out = rows.where(is_hot).join(F.broadcast(side.where(is_hot)), key, how).unionByName(light.join(side.where(~is_hot), key, how))
    if how == "left":
        extra = [F.lit(None).cast(t).alias(c) for c, t in side.dtypes if c != key]
        out = out.unionByName(null.select("*", *extra))
    return out
