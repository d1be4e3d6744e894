"""Trailing calendar windows, moving averages and lanes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.shares import ratio


def rolling_share(events: DataFrame, day: str, category: str, weight: str, cutoff, window_days: int, by: str | None = None) -> DataFrame:
    """(day, category, share): each category's share of the weight in the window of `window_days` days that ends on a day, for every
    day from the first event to the cutoff; null where the window holds no event, and nothing is filled.

    Events are summed by day and category before anything else; what the windows sort is categories times calendar days.
    Null days and categories are skipped; no events give no rows. by: a column of which each value has its own shares and days; it goes before, as `by`.
    """
    if window_days <= 0:
        raise ValueError("window_days must be positive")
    own = ["by"] if by else []
    daily = events.where(F.col(day).isNotNull() & F.col(category).isNotNull() & (F.col(day) <= F.lit(cutoff))).groupBy(*[F.col(by).alias(c) for c in own], F.col(day).alias("day"), F.col(category).alias("category")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    spine = daily.groupBy(*own).agg(F.min("day").alias("lo")).where("lo is not null").select(*own, F.explode(F.sequence("lo", F.lit(cutoff))).alias("day"))
    categories = daily.select(*own, "category").distinct()
    full = (spine.join(categories, own) if own else spine.crossJoin(categories)).join(daily, [*own, "day", "category"], "left")  # days x categories
    span = Window.partitionBy(*own, "category").orderBy(F.unix_date("day")).rangeBetween(-(window_days - 1), 0)
    full = full.select(*own, "day", "category", F.coalesce(F.sum("w").over(span), F.lit(0.0)).alias("w"), F.coalesce(F.sum("n").over(span), F.lit(0)).alias("n"))
    everyone = Window.partitionBy(*own, "day")
    return full.select(*own, "day", "category", F.when(F.sum("n").over(everyone) > 0, ratio(F.col("w"), F.sum("w").over(everyone))).alias("share"))


def moving_ratio(rows: DataFrame, day: str, value: str, cutoff, window_days: int) -> DataFrame:
    """(day, average): the mean of value over the rows of the trailing window; where the window is empty the last one is carried on, and 0 before any."""
    daily = rows.where(F.col(day) <= F.lit(cutoff)).groupBy(F.col(day).alias("day")).agg(F.sum(value).alias("v"), F.count("*").alias("n"))
    spine = daily.agg(F.min("day").alias("lo")).where("lo is not null").select(F.explode(F.sequence("lo", F.lit(cutoff))).alias("day"))
    span = Window.orderBy(F.unix_date("day")).rangeBetween(-(window_days - 1), 0)  # one row a calendar day
    out = spine.join(daily, "day", "left").withColumn("m", ratio(F.sum("v").over(span), F.sum("n").over(span)))
    return out.select("day", F.coalesce(F.last("m", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias("average"))


class _Lanes:
    """Deals out the lanes of one group to entries that come in order of time: lanes that are free lie in one heap by number, the others in one by when they are free."""

    def __init__(self):
        self.free: list[int] = []
        self.taken: list[tuple[float, int]] = []

    def next(self, begin: float, end: float) -> int:
        while self.taken and self.taken[0][0] <= begin:
            heapq.heappush(self.free, heapq.heappop(self.taken)[1])
        lane = heapq.heappop(self.free) if self.free else len(self.taken)
        heapq.heappush(self.taken, (end, lane))
        return lane


def lanes(rows: DataFrame, group: str, day: str, name: str, width: float) -> DataFrame:
    """rows (group, day, name) with the lane of each: in order of day and name, the lane of the least number in its group that is free again
    after the footprint of `width` days around the last entry. Each group is an ordered stream through one task, which keeps only the lanes in use."""
    if width <= 0:
        raise ValueError("width must be positive")
    src = rows.select(F.col(group).alias("grp"), F.col(day).alias("day"), F.col(name).alias("name"), F.unix_date(F.col(day).cast("date")).cast("double").alias("at"))
    t = dict(src.dtypes)
    ordered = src.repartition("grp").sortWithinPartitions("grp", "at", "name")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_lanes = object(), _Lanes()
        for b in batches:
            out = []
            for g, x in zip(b["grp"], b["at"], strict=True):
                if g != now:
                    now, open_lanes = g, _Lanes()
                out.append(open_lanes.next(x - width / 2, x + width / 2))
            yield b[["grp", "day", "name"]].assign(lane=out)

    done = ordered.mapInPandas(deal, f"grp {t['grp']}, day {t['day']}, name {t['name']}, lane bigint")
    return done.select(F.col("grp").alias(group), F.col("day").alias(day), F.col("name").alias(name), "lane")


def isolated_days(shares: DataFrame, day: str, share: str, by: Sequence[str] = ()) -> DataFrame:
    """shares with `isolated`: whether a day has a share and neither the day before nor the day after has one, so that a line would not show it. by: columns of a series."""
    w = Window.partitionBy(*by).orderBy(day) if by else Window.orderBy(day)  # one row a calendar day
    beside = lambda c: c.isNull()
    return shares.withColumn("isolated", F.col(share).isNotNull() & beside(F.lag(share).over(w)) & beside(F.lead(share).over(w)))


def stacked(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """rows with `low` and `high`, where each stands when the values of one group are stacked in this order."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("high", F.sum(value).over(w)).withColumn("low", F.col("high") - F.col(value))
