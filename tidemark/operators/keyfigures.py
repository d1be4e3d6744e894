"""Per-key figures where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.sizes import heavy_keys
from tidemark.session import written

#: Keys with this share of the rows or more get their quantiles by refined histograms; fewer where there are many tasks, so that no other key fills one.
HOT_SHARE = 0.002
#: Bins into which an interval is split in a pass.
BINS = 256


def key_figures(df: DataFrame, key: str, member: str, value: str) -> DataFrame:
    """(key, n, members, first, last): rows, distinct non-null members, least and greatest value of each non-null key.

    Rows are merged by key and member before they meet by key, so that a hot key is spread over its members and each
    task sends at most one row per pair. Repeated rows count; drop them before. Null members and values are skipped.
    """
    rows = df.select(F.col(key).alias("key"), F.col(member).alias("member"), F.col(value).alias("value")).where(F.col("key").isNotNull())
    pairs = rows.groupBy("key", "member").agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
    return pairs.groupBy("key").agg(F.sum("n").alias("n"), F.count("member").alias("members"), F.min("first").alias("first"), F.max("last").alias("last"))


def _as_long(c: str, kind: T.DataType):
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(c).cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return F.col(c).cast("bigint")
    raise TypeError(f"quantiles need whole numbers, dates or timestamps, not {kind.simpleString()}")


def _from_long(c: str, kind: T.DataType):
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.col(c).cast("int"))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.timestamp_micros(F.col(c)).cast(kind)
    return F.col(c).cast(kind)


def key_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float] = (0.5,), hot_share: float | None = None, bins: int = BINS) -> DataFrame:
    """(key, prob, value): the exact discrete quantiles of each non-null key, the least value whose rank reaches prob.

    Null values have no rank; a key without values gives no row. Ties and repeated rows each keep their rank.
    Keys below hot_share of the rows (by default HOT_SHARE, or half a task's share where that is less) are counted by value, and the values are
    taken in order with running counts, which spill and hold no key in memory. For the others, at most 1/hot_share keys, an interval is
    kept per key and prob that holds the quantile; each pass counts the values of its bins, merged before they
    are shuffled, and narrows it to the bin of the sought rank, until one value is left. A pass moves at most
    `bins` counts per interval and task and never a hot key's values; dates take two passes, timestamps a few more (select_ranks).
    """
    if not probs or not all(0 <= p <= 1 for p in probs):
        raise ValueError("probs must be between 0 and 1")
    spark, kind = df.sparkSession, df.schema[value].dataType
    # two narrow columns, written once, as every pass reads them
    rows = written(df.select(F.col(key).alias("key"), _as_long(value, kind).alias("v")).where("key is not null and v is not null"), "quantiles")
    if hot_share is None:
        hot_share = min(HOT_SHARE, 0.5 / int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = [r.key for r in heavy_keys(rows, "key", hot_share).select("key").collect()]
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    counted = rows.where(~is_hot).groupBy("key", "v").agg(F.count("*").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("v")))
    # the value whose ranks, upto - n + 1 to upto of all, hold the least rank that reaches prob
    upto = upto.withColumn("all", F.sum("n").over(Window.partitionBy("key").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(str(p)).cast("decimal(20,18)") * F.col("all")).cast("bigint"))
    hits = F.array_compact(F.array(*[F.when((F.col("upto") - F.col("n") < rank(p)) & (rank(p) <= F.col("upto")), F.lit(float(p))) for p in probs]))
    out = upto.select("key", F.explode(hits).alias("prob"), "v")
    if hot:
        out = out.unionByName(_refined(spark, rows.where(is_hot), probs, bins))
    return out.select("key", "prob", _from_long("v", kind).alias("value"))


def _refined(spark, rows: DataFrame, probs: Sequence[float], bins: int) -> DataFrame:
    key_type = dict(rows.dtypes)["key"]
    spans = {r.key: (r.n, r.lo, r.hi) for r in rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}  # one row per hot key
    ranks = {(k, max(1, _ceil(p, n))) for k, (n, _, _) in spans.items() for p in probs}
    found = select_ranks(rows, {k: (lo, hi) for k, (_, lo, hi) in spans.items()}, ranks, bins)
    out = [(k, float(p), found[k, max(1, _ceil(p, n))]) for k, (n, _, _) in spans.items() for p in probs]
    return spark.createDataFrame(out, f"key {key_type}, prob double, v bigint")


def select_ranks(rows: DataFrame, spans: dict, ranks: Iterable[tuple], bins: int = BINS) -> dict:
    """{(key, rank): the value of that rank, from 1, among the values v of its key}, for rows (key, v bigint), spans {key: (least v, greatest v)} and few (key, rank).

    Distributed exact selection: an interval that holds the value is kept for each rank. A pass counts the values in the bins of all intervals, with the least and the greatest
    of each bin, merged before they are shuffled; the bin that the rank falls into, cut to these, is the next interval, until it holds one value. A pass sends at most bins rows
    for an interval, and never the values of a key.
    """
    spark, key_type = rows.sparkSession, dict(rows.dtypes)["key"]
    wide = lambda lo, hi: max(1, -(-(hi - lo + 1) // bins))
    state = {(k, r): (*spans[k], r, None) for k, r in set(ranks)}  # interval, rank in it, and the bin of the first pass in which it lies
    first = spark.createDataFrame([(k, lo, wide(lo, hi)) for k, (lo, hi) in spans.items()], f"key {key_type}, lo0 bigint, width0 bigint")
    rows = rows.join(F.broadcast(first), "key").withColumn("b0", F.expr("(v - lo0) div width0")).select("key", "v", "b0")
    while any(lo < hi for lo, hi, _, _ in state.values()):
        at = sorted({(k, b0, lo, hi, wide(lo, hi)) for (k, _), (lo, hi, _, b0) in state.items() if lo < hi}, key=repr)
        if all(b0 is None for _, b0, _, _, _ in at):
            table = spark.createDataFrame([(k, lo, hi, w) for k, _, lo, hi, w in at], f"key {key_type}, lo bigint, hi bigint, width bigint")
            inside = rows.join(F.broadcast(table), "key")
        else:  # each interval lies in one bin of the first pass, so a row meets few
            table = spark.createDataFrame(at, f"key {key_type}, b0 bigint, lo bigint, hi bigint, width bigint")
            inside = rows.join(F.broadcast(table), ["key", "b0"])
        counts = inside.where("v between lo and hi").groupBy("key", "lo", "hi", F.expr("(v - lo) div width").alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()  # bounded: intervals x bins
        held: dict = {}
        for r in sorted(counts, key=lambda r: r.bin):
            held.setdefault((r.key, r.lo, r.hi), []).append(r)
        for (k, rank), (lo, hi, left, b0) in list(state.items()):
            if lo < hi:
                for r in held[k, lo, hi]:
                    if left <= r.n:
                        break
                    left -= r.n
                state[k, rank] = (r.least, r.most, left, r.bin if b0 is None else b0)
    return {x: lo for x, (lo, _, _, _) in state.items()}


def heavy_by_ranks(df: DataFrame, key: str, share: float, bins: int = 4096) -> DataFrame:
    """(key, n, total): the keys that hold at least `share` of all rows of df, by exact selection. Rows with a null key count in the total only; an empty df gives no rows.

    Sorted by a hash of their key, the rows of such a key are a run of at least least = share * total ranks, so one of the ranks least, 2 * least, 3 * least... lies in it. The
    values of these ranks, at most 1/share, are selected by refined histograms (select_ranks), and the keys that have them are counted.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    rows = df.select(F.col(key).alias("key"), F.shiftrightunsigned(F.xxhash64(key), 1).alias("v"))
    some = F.col("key").isNotNull()
    (r,) = rows.agg(F.count("*").alias("total"), F.count("key").alias("n"), F.min(F.when(some, F.col("v"))).alias("lo"), F.max(F.when(some, F.col("v"))).alias("hi")).collect()
    least = max(1, _ceil(share, r.total))
    ranks = range(least, r.n + 1, least)
    out = f"key {dict(rows.dtypes)['key']}, n bigint, total bigint"
    if not ranks:
        return df.sparkSession.createDataFrame([], out)
    found = select_ranks(rows.where(some).select(F.lit(0).alias("key"), "v"), {0: (r.lo, r.hi)}, [(0, x) for x in ranks], bins)
    kept = rows.where(some & F.col("v").isin(sorted(set(found.values()))))
    return kept.groupBy("key").agg(F.count("*").alias("n")).withColumn("total", F.lit(r.total).cast("bigint")).where(F.col("n") >= least)


def _ceil(p: float, n: int) -> int:
    """The least rank r with r/n >= p, p as it is written."""
    return int(-(-Fraction(str(p)) * n // 1))
