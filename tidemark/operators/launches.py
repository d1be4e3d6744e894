"""Announcements, and how benchmarks live through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.url import launch_id, normalize_url
from tidemark.operators.shares import joined, ratio


def with_launch(rows: DataFrame, link: str) -> DataFrame:
    """rows (provider, release_date, link) with source_url and launch_id."""
    rows = rows.withColumn("source_url", normalize_url(link))
    return rows.withColumn("launch_id", launch_id(F.col("provider"), F.col("release_date"), F.col("source_url")))


def launch_events(releases: DataFrame, mentions: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row per announcement (provider, date, address), those without mentions too. found: launch_mentions of the same releases, where they are there already; their rows are
    the benchmarks of each."""
    ids = (launch_mentions(releases, mentions) if found is None else found).groupBy("launch_id").agg(F.count("*").alias("benchmark_count"))
    events = with_launch(releases, "link").groupBy("launch_id", "provider", "release_date", "source_url").agg(joined(F.nullif(F.col("model_name"), F.lit(""))).alias("model_names"), F.count("*").alias("model_row_count"))
    out = events.join(ids, "launch_id", "left").withColumn("benchmark_count", F.coalesce("benchmark_count", F.lit(0)).cast("bigint"))
    return out.withColumn("has_benchmark_mentions", F.col("benchmark_count") > 0)


def launch_mentions(releases: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row per announcement and benchmark, with the releases that mention it."""
    rows = with_launch(releases, "link").select("model_row_id", "launch_id", "source_url", "provider", "release_date", "model_name")
    pairs = mentions.select("model_row_id", "benchmark_id").distinct().join(rows, "model_row_id")
    return pairs.groupBy("benchmark_id", "launch_id", "provider", "release_date", "source_url").agg(joined(F.nullif(F.col("model_name"), F.lit(""))).alias("model_names"), F.count("*").alias("model_row_count"))


def provider_lifecycles(events: DataFrame, mentions: DataFrame, cutoff) -> DataFrame:
    """How each adopter of a benchmark went on: per (benchmark_id, provider) with a mention.

    Launches later than a date are counted from each provider's running total by date, so nothing is joined by inequality; order
    within a day is unknown, so only other days count.
    """
    w = Window.partitionBy("provider").orderBy("release_date")
    days = events.groupBy("provider", "release_date").agg(F.count("*").alias("n"))
    days = days.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.coalesce(F.lag("upto").over(w), F.lit(0)))
    days = days.withColumn("all", F.sum("n").over(Window.partitionBy("provider"))).drop("n")
    daily = mentions.groupBy("benchmark_id", "provider", "release_date").agg(F.count("*").alias("launches"), F.sum("model_row_count").alias("rows")).join(days, ["provider", "release_date"])
    v = Window.partitionBy("benchmark_id", "provider").orderBy("release_date")
    daily = daily.withColumn("gap", F.col("before") - F.lag("upto").over(v)).withColumn("first", F.min("release_date").over(Window.partitionBy("benchmark_id", "provider")))
    out = daily.groupBy("benchmark_id", "provider").agg(
        F.min("release_date").alias("first_seen"), F.max("release_date").alias("last_seen"),
        F.sum("launches").alias("launch_count"), F.sum("rows").alias("model_row_count"),
        (F.max("all") - F.min("upto")).alias("followup_launches"),
        F.coalesce(F.sum(F.when(F.col("release_date") > F.col("first"), F.col("launches"))), F.lit(0)).alias("followup_mention_launches"),
        (F.max("all") - F.max("upto")).alias("launches_after_last_seen"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("largest_gap_launches"),
    )
    return out.select(
        "benchmark_id", "provider", "first_seen", "last_seen", F.datediff("last_seen", "first_seen").cast("bigint").alias("observed_span_days"),
        "launch_count", "model_row_count", "followup_launches", "followup_mention_launches",
        ratio(F.col("followup_mention_launches"), F.col("followup_launches")).alias("followup_mention_share"),
        "launches_after_last_seen", F.datediff(F.lit(cutoff), "last_seen").cast("bigint").alias("days_since_last_seen"), "largest_gap_launches",
    )


def launch_calendar(events: DataFrame, cutoff) -> DataFrame:
    """(c_provider, day, later): for every day from a provider's first launch to the cutoff, its launches on later days. Providers
    times calendar days, so that a date is looked up by equality."""
    days = events.groupBy("provider", "release_date").agg(F.count("*").alias("n"))
    spine = days.groupBy("provider").agg(F.min("release_date").alias("lo")).select(F.col("provider").alias("c_provider"), F.explode(F.sequence("lo", F.lit(cutoff))).alias("day"))
    full = spine.join(days, (F.col("c_provider") == F.col("provider")) & (F.col("day") == F.col("release_date")), "left")
    back = Window.partitionBy("c_provider").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    return full.select("c_provider", "day", F.coalesce(F.sum("n").over(back), F.lit(0)).alias("later"))


def lifecycles(catalogue: DataFrame, providers: DataFrame, events: DataFrame, mentions: DataFrame, cutoff, window_days: int = 180) -> DataFrame:
    """One row per catalogue entry, observed or not: pattern, spans, adoption lags, recent launches and follow-up. providers:
    provider_lifecycles of the same launches."""
    if isinstance(window_days, bool) or window_days <= 0:
        raise ValueError("window_days must be a positive integer")
    order = Window.partitionBy("benchmark_id").orderBy("first_seen", "provider")
    p = providers.withColumn("nth", F.row_number().over(order)).withColumn("start", F.min("first_seen").over(Window.partitionBy("benchmark_id"))).withColumn("end", F.max("last_seen").over(Window.partitionBy("benchmark_id")))
    after = p.join(launch_calendar(events, cutoff), (p.provider == F.col("c_provider")) & (p.end == F.col("day"))).groupBy("benchmark_id").agg(F.sum("later").alias("after"))
    agg = p.groupBy("benchmark_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("launch_count").alias("launch_count"), F.sum("model_row_count").alias("model_row_count"),
        F.count("*").alias("provider_count"), joined(F.when(F.col("first_seen") == F.col("start"), F.col("provider"))).alias("first_providers"),
        F.max(F.when(F.col("nth") == 2, F.col("first_seen"))).alias("second_provider_date"), F.max(F.when(F.col("nth") == 3, F.col("first_seen"))).alias("third_provider_date"),
        F.sum("followup_launches").alias("adopter_followup_launches"), F.sum("followup_mention_launches").alias("adopter_followup_mention_launches"),
        F.max("largest_gap_launches").alias("largest_within_provider_gap_launches"),
    )
    recent = mentions.where(F.col("release_date") >= F.date_sub(F.lit(cutoff), window_days - 1)).groupBy("benchmark_id").agg(F.count("*").alias("recent"))
    full = catalogue.select("benchmark_id", "benchmark_name", "review_status").join(agg, "benchmark_id", "left").join(recent, "benchmark_id", "left").join(after, "benchmark_id", "left")
    seen = F.col("launch_count").isNotNull()
    pattern = F.when(~seen, "unobserved").when(F.col("provider_count") > 1, "shared_across_providers").when(F.col("launch_count") == 1, "single_launch").otherwise("repeated_one_provider")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    days = lambda a, b: F.datediff(a, b).cast("bigint")
    return full.select(
        "benchmark_id", "benchmark_name", "review_status", pattern.alias("reporting_pattern"), "first_seen", "last_seen",
        days("last_seen", "first_seen").alias("observed_span_days"), days(F.lit(cutoff), F.col("last_seen")).alias("days_since_last_seen"),
        zero("launch_count"), zero("model_row_count"), zero("provider_count"), F.coalesce("first_providers", F.lit("")).alias("first_providers"),
        "second_provider_date", days("second_provider_date", "first_seen").alias("second_provider_lag_days"),
        "third_provider_date", days("third_provider_date", "first_seen").alias("third_provider_lag_days"),
        F.coalesce("recent", F.lit(0)).cast("bigint").alias("recent_launch_count"),
        "adopter_followup_launches", "adopter_followup_mention_launches", ratio(F.col("adopter_followup_mention_launches"), F.col("adopter_followup_launches")).alias("followup_mention_share"),
        F.when(seen, F.coalesce("after", F.lit(0))).alias("adopter_launches_after_last_seen"), "largest_within_provider_gap_launches",
    )
