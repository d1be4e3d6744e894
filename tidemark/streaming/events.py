"""Event streams: the same windows for tables and for streams. An extension; the batch forms are checked by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import load

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): events per window and type; on a stream, events later than `lateness` are dropped."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = rows.where("ts is not null").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no pause of `gap` or more."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    g = rows.where("ts is not null and user_id is not null").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The parquet files that arrive in a folder, so many a trigger."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events and their value per day and type."""
    return windowed(_events(spark, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of every user."""
    s = sessions(_events(spark, d))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Nested values: the key in the JSON of the events, by type."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return load(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.min(k).alias("least"), F.max(k).alias("most"), F.sum(k).alias("total"))


QUERIES = {f.__name__: f for f in (event_windows, event_sessions, event_props)}
SQL = {
    "event_windows": "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') \"start\", event_type, count(*) n, round(sum(\"value\"), 6) total from events where ts is not null group by 1, 2",
    "event_sessions": """with e as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end b from events where ts is not null and user_id is not null window w as (partition by user_id order by ts)),
s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from e)
select user_id, epoch_us(min(ts)) start_us, epoch_us(max(ts) + interval 6 hours) end_us, count(*) n from s group by user_id, k""",
    "event_props": "select event_type, count(k) n, min(k) least, max(k) most, sum(k)::bigint total from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) k from events) group by 1",
}
