"""Queries p1, p2 and p5, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import norm_id, norm_name
from tidemark.operators.keyfigures import heavy_by_ranks, key_figures, key_quantiles
from tidemark.operators.listfield import split_list_field
from tidemark.operators.orphans import Child, orphan_counts, orphan_rows
from tidemark.sources.tables import load

#: Share of all mentions from which a benchmark is called heavy.
HEAVY_SHARE = 0.03


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each value of models.benchmarks with its place."""
    return split_list_field(load(spark, d, "models"), "model_row_id", "benchmarks", load(spark, d, "benchmarks"), "benchmark_name")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions once each, ids and providers normalised. Copies of a row are equal in all columns, so they meet by mention_id,
    which spreads them evenly."""
    m = load(spark, d, "mentions").select("mention_id", norm_id("benchmark_id").alias("benchmark_id"), norm_name("provider").alias("provider"), "release_date", "loaded_at")
    return m.dropDuplicates(["mention_id", "benchmark_id", "provider", "release_date"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids with at least 3 percent of all rows of mentions."""
    ids = load(spark, d, "mentions").select(norm_id("benchmark_id").alias("benchmark_id"))
    return heavy_by_ranks(ids, "benchmark_id", HEAVY_SHARE).select(F.col("key").alias("benchmark_id"))


def p2_figures(spark: SparkSession, d: str) -> DataFrame:
    """Per benchmark: mentions, providers, first and last release date, and whether it is heavy."""
    rows = _mentions(spark, d)
    heavy = p2_found(spark, d).withColumn("is_heavy", F.lit(True))
    out = key_figures(rows, "benchmark_id", "provider", "release_date").withColumnRenamed("key", "benchmark_id")
    out = out.join(F.broadcast(heavy), "benchmark_id", "left")  # at most 33 rows
    return out.select("benchmark_id", F.col("n").alias("mentions"), F.col("members").alias("providers"), F.col("first").alias("first_release"), F.col("last").alias("last_release"), F.coalesce("is_heavy", F.lit(False)).alias("is_heavy"))


def p2_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Per benchmark: quartiles of the release date."""
    q = key_quantiles(_mentions(spark, d), "benchmark_id", "release_date", (0.25, 0.5, 0.75))
    return q.select(F.col("key").alias("benchmark_id"), "prob", F.col("value").alias("release_date"))


def _children(spark: SparkSession, d: str) -> list[Child]:
    at = {"mentions": ("mention_id", "loaded_at"), "benchmark_aliases": ("alias_id", "added_at"), "benchmark_facets": ("facet_row_id", "updated_at")}
    return [Child(t, load(spark, d, t), key, norm_id("benchmark_id"), time) for t, (key, time) in at.items()]


def _parents(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "benchmarks").unionByName(load(spark, d, "community_benchmarks"))
    return both.select(norm_id("benchmark_id").alias("key"), F.col("registered_at").alias("since"), F.col("retired_at").alias("until"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose benchmark was in neither catalogue when they were written; each key once."""
    return orphan_rows(_children(spark, d), _parents(spark, d)).select("source_table", "row_key").distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month."""
    return orphan_counts(_children(spark, d), _parents(spark, d)).withColumnRenamed("period", "month")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_figures, p2_quantiles, p5_found, p5_counts)}

_MENTIONS = "select distinct mention_id, nullif(lower(trim(benchmark_id)), '') benchmark_id, lower(trim(regexp_replace(provider, '\\s+', ' ', 'g'))) provider, release_date from mentions"
_HEAVY = "select nullif(lower(trim(benchmark_id)), '') benchmark_id from mentions group by 1 having count(*) * 100 >= 3 * (select count(*) from mentions) and nullif(lower(trim(benchmark_id)), '') is not null"
_ORPHANS = """with c as (
  select lower(trim(benchmark_id)) id, registered_at a, retired_at b from benchmarks union all
  select lower(trim(benchmark_id)), registered_at, retired_at from community_benchmarks),
r as (
  select 'mentions' source_table, mention_id row_key, lower(trim(benchmark_id)) id, loaded_at t from mentions union all
  select 'benchmark_aliases', cast(alias_id as varchar), lower(trim(benchmark_id)), added_at from benchmark_aliases union all
  select 'benchmark_facets', cast(facet_row_id as varchar), lower(trim(benchmark_id)), updated_at from benchmark_facets),
o as (select distinct source_table, row_key, id, cast(date_trunc('month', t) as date) as "month" from r
  where id is not null and not exists (select 1 from c where c.id = r.id and c.a <= r.t and (c.b is null or r.t < c.b)))
"""

SQL = {
    "p2_found": _HEAVY,
    "p2_figures": f"select m.benchmark_id, count(*) mentions, count(distinct provider) providers, min(release_date) first_release, max(release_date) last_release, m.benchmark_id in ({_HEAVY}) is_heavy from ({_MENTIONS}) m where m.benchmark_id is not null group by m.benchmark_id",
    "p2_quantiles": f"select benchmark_id, p.prob, case p.prob when 0.25 then quantile_disc(release_date, 0.25) when 0.5 then quantile_disc(release_date, 0.5) else quantile_disc(release_date, 0.75) end release_date from ({_MENTIONS}) m, (select unnest([0.25::double, 0.5::double, 0.75::double]) prob) p where benchmark_id is not null and release_date is not null group by benchmark_id, p.prob",
    "p5_found": _ORPHANS + "select distinct source_table, row_key from o",
    "p5_counts": _ORPHANS + 'select source_table, "month", count(distinct row_key || \'|\' || id) orphans, count(distinct id) orphan_keys from o group by 1, 2',
}
