"""Inventories, announcements, lifecycles, sharing, diffusion and interaction: R1 to R16, R72."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import launches
from tidemark.operators.shares import dedup_mentions, joined, ratio
from tidemark.plans import base
from tidemark.plans.base import CUT, LAUNCHES, LIFE, VIEWS
from tidemark.session import written

#: Labels of interaction_pattern that count as acting on something.
POSITIVE = ("environment", "tool_use")
HORIZONS = (30, 90, 180)
VARIANTS = ("all_active", "confidence_ge_0_7", "accepted")


@base.scoped
def provider_year_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions per provider and year."""
    return base.mentions(spark, d).groupBy("provider", "release_year").agg(F.count("*").alias("mentions"))


@base.scoped
def top_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    """R2: per benchmark its mentions, providers, first and last date, and author."""
    agg = base.mentions(spark, d).groupBy("benchmark_id", "provider").agg(F.count("*").alias("n"), F.min("release_date").alias("a"), F.max("release_date").alias("b"))
    agg = agg.groupBy("benchmark_id").agg(F.sum("n").alias("mentions"), F.count("*").alias("providers"), F.min("a").alias("first_release"), F.max("b").alias("last_release"))
    return agg.join(base.catalogue(spark, d).select("benchmark_id", "benchmark_name", "source_author"), "benchmark_id")


@base.scoped
def provider_year_task_mix(spark: SparkSession, d: str) -> DataFrame:
    """Mentions by task mode, and their share in the provider's year."""
    m = base.mentions(spark, d).groupBy("benchmark_id", "provider", "release_year").agg(F.count("*").alias("mentions")).join(base.catalogue(spark, d), "benchmark_id", "left")
    m = m.groupBy("provider", "release_year", F.coalesce("legacy_task_mode", F.lit("")).alias("task_mode")).agg(F.sum("mentions").alias("mentions"))
    return m.withColumn("share", ratio(F.col("mentions"), F.sum("mentions").over(Window.partitionBy("provider", "release_year"))))


@base.scoped
def facet_review_debt(spark: SparkSession, d: str) -> DataFrame:
    """Per axis its rows by status, and the shares below 0.7 and in review."""
    f = base.facets(spark, d, active=False)
    is_ = lambda s: F.count_if(F.col("review_status") == s)
    out = f.groupBy("facet_axis").agg(F.count("*").alias("facet_rows"), is_("accepted").alias("accepted"), is_("needs_review").alias("needs_review"), is_("legacy_seed").alias("legacy_seed"), is_("disputed").alias("disputed"), is_("deprecated").alias("deprecated"), F.count_if(F.col("confidence") < 0.7).alias("low_confidence"))
    return out.withColumn("low_confidence_share", ratio(F.col("low_confidence"), F.col("facet_rows"))).withColumn("review_share", ratio(F.col("needs_review") + F.col("disputed"), F.col("facet_rows")))


@base.scoped
def launch_events(spark: SparkSession, d: str) -> DataFrame:
    """Announcements."""
    return launches.launch_events(base.releases(spark, d), base.mentions(spark, d))


@base.scoped
def launch_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Announcements by benchmark."""
    return launches.launch_mentions(base.releases(spark, d), base.mentions(spark, d))


def _launches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Announcements, and announcements by benchmark, made once for all that reads them."""
    found = written(launch_mentions(spark, d), "launches")
    return written(launches.launch_events(base.releases(spark, d), base.mentions(spark, d), found), "launches"), found


@base.scoped
def provider_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """R8, the adopters: pairs without a mention follow from the catalogue and the list of providers and hold only zeros."""
    return launches.provider_lifecycles(*_launches(spark, d), base.cutoff(spark, d))


@base.scoped
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Every catalogue entry through its announcements."""
    ev, lm = _launches(spark, d)
    adopters = written(launches.provider_lifecycles(ev, lm, base.cutoff(spark, d)), "adopters")
    return launches.lifecycles(base.catalogue(spark, d), adopters, ev, lm, base.cutoff(spark, d))


@base.scoped
def coverage_by_provider(spark: SparkSession, d: str) -> DataFrame:
    """Inventory of each provider."""
    events, found = _launches(spark, d)
    ev = events.groupBy("provider").agg(F.sum("model_row_count").alias("model_rows"), F.count("*").alias("launch_events"), F.count_if("has_benchmark_mentions").alias("benchmark_bearing_launches"), F.min("release_date").alias("first_release"), F.max("release_date").alias("last_release"))
    ids = found.select("provider", "benchmark_id").distinct().groupBy("provider").agg(F.count("*").alias("n"))
    return ev.join(ids, "provider", "left").withColumn("observed_benchmarks", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")


@base.scoped
def annual_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Inventory of each year, with benchmarks first seen in it."""
    year = lambda c: F.year(c).cast("bigint").alias("release_year")
    events, lm = _launches(spark, d)
    ev = events.groupBy(year("release_date")).agg(F.sum("model_row_count").alias("model_rows"), F.count("*").alias("launch_events"), F.count_if("has_benchmark_mentions").alias("benchmark_bearing_launches"))
    ms = lm.groupBy(year("release_date")).agg(F.count("*").alias("launch_mentions"))
    new = lm.groupBy("benchmark_id").agg(F.min("release_date").alias("f")).groupBy(year("f")).agg(F.count("*").alias("new_identities"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return ev.join(ms, "release_year", "left").join(new, "release_year", "left").select("release_year", "model_rows", "launch_events", "benchmark_bearing_launches", zero("launch_mentions"), zero("new_identities"))


def _weighted(lm: DataFrame) -> DataFrame:
    return lm.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("launch_id")))


@base.scoped
def sharing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Benchmarks, mentions and equal-announcement weight by the number of providers that share a benchmark; every number from 1 to all."""
    lm = _weighted(launch_mentions(spark, d))
    per = lm.groupBy("benchmark_id", "provider").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).groupBy("benchmark_id").agg(F.count("*").alias("provider_count"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    bins = per.groupBy("provider_count").agg(F.count("*").alias("b"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    total = bins.agg(F.sum("b").alias("tb"), F.sum("n").alias("tn"), F.sum("w").alias("tw"))
    spine = base.releases(spark, d).agg(F.count_distinct("provider").alias("p")).select(F.explode(F.sequence(F.lit(1).cast("bigint"), "p")).alias("provider_count"))
    out = spine.join(bins, "provider_count", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "provider_count", zero("b").cast("bigint").alias("benchmark_count"), ratio(zero("b"), F.col("tb")).alias("benchmark_share"), zero("n").cast("bigint").alias("launch_mentions"), ratio(zero("n"), F.col("tn")).alias("mention_share"),
        F.round(F.coalesce("w", F.lit(0.0)), 6).alias("announcement_weight"), ratio(F.coalesce("w", F.lit(0.0)), F.col("tw")).alias("announcement_weight_share"),
    )


@base.scoped
def diffusion_horizons(spark: SparkSession, d: str) -> DataFrame:
    """Of the benchmarks that could be followed for a horizon, those that reached a second provider within it."""
    end = base.releases(spark, d).agg(F.least(F.max("release_date"), F.lit(base.cutoff(spark, d))).alias("end"))
    life = lifecycle(spark, d).where("launch_count > 0").crossJoin(F.broadcast(end))  # one row
    rows = life.select("first_seen", "second_provider_lag_days", "end", F.explode(F.array(*map(F.lit, HORIZONS))).alias("h"))
    ok = F.col("first_seen") <= F.date_sub("end", F.col("h"))
    out = rows.groupBy(F.col("h").cast("bigint").alias("horizon_days")).agg(F.count_if(ok).alias("eligible_benchmarks"), F.count_if(ok & (F.col("second_provider_lag_days") <= F.col("h"))).alias("diffused_benchmarks"))
    return out.withColumn("diffusion_share", ratio(F.col("diffused_benchmarks"), F.col("eligible_benchmarks")))


@base.scoped
def interaction_classification(spark: SparkSession, d: str) -> DataFrame:
    """Each catalogue entry by three readings of its interaction labels; positive is null where there is no label."""
    f = base.facets(spark, d).where("facet_axis = 'interaction_pattern'")
    keep = F.when(F.col("variant") == "all_active", True).when(F.col("variant") == "accepted", F.col("review_status") == "accepted").otherwise(F.col("confidence") >= 0.7)
    variants = F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant")
    labels = f.select("*", variants).where(keep).groupBy("benchmark_id", "variant").agg(joined("facet_label").alias("interaction_labels"), F.bool_or(F.col("facet_label").isin(*POSITIVE)).alias("positive"))
    out = base.catalogue(spark, d).select("benchmark_id", "benchmark_name", variants).join(labels, ["benchmark_id", "variant"], "left")
    return out.select("benchmark_id", "benchmark_name", "variant", F.coalesce("interaction_labels", F.lit("")).alias("interaction_labels"), "positive", F.col("positive").isNotNull().alias("covered"))


def _trends(spark: SparkSession, d: str, by_provider: bool) -> DataFrame:
    by = ["provider"] if by_provider else []
    year = F.year("release_date").cast("bigint").alias("release_year")
    lm = _weighted(launch_mentions(spark, d)).select(F.lit("announcement").alias("unit"), F.col("launch_id").alias("unit_id"), "provider", year, "benchmark_id", "weight")
    rows = dedup_mentions(base.mentions(spark, d)).select(F.lit("model_row").alias("unit"), F.col("model_row_id").cast("string").alias("unit_id"), "provider", year, "benchmark_id", F.col("release_weight").alias("weight"))
    obs = lm.unionByName(rows)
    units = obs.select("unit", "release_year", *by, "unit_id").distinct().groupBy("unit", "release_year", *by).agg(F.count("*").alias("n"))
    years = base.releases(spark, d).select(year, *([F.col("provider")] if by_provider else [])).distinct()
    if by_provider:
        years = years.select("release_year").distinct().crossJoin(F.broadcast(years.select("provider").distinct()))  # years x providers
    spine = years.select("*", F.explode(F.array(F.lit("announcement"), F.lit("model_row"))).alias("unit")).select("*", F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant"))
    summed = obs.groupBy("unit", "release_year", *by, "benchmark_id").agg(F.sum("weight").alias("weight"))
    c = interaction_classification(spark, d).where("covered").select("benchmark_id", "variant", "positive")
    hits = summed.join(c, "benchmark_id").groupBy("unit", "release_year", *by, "variant").agg(F.sum("weight").alias("c"), F.sum(F.when(F.col("positive"), F.col("weight")).otherwise(0.0)).alias("p"))
    out = spine.join(units, ["unit", "release_year", *by], "left").join(hits, ["unit", "release_year", *by, "variant"], "left").na.fill(0.0, ["c", "p"]).na.fill(0, ["n"])
    return out.select("unit", "release_year", *by, "variant", F.col("n").alias("benchmark_bearing_units"), ratio(F.col("p"), F.col("n")).alias("positive_share"), ratio(F.col("c"), F.col("n")).alias("coverage_share"), ratio(F.col("p"), F.round("c", 9)).alias("positive_share_among_covered"))


@base.scoped
def interaction_trends(spark: SparkSession, d: str) -> DataFrame:
    """Shares of acting benchmarks by year, for announcements and releases as units."""
    return _trends(spark, d, False)


@base.scoped
def provider_interaction_trends(spark: SparkSession, d: str) -> DataFrame:
    """The same by provider."""
    return _trends(spark, d, True)


@base.scoped
def overview_summary(spark: SparkSession, d: str) -> DataFrame:
    """The scalars of the overview."""
    life, lm, ev = lifecycle(spark, d), launch_mentions(spark, d), launch_events(spark, d)
    seen, shared = F.col("launch_count") > 0, F.col("provider_count") > 1
    a = life.agg(F.count("*").alias("catalog_benchmarks"), F.count_if(seen).alias("observed_benchmarks"), F.count_if(F.col("launch_count") == 1).alias("single_launch_benchmarks"), F.count_if(shared).alias("shared_benchmarks"), F.median(F.when(shared, F.col("second_provider_lag_days"))).alias("shared_conditional_median_lag_days"))
    b = ev.agg(F.sum("model_row_count").alias("model_rows"), F.count("*").alias("launch_events"), F.count_if("has_benchmark_mentions").alias("benchmark_bearing_launches"), F.max(F.year("release_date")).cast("bigint").alias("latest_release_year"))
    c = lm.agg(F.count("*").alias("launch_mentions"))
    m = base.mentions(spark, d).agg(F.count("*").alias("raw_model_mentions"), F.count_distinct("model_row_id", "benchmark_id").alias("canonical_model_mentions"))
    return a.crossJoin(b).crossJoin(c).crossJoin(m)  # one row each


QUERIES = {f.__name__: f for f in (
    provider_year_mentions, top_benchmarks, provider_year_task_mix, facet_review_debt, launch_events, launch_mentions, provider_lifecycle, lifecycle, coverage_by_provider, annual_inventory,
    sharing_summary, diffusion_horizons, interaction_classification, interaction_trends, provider_interaction_trends, overview_summary,
)}

_POS = ", ".join(f"'{x}'" for x in POSITIVE)
_CLS = f""", cls as (select cat.benchmark_id, benchmark_name, v.variant, coalesce(string_agg(distinct facet_label, '; ' order by facet_label), '') interaction_labels, bool_or(facet_label in ({_POS})) positive, count(facet_label) > 0 covered
  from cat cross join (select unnest(['all_active', 'confidence_ge_0_7', 'accepted']) variant) v left join fac on fac.benchmark_id = cat.benchmark_id and facet_axis = 'interaction_pattern'
  and (v.variant = 'all_active' or (v.variant = 'accepted' and fac.review_status = 'accepted') or (v.variant = 'confidence_ge_0_7' and confidence >= 0.7)) group by 1, 2, 3)
"""
_OBS = """, lw as (select *, 1.0::double / count(*) over (partition by launch_id) weight from lm),
obs as (select 'announcement' unit, launch_id unit_id, provider, year(release_date) release_year, benchmark_id, weight from lw union all select 'model_row', model_row_id::varchar, provider, release_year, benchmark_id, release_weight from ded)
"""


def _trend_sql(by: str) -> str:
    years = "(select distinct year(release_date) release_year from rel)" + (" y cross join (select distinct provider from rel) pr" if by else " y")
    return LAUNCHES + _CLS + _OBS + f""", u as (select unit, release_year{by}, count(distinct unit_id) n from obs group by all),
h as (select unit, release_year{by}, variant, sum(weight) c, sum(case when positive then weight else 0 end) p from obs join cls using (benchmark_id) where covered group by all),
s as (select * from {years} cross join (select unnest(['announcement', 'model_row']) unit) cross join (select unnest(['all_active', 'confidence_ge_0_7', 'accepted']) variant))
select unit, release_year{by}, variant, coalesce(n, 0) benchmark_bearing_units, round(coalesce(p, 0) / nullif(coalesce(n, 0), 0)::double, 6) positive_share, round(coalesce(c, 0) / nullif(coalesce(n, 0), 0)::double, 6) coverage_share, round(coalesce(p, 0) / nullif(round(coalesce(c, 0), 9), 0), 6) positive_share_among_covered
from s left join u using (unit, release_year{by}) left join h using (unit, release_year{by}, variant)"""


SQL = {
    "provider_year_mentions": VIEWS + "select provider, release_year, count(*) mentions from men group by 1, 2",
    "top_benchmarks": VIEWS + "select benchmark_id, benchmark_name, source_author, count(*) mentions, count(distinct provider) providers, min(release_date) first_release, max(release_date) last_release from men join cat using (benchmark_id) group by 1, 2, 3",
    "provider_year_task_mix": VIEWS + "select provider, release_year, coalesce(legacy_task_mode, '') task_mode, count(*) mentions, round(count(*)::double / sum(count(*)) over (partition by provider, release_year), 6) share from men left join cat using (benchmark_id) group by 1, 2, 3",
    "facet_review_debt": VIEWS + "select facet_axis, count(*) facet_rows, count_if(review_status = 'accepted') accepted, count_if(review_status = 'needs_review') needs_review, count_if(review_status = 'legacy_seed') legacy_seed, count_if(review_status = 'disputed') disputed, count_if(review_status = 'deprecated') deprecated, count_if(confidence < 0.7) low_confidence, round(count_if(confidence < 0.7)::double / count(*), 6) low_confidence_share, round(count_if(review_status in ('needs_review', 'disputed'))::double / count(*), 6) review_share from facall group by 1",
    "launch_events": LAUNCHES + "select * from ev",
    "launch_mentions": LAUNCHES + "select * from lm",
    "provider_lifecycle": LIFE + "select * from pl",
    "lifecycle": LIFE + "select * from lc",
    "coverage_by_provider": LAUNCHES + "select ev.provider, sum(model_row_count)::bigint model_rows, count(*) launch_events, count_if(has_benchmark_mentions) benchmark_bearing_launches, min(release_date) first_release, max(release_date) last_release, coalesce(any_value(n), 0) observed_benchmarks from ev left join (select provider, count(distinct benchmark_id) n from lm group by 1) x on x.provider = ev.provider group by 1",
    "annual_inventory": LAUNCHES + "select release_year, model_rows, launch_events, benchmark_bearing_launches, coalesce(launch_mentions, 0) launch_mentions, coalesce(new_identities, 0) new_identities from (select year(release_date) release_year, sum(model_row_count)::bigint model_rows, count(*) launch_events, count_if(has_benchmark_mentions) benchmark_bearing_launches from ev group by 1) left join (select year(release_date) release_year, count(*) launch_mentions from lm group by 1) using (release_year) left join (select year(f) release_year, count(*) new_identities from (select min(release_date) f from lm group by benchmark_id) group by 1) using (release_year)",
    "sharing_summary": LAUNCHES + ", lw as (select *, 1.0::double / count(*) over (partition by launch_id) weight from lm), b as (select benchmark_id, count(distinct provider) provider_count, count(*) n, sum(weight) w from lw group by 1) select s.provider_count, count(b.benchmark_id) benchmark_count, round(count(b.benchmark_id)::double / (select count(*) from b), 6) benchmark_share, coalesce(sum(n), 0)::bigint launch_mentions, round(coalesce(sum(n), 0)::double / (select sum(n) from b), 6) mention_share, round(coalesce(sum(w), 0), 6) announcement_weight, round(coalesce(sum(w), 0) / (select sum(w) from b), 6) announcement_weight_share from (select unnest(generate_series(1, (select count(distinct provider) from rel))) provider_count) s left join b using (provider_count) group by 1",
    "diffusion_horizons": LIFE + f"select h.h::bigint horizon_days, count_if(first_seen <= e.e - h.h::int) eligible_benchmarks, count_if(first_seen <= e.e - h.h::int and second_provider_lag_days <= h.h) diffused_benchmarks, round(count_if(first_seen <= e.e - h.h::int and second_provider_lag_days <= h.h)::double / nullif(count_if(first_seen <= e.e - h.h::int), 0), 6) diffusion_share from lc cross join (select unnest([30, 90, 180]) h) h cross join (select least(max(release_date), {CUT}) e from rel) e where launch_count > 0 group by 1",
    "interaction_classification": VIEWS + _CLS + "select * from cls",
    "interaction_trends": _trend_sql(""),
    "provider_interaction_trends": _trend_sql(", provider"),
    "overview_summary": LIFE + "select (select count(*) from lc) catalog_benchmarks, (select count_if(launch_count > 0) from lc) observed_benchmarks, (select count_if(launch_count = 1) from lc) single_launch_benchmarks, (select count_if(provider_count > 1) from lc) shared_benchmarks, (select median(second_provider_lag_days) filter (provider_count > 1) from lc) shared_conditional_median_lag_days, (select sum(model_row_count)::bigint from ev) model_rows, (select count(*) from ev) launch_events, (select count_if(has_benchmark_mentions) from ev) benchmark_bearing_launches, (select max(year(release_date)) from ev) latest_release_year, (select count(*) from lm) launch_mentions, (select count(*) from men) raw_model_mentions, (select count(distinct (model_row_id, benchmark_id)) from men) canonical_model_mentions",
}
