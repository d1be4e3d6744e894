"""The tables of a data folder in the roles that the result tables need, and the same views as SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import norm_id, norm_name, squeeze
from tidemark.sources.tables import load

#: The last day in scope of the queries that are being built; None: the latest release date.
_AS_OF: ContextVar[dt.date | None] = ContextVar("as_of", default=None)
_LATEST: dict[tuple, dt.date] = {}
#: The labs whose authorship is told apart.
LABS = ("Hexamere AI", "Norvane Labs", "Oumbra", "Pelagos Compute", "Quillon", "Tarkwell")


def parse_day(day: dt.date | str) -> dt.date:
    """A day, or a text YYYY-MM-DD; anything else raises."""
    if isinstance(day, dt.datetime) or not isinstance(day, dt.date | str):
        raise ValueError(f"as_of must be a date, not {day!r}")
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def positive_days(days: int) -> int:
    """A number of days, one at least; anything else raises."""
    if isinstance(days, bool) or not isinstance(days, int) or days < 1:
        raise ValueError(f"a window needs a positive number of days, not {days!r}")
    return days


def scoped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query with a further argument as_of: rows after this day are out of scope, and windows and spans end on it. The default is the latest release date."""

    @wraps(query)
    def run(*args, as_of: dt.date | str | None = None, **more) -> DataFrame:
        if as_of is None:
            return query(*args, **more)
        token = _AS_OF.set(parse_day(as_of))
        try:
            return query(*args, **more)
        finally:
            _AS_OF.reset(token)

    return run


def cutoff(spark: SparkSession, d: str) -> dt.date:
    """The last day in scope: as_of of the query, or the latest release date. The latter is read once for each state of the table."""
    if (day := _AS_OF.get()) is not None:
        return day
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d.rstrip('/')}/models.parquet")
    key = (spark.sparkContext.applicationId, d, path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime())
    if key not in _LATEST:
        _LATEST[key] = load(spark, d, "models").agg(F.max("release_date").alias("m")).first().m or dt.date(1970, 1, 1)
    return _LATEST[key]


def in_scope(rows: DataFrame, spark: SparkSession, d: str, key: str) -> DataFrame:
    """rows with a release date up to the cutoff; a row without one raises, as it is neither in nor out of scope."""
    day = F.col("release_date")
    lost = F.raise_error(F.concat(F.lit(f"no release date: {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.where(day.isNull() | (day <= F.lit(cutoff(spark, d)))).withColumn("release_date", F.when(day.isNull(), lost).otherwise(day).cast("date"))


def releases(spark: SparkSession, d: str) -> DataFrame:
    """Releases once each: (model_row_id, provider, model_name, link, release_date, benchmarks), in scope; a missing provider is `unknown`."""
    rows = in_scope(load(spark, d, "models"), spark, d, "model_row_id")
    return rows.groupBy("model_row_id").agg(
        F.coalesce(F.min(norm_name("provider")), F.lit("unknown")).alias("provider"), F.min(squeeze("model_name")).alias("model_name"),
        F.coalesce(F.min("link"), F.lit("")).alias("link"), F.min("release_date").alias("release_date"), F.max("benchmarks").alias("benchmarks"),
    )


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Resolved mentions once each, in scope, with the provider and name of the mention row."""
    m = in_scope(load(spark, d, "mentions").where("benchmark_id is not null"), spark, d, "mention_id")
    m = m.groupBy("mention_id").agg(
        F.min("model_row_id").alias("model_row_id"), F.coalesce(F.min(norm_name("provider")), F.lit("unknown")).alias("provider"),
        F.min(squeeze("model_name")).alias("model_name"), F.min("release_date").alias("release_date"),
        F.min("mention_index").alias("mention_index"), F.min("raw_mention").alias("raw_mention"), F.min(norm_id("benchmark_id")).alias("benchmark_id"),
    )
    return m.where("benchmark_id is not null").withColumn("release_year", F.year("release_date").cast("bigint"))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entries once each; missing texts are empty."""
    text = lambda c: F.coalesce(F.min(c), F.lit("")).alias(c)
    rows = load(spark, d, "benchmarks").withColumn("benchmark_id", norm_id("benchmark_id")).where("benchmark_id is not null")
    return rows.groupBy("benchmark_id").agg(text("benchmark_name"), text("source_author"), text("frontier_lab_author_affiliations"), text("legacy_task_mode"), text("legacy_task_domain"), text("review_status"))


def facets(spark: SparkSession, d: str, active: bool = True) -> DataFrame:
    """Facet rows once each: (facet_row_id, benchmark_id, facet_axis, facet_label, confidence, review_status); active ones only by default."""
    rows = load(spark, d, "benchmark_facets").groupBy("facet_row_id").agg(
        F.min(norm_id("benchmark_id")).alias("benchmark_id"), F.min("facet_axis").alias("facet_axis"), F.min("facet_label").alias("facet_label"),
        F.min(F.when(~F.isnan("classification_confidence"), F.col("classification_confidence"))).alias("confidence"), F.min("review_status").alias("review_status"),
    )
    rows = rows.where("benchmark_id is not null and trim(facet_axis) <> '' and trim(facet_label) <> ''")
    return rows.where("review_status <> 'deprecated'") if active else rows


_SQUEEZE = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_P = "coalesce(min(nullif(lower(" + _SQUEEZE.format(c="provider") + "), '')), 'unknown')"
URL = (
    "lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || regexp_replace(substring(b, length(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) + 1), '/+$', '')"
    " || case when array_to_string(ps, '&') <> '' then '?' || array_to_string(ps, '&') else '' end"
)
#: The last day in scope, as a table and as a value.
SCOPE, CUT = "select max(release_date) c from models", "(select c from sc)"
#: The views above in DuckDB's SQL: rel, men, cat, fac (active), facall, and ded (mentions once per release and benchmark).
VIEWS = f"""with sc as ({SCOPE}), rel as (select model_row_id, {_P} provider, min({_SQUEEZE.format(c="model_name")}) model_name, coalesce(min(link), '') link, min(release_date) release_date, max(benchmarks) benchmarks
  from models where release_date <= {CUT} group by model_row_id),
men as (select * from (select mention_id, min(model_row_id) model_row_id, {_P} provider, min({_SQUEEZE.format(c="model_name")}) model_name, min(release_date) release_date, min(mention_index) mention_index,
  min(raw_mention) raw_mention, min(nullif(lower(trim(benchmark_id)), '')) benchmark_id, year(min(release_date))::bigint release_year
  from mentions where benchmark_id is not null and release_date <= {CUT} group by mention_id) where benchmark_id is not null),
cat as (select lower(trim(benchmark_id)) benchmark_id, coalesce(min(benchmark_name), '') benchmark_name, coalesce(min(source_author), '') source_author, coalesce(min(frontier_lab_author_affiliations), '') frontier_lab_author_affiliations,
  coalesce(min(legacy_task_mode), '') legacy_task_mode, coalesce(min(legacy_task_domain), '') legacy_task_domain, coalesce(min(review_status), '') review_status from benchmarks where trim(benchmark_id) <> '' group by 1),
facall as (select * from (select facet_row_id, min(nullif(lower(trim(benchmark_id)), '')) benchmark_id, min(facet_axis) facet_axis, min(facet_label) facet_label,
  min(case when not isnan(classification_confidence) then classification_confidence end) confidence, min(review_status) review_status from benchmark_facets group by 1)
  where benchmark_id is not null and trim(facet_axis) <> '' and trim(facet_label) <> ''),
fac as (select * from facall where review_status <> 'deprecated'),
ded as (select *, 1.0::double / count(*) over (partition by model_row_id) release_weight, multiplicity::double / sum(multiplicity) over (partition by model_row_id) raw_weight from
  (select model_row_id, benchmark_id, min(provider) provider, min(model_name) model_name, min(release_date) release_date, year(min(release_date))::bigint release_year, min(mention_index) mention_index, count(*) multiplicity,
   string_agg(raw_mention, '; ' order by mention_index, raw_mention) raw_mentions from men group by 1, 2))
"""
#: Further views for announcements: lrel (releases with launch), ev (R5), lm (R6), provider and catalogue lifecycles.
LAUNCHES = VIEWS + f""", lrel as (select *, 'launch_' || substring(sha256(to_json([provider, strftime(release_date, '%Y-%m-%d'), source_url])), 1, 20) launch_id from
  (select *, {URL} source_url from (select *, regexp_extract(nf, '^([^?]*)', 1) b, [x for x in string_split(regexp_extract(nf, '\\?(.*)$', 1), '&') if x <> '' and not regexp_matches(x, '(?i)^(utm_[^=]*|gclid|fbclid)(=|$)')] ps
   from (select *, regexp_replace(trim(link), '#.*$', '') nf from rel)))),
lids as (select launch_id, count(distinct benchmark_id) n from men join lrel using (model_row_id) group by 1),
ev as (select launch_id, provider, release_date, source_url, string_agg(distinct nullif(model_name, ''), '; ' order by nullif(model_name, '')) model_names, count(*) model_row_count, coalesce(any_value(lids.n), 0) benchmark_count, coalesce(any_value(lids.n), 0) > 0 has_benchmark_mentions
  from lrel left join lids using (launch_id) group by 1, 2, 3, 4),
lm as (select x.benchmark_id, launch_id, provider, release_date, source_url, string_agg(distinct nullif(model_name, ''), '; ' order by nullif(model_name, '')) model_names, count(*) model_row_count
  from (select distinct model_row_id, benchmark_id from men) x join lrel using (model_row_id) group by 1, 2, 3, 4, 5)
"""
LIFE = LAUNCHES + f""", pl as (select *, datediff('day', first_seen, last_seen) observed_span_days, datediff('day', last_seen, {CUT}) days_since_last_seen, round(followup_mention_launches::double / nullif(followup_launches, 0), 6) followup_mention_share from (
  select f.*, (select count(*) from ev where ev.provider = f.provider and ev.release_date > f.first_seen) followup_launches, (select count(*) from lm where lm.benchmark_id = f.benchmark_id and lm.provider = f.provider and lm.release_date > f.first_seen) followup_mention_launches,
    (select count(*) from ev where ev.provider = f.provider and ev.release_date > f.last_seen) launches_after_last_seen, coalesce(g.gap, 0) largest_gap_launches
  from (select benchmark_id, provider, min(release_date) first_seen, max(release_date) last_seen, count(*) launch_count, sum(model_row_count)::bigint model_row_count from lm group by 1, 2) f
  left join (select benchmark_id, provider, max((select count(*) from ev where ev.provider = q.provider and ev.release_date > q.a and ev.release_date < q.b)) gap from
    (select benchmark_id, provider, release_date a, lead(release_date) over (partition by benchmark_id, provider order by release_date) b from (select distinct benchmark_id, provider, release_date from lm)) q where b is not null group by 1, 2) g using (benchmark_id, provider))),
nth as (select *, row_number() over (partition by benchmark_id order by first_seen, provider) k, min(first_seen) over (partition by benchmark_id) s0, max(last_seen) over (partition by benchmark_id) e0 from pl),
lc as (select cat.benchmark_id, benchmark_name, review_status, case when a.launch_count is null then 'unobserved' when provider_count > 1 then 'shared_across_providers' when launch_count = 1 then 'single_launch' else 'repeated_one_provider' end reporting_pattern,
  first_seen, last_seen, datediff('day', first_seen, last_seen) observed_span_days, datediff('day', last_seen, {CUT}) days_since_last_seen, coalesce(launch_count, 0)::bigint launch_count, coalesce(model_row_count, 0)::bigint model_row_count, coalesce(provider_count, 0) provider_count,
  coalesce(first_providers, '') first_providers, second_provider_date, datediff('day', first_seen, second_provider_date) second_provider_lag_days, third_provider_date, datediff('day', first_seen, third_provider_date) third_provider_lag_days,
  (select count(*) from lm where lm.benchmark_id = cat.benchmark_id and lm.release_date >= {CUT} - 179) recent_launch_count, adopter_followup_launches, adopter_followup_mention_launches,
  round(adopter_followup_mention_launches::double / nullif(adopter_followup_launches, 0), 6) followup_mention_share, adopter_launches_after_last_seen, largest_within_provider_gap_launches
  from cat left join (select benchmark_id, min(first_seen) first_seen, max(last_seen) last_seen, sum(launch_count)::bigint launch_count, sum(model_row_count)::bigint model_row_count, count(*) provider_count,
    string_agg(provider, '; ' order by provider) filter (first_seen = s0) first_providers, max(first_seen) filter (k = 2) second_provider_date, max(first_seen) filter (k = 3) third_provider_date,
    sum(followup_launches)::bigint adopter_followup_launches, sum(followup_mention_launches)::bigint adopter_followup_mention_launches,
    sum((select count(*) from ev where ev.provider = nth.provider and ev.release_date > nth.e0))::bigint adopter_launches_after_last_seen, max(largest_gap_launches) largest_within_provider_gap_launches from nth group by 1) a using (benchmark_id))
"""
