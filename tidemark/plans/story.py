"""Shares of provider-made and opaque entries, second period schemes, full lifecycles, cascades and summaries: R8, R16, R20, R21, R25, R33, R35, R37, R45 to
R47, R57, R58, R75, with their flags, keys, pivots and chart steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import stable_id
from tidemark.functions.periods import SCHEMES, number, percent, period, period_sql, year_label
from tidemark.functions.vocab import CONFIDENCE, HEADLINE_AXIS
from tidemark.operators import trends
from tidemark.operators.facets import inferred_affiliations, with_headline
from tidemark.operators.shares import all_facet_weights, dedup_mentions, joined, ratio, ratio_or_zero
from tidemark.operators.sizes import lookup_join
from tidemark.plans import base, composition, overview, provenance
from tidemark.plans.base import CUT, LAUNCHES, LIFE, VIEWS
from tidemark.plans.composition import AXES, UNITS

#: The axis that says how entries were made, its labels for entries made by their provider and for those closed to others, the label for none, and the word that
#: marks a name as internal: what the roles are bound to in these tables.
RISK_AXIS, CREATED, OPAQUE, HARMLESS, INTERNAL = "context_pressure", ("very_long",), ("unknown",), ("short",), "eval"
PRIMARY, BROAD = ("very_long",), ("long", "very_long")
RISK_FLAGS = ("created_or_opaque", "opaque", "created", "internal_named", "nonzero_risk")


def _any(axis: str, labels: tuple[str, ...], inside: bool = True) -> Column:
    hit = F.col("facet_label").isin(*labels)
    return F.coalesce(F.bool_or((F.col("facet_axis") == axis) & (hit if inside else ~hit)), F.lit(False))


@base.scoped
def risk_flags(spark: SparkSession, d: str, axis: str = RISK_AXIS, created: tuple[str, ...] = CREATED, opaque: tuple[str, ...] = OPAQUE, harmless: tuple[str, ...] = HARMLESS, word: str = INTERNAL) -> DataFrame:
    """Of every catalogue entry, whether it was made by its provider, is closed to others, is named as internal, or has any risk."""
    f = base.facets(spark, d).groupBy("benchmark_id").agg(_any(axis, created).alias("created"), _any(axis, opaque).alias("opaque"), _any(axis, harmless, False).alias("nonzero_risk"))
    c = base.catalogue(spark, d).select("benchmark_id", "benchmark_name", F.contains(F.lower("benchmark_name"), F.lit(word.lower())).alias("internal_named"))
    out = c.join(f, "benchmark_id", "left").na.fill(False, ["created", "opaque", "nonzero_risk"])
    return out.select("benchmark_id", "benchmark_name", (F.col("created") | F.col("opaque")).alias("created_or_opaque"), "opaque", "created", "internal_named", "nonzero_risk")


@base.scoped
def strategy_flags(spark: SparkSession, d: str) -> DataFrame:
    """Long context, in the wide and the strict reading, acting, multimodal and coding entries, and those that are acting or multimodal, and both."""
    f = base.facets(spark, d)
    long = f.groupBy("benchmark_id").agg(_any("context_pressure", PRIMARY).alias("is_long_context_primary"), _any("context_pressure", BROAD).alias("is_long_context_broad"))
    flags = composition.benchmark_flags(spark, d).select("benchmark_id", "is_agentic", "is_multimodal", "is_coding")
    both = long.join(flags, "benchmark_id")
    return both.withColumn("is_agentic_or_multimodal", F.col("is_agentic") | F.col("is_multimodal")).withColumn("is_agentic_and_multimodal", F.col("is_agentic") & F.col("is_multimodal"))


def _risk_units(spark: SparkSession, d: str) -> DataFrame:
    """Mentions per release and entry with risk flags; w is the share of the release's mentions."""
    u = dedup_mentions(base.mentions(spark, d)).withColumn("release_year", F.year("release_date").cast("bigint"))
    return lookup_join(u.withColumnRenamed("raw_weight", "w"), risk_flags(spark, d), "benchmark_id", "left").na.fill(False, list(RISK_FLAGS))


def _flagged(flag: str, value: str) -> Column:
    return F.sum(F.when(F.col(flag), F.col(value)).otherwise(F.lit(0).cast("double" if value == "w" else "bigint")))


@base.scoped
def risk_by_release(spark: SparkSession, d: str) -> DataFrame:
    """Share and mentions of each flag in every release that has mentions, and the names behind two of them."""
    names = lambda flag: joined(F.when(F.col(flag), F.col("benchmark_name"))).alias(f"{flag}_benchmarks")
    g = _risk_units(spark, d).groupBy("model_row_id", "provider", "release_date", "release_year")
    cols = [c for f in RISK_FLAGS for c in (F.round(_flagged(f, "w"), 6).alias(f"{f}_share"), _flagged(f, "multiplicity").alias(f"{f}_mentions"))]
    return g.agg(F.sum("multiplicity").alias("resolved_mentions"), *cols, names("created_or_opaque"), names("internal_named"))


@base.scoped
def risk_by_provider(spark: SparkSession, d: str) -> DataFrame:
    """Weight, mentions and share of each flag by provider."""
    u = _risk_units(spark, d)
    g = u.groupBy("provider").agg(F.count_distinct("model_row_id").alias("releases"), F.sum("w").alias("w"), *[c for f in RISK_FLAGS for c in (_flagged(f, "w").alias(f"{f}_w"), _flagged(f, "multiplicity").alias(f"{f}_mentions"))])
    shares = [c for f in RISK_FLAGS for c in (F.round(f"{f}_w", 6).alias(f"{f}_weight"), F.col(f"{f}_mentions"), ratio(F.col(f"{f}_w"), F.col("w")).alias(f"{f}_share"))]
    return g.select("provider", "releases", F.round("w", 6).alias("weighted_mentions"), *shares)


@base.scoped
def risk_portfolio(spark: SparkSession, d: str, axis: str = RISK_AXIS) -> DataFrame:
    """Label shares of the risk axis, or another one, by provider; the denominator is the labelled weight."""
    u = composition._units(spark, d).groupBy("provider", "benchmark_id").agg(F.sum("w").alias("w"))
    g = all_facet_weights(u, base.facets(spark, d), (axis,), "w").groupBy("provider", "facet_label").agg(F.sum("label_weight").alias("lw"))
    return g.select("provider", "facet_label", F.round("lw", 6).alias("weight"), ratio(F.col("lw"), F.sum("lw").over(Window.partitionBy("provider"))).alias("share"))


def _lifecycle_shares(spark: SparkSession, d: str, key: str) -> DataFrame:
    e = lookup_join(provenance._enriched(spark, d), risk_flags(spark, d).select("benchmark_id", "created", "opaque", "created_or_opaque"), "benchmark_id", "left").na.fill(False, ["created", "opaque", "created_or_opaque"])
    e = e.withColumn("own_created_or_opaque", F.col("created_or_opaque") & F.coalesce(F.array_contains("labs", F.col("provider")), F.lit(False))).withColumn("period", period(F.col("release_year"), "two_years"))
    flags = ("created", "opaque", "created_or_opaque", "own_created_or_opaque")
    g = e.where(F.col(key).isNotNull()).groupBy("provider", key).agg(F.sum("n").alias("total_mentions"), *[_flagged(f, "n").alias(f"{f}_mentions") for f in flags])
    return g.select("*", *[ratio_or_zero(F.col(f"{f}_mentions"), F.col("total_mentions")).alias(f"{f}_share") for f in flags])


@base.scoped
def lifecycle_period_shares(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of entries made by their provider, closed to others, either, and either with the mentioning provider among the makers, by provider and period."""
    return _lifecycle_shares(spark, d, "period")


@base.scoped
def lifecycle_year_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same by year."""
    return _lifecycle_shares(spark, d, "release_year")


@base.scoped
def provider_lifecycle_all(spark: SparkSession, d: str) -> DataFrame:
    """Every catalogue entry with every provider of the whole inventory, in scope or not; pairs without a mention have counts of 0 and no dates."""
    everyone = base.load(spark, d, "models").select(F.coalesce(base.norm_name("provider"), F.lit("unknown")).alias("provider")).distinct()
    pairs = base.catalogue(spark, d).select("benchmark_id", "benchmark_name", "review_status").crossJoin(everyone)  # the table is these pairs
    out = pairs.join(overview.provider_lifecycle(spark, d), ["benchmark_id", "provider"], "left")
    return out.na.fill(0, ["launch_count", "model_row_count"])


@base.scoped
def overview_facts(spark: SparkSession, d: str) -> DataFrame:
    """All scalars of the overview as one row."""
    last = base.cutoff(spark, d)
    life, lm, ev = overview.lifecycle(spark, d), overview._weighted(overview.launch_mentions(spark, d)), overview.launch_events(spark, d)
    seen, shared, single = F.col("launch_count") > 0, F.col("provider_count") > 1, F.col("launch_count") == 1
    b = ev.agg(F.sum("model_row_count").alias("model_rows"), F.count("*").alias("launch_events"), F.count_if("has_benchmark_mentions").alias("benchmark_bearing_launches"), F.max(F.year("release_date")).cast("bigint").alias("latest_release_year"), F.least(F.max("release_date"), F.lit(last)).alias("diffusion_followup_end"))
    a = life.crossJoin(b.select("latest_release_year")).agg(
        F.count("*").alias("catalog_benchmarks"), F.count_if(seen).alias("observed_benchmarks"), F.count_if(single).alias("single_launch_benchmarks"), F.count_if(shared).alias("shared_benchmarks"),
        F.count_if(F.col("provider_count") == 3).alias("all_three_benchmarks"), F.median(F.when(shared, F.col("second_provider_lag_days"))).alias("shared_conditional_median_lag_days"),
        F.sum(F.when(shared, F.col("launch_count"))).alias("shared_launches"), F.count_if(single & (F.year("first_seen") == F.col("latest_release_year"))).alias("single_launch_first_seen_latest_year"),
    )
    per = lm.groupBy("benchmark_id", "provider").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).groupBy("benchmark_id").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("p"))
    c = per.agg(F.sum("n").alias("launch_mentions"), F.sum(F.when(F.col("p") > 1, F.col("w"))).alias("shared_weight"))
    m = base.mentions(spark, d).groupBy("model_row_id", "benchmark_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("raw_model_mentions"), F.count("*").alias("canonical_model_mentions"))
    f = base.facets(spark, d, active=False).agg(F.count("*").alias("facet_rows"), *[F.count_if(F.col("review_status") == s).alias(f"facet_{s}") for s in ("accepted", "needs_review", "legacy_seed")])
    out = a.crossJoin(b).crossJoin(c).crossJoin(m).crossJoin(f)  # one row each
    out = out.withColumn("as_of", F.lit(last)).withColumn("shared_mention_share", ratio(F.col("shared_launches"), F.col("launch_mentions"))).withColumn("shared_announcement_weight_share", ratio(F.col("shared_weight"), F.col("benchmark_bearing_launches")))
    return out.drop("shared_launches", "shared_weight")


@base.scoped
def cascade_table(spark: SparkSession, d: str) -> DataFrame:
    """cascade_metrics with the entry's catalogue columns, the forms in which it was written, and whether a first provider is among its makers."""
    c = provenance.cascade_metrics(spark, d)
    m = base.mentions(spark, d)
    forms = m.select("benchmark_id", "raw_mention").distinct().groupBy("benchmark_id").agg(joined("raw_mention").alias("raw_variants"))
    made = provenance.provenance(spark, d).select("benchmark_id", F.array_union("labs", "authors").alias("makers"))
    cat = base.catalogue(spark, d).select("benchmark_id", "benchmark_name", "source_author", "frontier_lab_author_affiliations", "legacy_task_mode", "legacy_task_domain")
    out = c.join(forms, "benchmark_id").join(cat, "benchmark_id", "left").join(made, "benchmark_id", "left")
    own = F.coalesce(F.arrays_overlap(F.split("first_providers", "; "), "makers"), F.lit(False))
    return out.withColumn("first_provider_is_author_affiliated", own).drop("makers")


@base.scoped
def network_summary(spark: SparkSession, d: str, top: int = 5) -> DataFrame:
    """(metric, value, detail): counts of cascades, the fastest and the slowest ones, balances of providers, latest similarities and shares of own entries."""
    c = provenance.cascade_metrics(spark, d)
    m = base.mentions(spark, d).agg(F.count("*").alias("a"), F.count_distinct("benchmark_id").alias("b"))
    k = c.agg(F.count_if("cross_provider_cascade").alias("c"), F.count_if(~F.col("cross_provider_cascade")).alias("d"))
    row = lambda name, value, detail="": F.struct(F.lit(name).alias("metric"), F.round(F.col(value).cast("double"), 3).alias("value"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    counts = m.crossJoin(k).select(F.inline(F.array(row("resolved_mentions", "a"), row("unique_benchmarks_mentioned", "b"), row("cross_provider_cascades", "c"), row("single_provider_benchmarks", "d"))))  # one row each
    far = c.where("cross_provider_cascade and days_to_second_provider is not null")
    path = F.concat("benchmark_id", F.lit(": "), "first_providers", F.lit(" -> "), "second_provider")
    one = lambda rows, name, value, detail: rows.select(F.inline(F.array(row(name, value, detail))))
    parts = [
        one(far.orderBy("days_to_second_provider", "benchmark_id").limit(top), "fastest_cascade", "days_to_second_provider", path), one(far.orderBy(F.desc("days_to_second_provider"), "benchmark_id").limit(top), "slowest_cascade", "days_to_second_provider", path),
        one(provenance.diffusion_roles(spark, d), "provider_net_export_balance", "net_export_balance", F.col("provider")), one(provenance.similarity_latest(spark, d), "latest_portfolio_similarity", "jaccard_similarity", F.concat("left_provider", F.lit(" / "), "right_provider")),
        one(provenance.source_author_dependency(spark, d), "self_affiliated_mention_share", "self_affiliated_share", F.col("provider")),
    ]
    for p in parts:
        counts = counts.unionByName(p)
    return counts


def _hypothesis(spark: SparkSession, d: str) -> DataFrame:
    return composition._units(spark, d).withColumn("period", period(F.col("release_year"), "hypothesis")).where("period <> 'pre-2024'")


@base.scoped
def hypothesis_period_summary(spark: SparkSession, d: str) -> DataFrame:
    """Releases, mentions and weighted shares by provider and period of the hypothesis; earlier periods are left out."""
    u = _hypothesis(spark, d)
    rel = base.releases(spark, d).withColumn("period", period(F.year("release_date"), "hypothesis")).where("period <> 'pre-2024'").join(u.select("model_row_id", F.lit(1).alias("b")).distinct(), "model_row_id", "left")
    left = rel.groupBy("provider", "period").agg(F.count("*").alias("release_count"), F.count("b").alias("benchmarked_release_count"))
    share = [ratio_or_zero(_flagged(f, "w"), F.sum("w")).alias(f"{f[3:]}_share") for f in composition.FLAGS]
    right = u.groupBy("provider", "period").agg(F.sum("multiplicity").alias("raw_mention_count"), F.round(F.sum("w"), 6).alias("normalized_release_mentions"), F.count_distinct("benchmark_id").alias("unique_benchmark_count"), *share)
    return left.join(right, ["provider", "period"], "left").na.fill(0)


@base.scoped
def hypothesis_axis_shares(spark: SparkSession, d: str) -> DataFrame:
    """Label shares of all axes by provider and period of the hypothesis; the denominator is the weight of all mentions, labelled or not."""
    u = _hypothesis(spark, d).groupBy("provider", "period", "benchmark_id").agg(F.sum("w").alias("w"), F.sum("multiplicity").alias("n"))
    total = u.groupBy("provider", "period").agg(F.sum("w").alias("t"))
    g = all_facet_weights(u, base.facets(spark, d), AXES, "w").groupBy("provider", "period", "facet_axis", "facet_label").agg(F.sum("label_weight").alias("lw"), F.sum("n").alias("raw_mention_count"))
    return g.join(total, ["provider", "period"]).select("provider", "period", "facet_axis", "facet_label", F.round("lw", 6).alias("weighted_mentions"), "raw_mention_count", ratio(F.col("lw"), F.col("t")).alias("share"))


def _long_units(spark: SparkSession, d: str) -> DataFrame:
    flags = strategy_flags(spark, d).select("benchmark_id", F.col("is_long_context_broad").alias("broad"), F.col("is_long_context_primary").alias("primary"))
    u = dedup_mentions(base.mentions(spark, d)).withColumn("period", period(F.year("release_date"), "hypothesis")).where("period <> 'pre-2024'")
    return lookup_join(u, flags, "benchmark_id", "left").na.fill(False, ["broad", "primary"]).withColumnRenamed("release_weight", "w")


@base.scoped
def long_context_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Weight and share of long context, in the wide and the strict reading, by provider and period."""
    g = _long_units(spark, d).groupBy("provider", "period").agg(F.sum("w").alias("t"), F.sum("multiplicity").alias("raw_mentions"), _flagged("broad", "w").alias("b"), _flagged("primary", "w").alias("p"), F.count_distinct("model_row_id").alias("benchmarked_releases"))
    return g.select("provider", "period", F.round("t", 6).alias("release_weight_total"), "raw_mentions", F.round("b", 6).alias("broad_weight"), F.round("p", 6).alias("primary_weight"), "benchmarked_releases", ratio_or_zero(F.col("b"), F.col("t")).alias("broad_share"), ratio_or_zero(F.col("p"), F.col("t")).alias("primary_share"))


@base.scoped
def long_context_drivers(spark: SparkSession, d: str) -> DataFrame:
    """The long-context entries of each provider and period, with weight, mentions, models and labels."""
    labels = base.facets(spark, d).where("facet_axis = 'context_pressure'").groupBy("benchmark_id").agg(joined("facet_label").alias("context_labels"))
    g = _long_units(spark, d).where("broad").groupBy("provider", "period", "benchmark_id").agg(F.round(F.sum("w"), 6).alias("weighted_mentions"), F.sum("multiplicity").alias("raw_mentions"), joined("model_name").alias("models"))
    return lookup_join(g, labels, "benchmark_id", "left")


@base.scoped
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """(key, value) of mentions, entries, releases told apart by provider, name and date, providers and periods."""
    m = base.mentions(spark, d).groupBy("provider", "model_name", "release_date", "release_year", "benchmark_id").agg(F.count("*").alias("n"))
    a = m.agg(F.sum("n").alias("n"), F.count_distinct("benchmark_id").alias("b"), F.count_distinct("provider", "model_name", "release_date").alias("r"), joined("provider").alias("p"), joined(period(F.col("release_year"), "two_years")).alias("q"))
    names = {"total_mentions": "n", "unique_benchmarks": "b", "models_with_mentions": "r", "providers": "p", "periods": "q"}
    return a.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for k, c in names.items()])))


@base.scoped
def period_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every release's year in each scheme of periods, with the last year marked, and as texts the share of its year's releases that come up to it."""
    year = F.year("release_date")
    rel = base.releases(spark, d).select("model_row_id", "release_date", year.cast("bigint").alias("release_year"))
    sizes = rel.groupBy("release_year").agg(F.count("*").alias("n"))
    rel = rel.join(F.broadcast(sizes), "release_year")  # one row a year
    cols = [period(F.col("release_year"), s).alias(s) for s in SCHEMES]
    return rel.select("model_row_id", "release_year", *cols, year_label(F.col("release_year"), F.lit(base.cutoff(spark, d).year)).alias("year_label"), percent(1 / F.col("n")).alias("share_text"), number(F.col("n")).alias("count_text"))


@base.scoped
def release_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of each release by provider, name and date, and stable ids that keep letters of all scripts, or ASCII ones only."""
    r = base.releases(spark, d)
    day = F.date_format("release_date", "yyyy-MM-dd")
    return r.select("model_row_id", F.concat_ws("|", "provider", "model_name", day).alias("model_key"), stable_id("release", F.col("provider"), F.col("model_name"), day).alias("ascii_id"), stable_id("release", F.col("provider"), F.col("model_name"), day, unicode_letters=True).alias("letter_id"))


@base.scoped
def facet_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Facet rows by axis, a column for each status."""
    f = base.facets(spark, d, active=False).groupBy("facet_axis").pivot("review_status", list(composition.STATUSES)).count()
    return f.na.fill(0)


@base.scoped
def facet_status_long(spark: SparkSession, d: str) -> DataFrame:
    """The pivot turned back, a row for each axis and status, also where there are none."""
    return facet_status_pivot(spark, d).unpivot("facet_axis", list(composition.STATUSES), "review_status", "facet_rows")


@base.scoped
def import_lags_rounded(spark: SparkSession, d: str) -> DataFrame:
    """Mean and median of the lags with which each provider takes entries over, to one digit, halves to the even one."""
    late = provenance.adoption_events(spark, d).where("not is_first_provider")
    lag = "lag_days_since_benchmark_first"  # days, so few values a provider
    g = late.groupBy("provider").agg(F.avg(lag).alias("a"), F.median(lag).alias("m"), F.count("*").alias("imports"))
    # halves are told from values beside them by the digits that a double holds
    return g.select("provider", "imports", F.bround(F.round("a", 9), 1).alias("mean_lag"), F.bround("m", 1).alias("median_of_lags"))


@base.scoped
def isolated_share_days(spark: SparkSession, d: str, window_days: int = 2) -> DataFrame:
    """The days on which short trailing windows have a share of a domain, and those of them that stand alone."""
    out = trends.isolated_days(composition.domain_trend(spark, d, window_days), "day", "share", ["category"])
    return out.select("day", "category", F.col("share").isNotNull().alias("covered"), "isolated")


@base.scoped
def stacked_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """Where the domains of each provider's portfolio stand when they are stacked in the order of their names."""
    out = trends.stacked(composition._covered(spark, d).withColumnRenamed("lw", "weight"), ["provider"], "weight", ["facet_label"])
    return out.select("provider", "facet_label", *[F.round(c, 6).alias(c) for c in ("weight", "low", "high")])


@base.scoped
def facets_with_headline(spark: SparkSession, d: str) -> DataFrame:
    """All facet rows, and one derived headline row for each entry that has none."""
    return with_headline(base.facets(spark, d, active=False))


@base.scoped
def affiliations(spark: SparkSession, d: str) -> DataFrame:
    """The labs that each entry's author text names, beside those on record."""
    c = base.catalogue(spark, d)
    return c.select("benchmark_id", F.col("frontier_lab_author_affiliations").alias("on_record"), inferred_affiliations(F.col("source_author"), base.LABS).alias("inferred"))


QUERIES = {f.__name__: f for f in (
    risk_flags, strategy_flags, risk_by_release, risk_by_provider, risk_portfolio, lifecycle_period_shares, lifecycle_year_shares, provider_lifecycle_all, overview_facts, cascade_table, network_summary, hypothesis_period_summary, hypothesis_axis_shares,
    long_context_by_period, long_context_drivers, run_summary, period_labels, release_keys, facet_status_pivot, facet_status_long, import_lags_rounded, isolated_share_days, stacked_portfolio, facets_with_headline, affiliations,
)}


def _in(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


_RISK = f"""rk as (select cat.benchmark_id, benchmark_name, coalesce(created or opaque, false) created_or_opaque, coalesce(opaque, false) opaque, coalesce(created, false) created, contains(lower(benchmark_name), '{INTERNAL}') internal_named, coalesce(nonzero_risk, false) nonzero_risk from cat left join
  (select benchmark_id, bool_or(facet_axis = '{RISK_AXIS}' and facet_label in {_in(CREATED)}) created, bool_or(facet_axis = '{RISK_AXIS}' and facet_label in {_in(OPAQUE)}) opaque, bool_or(facet_axis = '{RISK_AXIS}' and facet_label not in {_in(HARMLESS)}) nonzero_risk from fac group by 1) x on x.benchmark_id = cat.benchmark_id)
"""
_RU = VIEWS + ", " + _RISK + ", ru as (select ded.*, raw_weight w, benchmark_name, " + ", ".join(f"coalesce({f}, false) {f}" for f in RISK_FLAGS) + " from ded left join rk using (benchmark_id))"
_LONG = f"""lx as (select fl.benchmark_id, b.p is_long_context_primary, b.b is_long_context_broad, is_agentic, is_multimodal, is_coding, is_agentic or is_multimodal is_agentic_or_multimodal, is_agentic and is_multimodal is_agentic_and_multimodal from fl join
  (select benchmark_id, bool_or(facet_axis = 'context_pressure' and facet_label in {_in(PRIMARY)}) p, bool_or(facet_axis = 'context_pressure' and facet_label in {_in(BROAD)}) b from fac group by 1) b using (benchmark_id))
"""
_LU = UNITS + ", " + _LONG + ", lu as (select ded.*, " + period_sql("release_year", "hypothesis") + " period, coalesce(is_long_context_broad, false) broad, coalesce(is_long_context_primary, false) prim from ded left join lx using (benchmark_id) where release_year >= 2024)"
_LIFE_FLAGS = ("created", "opaque", "created_or_opaque", "own_created_or_opaque")


def _life_sql(key: str) -> str:
    cols = ", ".join(f"count_if({f}) {f}_mentions, round(count_if({f})::double / count(*), 6) {f}_share" for f in _LIFE_FLAGS)
    return provenance.ENRICHED + ", " + _RISK + f""", x as (select en.provider, en.release_year, {period_sql("en.release_year", "two_years")} period, coalesce(created, false) created, coalesce(opaque, false) opaque, coalesce(created_or_opaque, false) created_or_opaque,
  coalesce(created_or_opaque, false) and coalesce(list_contains(labs, provider), false) own_created_or_opaque from en left join rk on rk.benchmark_id = en.benchmark_id)
select provider, {key}, count(*) total_mentions, {cols} from x where {key} is not null group by 1, 2"""


_HU = UNITS + ", hu as (select * replace (" + period_sql("release_year", "hypothesis") + " as period) from un where release_year >= 2024)"
_PCT = "case when s > 0 and s < 0.01 then '<1%' else format('{:.1f}%', s * 100) end"

SQL = {
    "risk_flags": VIEWS + ", " + _RISK + "select * from rk",
    "strategy_flags": UNITS + ", " + _LONG + "select * from lx",
    "risk_by_release": _RU + "select model_row_id, provider, release_date, release_year, sum(multiplicity)::bigint resolved_mentions, " + ", ".join(f"round(sum(case when {f} then w else 0 end), 6) {f}_share, sum(case when {f} then multiplicity else 0 end)::bigint {f}_mentions" for f in RISK_FLAGS)
    + ", " + ", ".join(f"coalesce(string_agg(distinct benchmark_name, '; ' order by benchmark_name) filter ({f}), '') {f}_benchmarks" for f in ("created_or_opaque", "internal_named")) + " from ru group by 1, 2, 3, 4",
    "risk_by_provider": _RU + "select provider, count(distinct model_row_id) releases, round(sum(w), 6) weighted_mentions, " + ", ".join(f"round(sum(case when {f} then w else 0 end), 6) {f}_weight, sum(case when {f} then multiplicity else 0 end)::bigint {f}_mentions, round(sum(case when {f} then w else 0 end) / sum(w), 6) {f}_share" for f in RISK_FLAGS) + " from ru group by 1",
    "risk_portfolio": UNITS + f"select provider, facet_label, round(sum(w / k), 6) weight, round(sum(w / k) / sum(sum(w / k)) over (partition by provider), 6) share from un join lk using (benchmark_id) where facet_axis = '{RISK_AXIS}' group by 1, 2",
    "lifecycle_period_shares": _life_sql("period"),
    "lifecycle_year_shares": _life_sql("release_year"),
    "provider_lifecycle_all": LIFE + f"select cat.benchmark_id, benchmark_name, review_status, pr.provider, pl.* exclude (benchmark_id, provider, launch_count, model_row_count), coalesce(launch_count, 0) launch_count, coalesce(model_row_count, 0)::bigint model_row_count from cat cross join (select distinct coalesce(nullif(lower(trim(regexp_replace(provider, '\\s+', ' ', 'g'))), ''), 'unknown') provider from models) pr left join pl on pl.benchmark_id = cat.benchmark_id and pl.provider = pr.provider",
    "overview_facts": LIFE + f""", lw as (select *, 1.0::double / count(*) over (partition by launch_id) weight from lm), b as (select benchmark_id, count(distinct provider) p, sum(weight) w from lw group by 1), y as (select max(year(release_date)) y from ev)
select {CUT} as_of, (select least(max(release_date), {CUT}) from ev) diffusion_followup_end, (select count(*) from lc) catalog_benchmarks, (select count_if(launch_count > 0) from lc) observed_benchmarks, (select count_if(launch_count = 1) from lc) single_launch_benchmarks, (select count_if(provider_count > 1) from lc) shared_benchmarks, (select count_if(provider_count = 3) from lc) all_three_benchmarks,
(select median(second_provider_lag_days) filter (provider_count > 1) from lc) shared_conditional_median_lag_days, (select count_if(launch_count = 1 and year(first_seen) = y) from lc, y) single_launch_first_seen_latest_year, (select sum(model_row_count)::bigint from ev) model_rows, (select count(*) from ev) launch_events, (select count_if(has_benchmark_mentions) from ev) benchmark_bearing_launches, (select y from y) latest_release_year,
(select count(*) from lm) launch_mentions, (select round(sum(launch_count) filter (provider_count > 1)::double / (select count(*) from lm), 6) from lc) shared_mention_share, (select round(sum(w) filter (p > 1) / (select count_if(has_benchmark_mentions) from ev), 6) from b) shared_announcement_weight_share,
(select count(*) from men) raw_model_mentions, (select count(distinct (model_row_id, benchmark_id)) from men) canonical_model_mentions, (select count(*) from facall) facet_rows, (select count_if(review_status = 'accepted') from facall) facet_accepted, (select count_if(review_status = 'needs_review') from facall) facet_needs_review, (select count_if(review_status = 'legacy_seed') from facall) facet_legacy_seed""",
    "cascade_table": provenance._CASCADE + """select casc.*, raw_variants, benchmark_name, source_author, frontier_lab_author_affiliations, legacy_task_mode, legacy_task_domain, coalesce(len(list_intersect(string_split(first_providers, '; '), makers)) > 0, false) first_provider_is_author_affiliated from casc
join (select benchmark_id, string_agg(distinct raw_mention, '; ' order by raw_mention) raw_variants from men group by 1) using (benchmark_id) left join (select benchmark_id, benchmark_name, source_author, frontier_lab_author_affiliations, legacy_task_mode, legacy_task_domain from cat) using (benchmark_id) left join (select benchmark_id, list_concat(labs, authors) makers from dim) using (benchmark_id)""",
    "network_summary": provenance._CASCADE + provenance._EVENTS + provenance._SIM + f""", ro as (select provider, count_if(is_first_provider and f > 0) - count_if(not is_first_provider) v from (select *, count_if(not is_first_provider) over (partition by benchmark_id) f from ae) group by 1),
fr as (select benchmark_id || ': ' || first_providers || ' -> ' || second_provider detail, days_to_second_provider v, benchmark_id from casc where cross_provider_cascade and days_to_second_provider is not null), de as ({provenance._share_sql("provider", "source_group", provenance.GROUPS)})
select metric, round("value"::double, 3) "value", detail from (select 'resolved_mentions' metric, (select count(*) from men)::double "value", '' detail union all select 'unique_benchmarks_mentioned', (select count(distinct benchmark_id) from men), '' union all select 'cross_provider_cascades', (select count_if(cross_provider_cascade) from casc), '' union all select 'single_provider_benchmarks', (select count_if(not cross_provider_cascade) from casc), ''
union all from (select 'fastest_cascade', v, detail from fr order by v, benchmark_id limit 5) union all from (select 'slowest_cascade', v, detail from fr order by v desc, benchmark_id limit 5) union all select 'provider_net_export_balance', v, provider from ro
union all select 'latest_portfolio_similarity', jaccard_similarity, left_provider || ' / ' || right_provider from st where snapshot_date = (select max(release_date) from rel) union all select 'self_affiliated_mention_share', self_affiliated_share, provider from de)""",
    "hypothesis_period_summary": _HU + f""", r as (select provider, {period_sql("release_year", "hypothesis")} period, count(*) release_count, count(b) benchmarked_release_count from (select *, year(release_date) release_year from rel) left join (select distinct model_row_id, 1 b from hu) using (model_row_id) where release_year >= 2024 group by 1, 2),
m as (select provider, period, sum(multiplicity)::bigint raw_mention_count, round(sum(w), 6) normalized_release_mentions, count(distinct benchmark_id) unique_benchmark_count, """ + ", ".join(f"round(sum(case when {f} then w else 0 end) / sum(w), 6) {f[3:]}_share" for f in composition.FLAGS) + """ from hu group by 1, 2)
select provider, period, release_count, benchmarked_release_count, coalesce(raw_mention_count, 0) raw_mention_count, coalesce(normalized_release_mentions, 0) normalized_release_mentions, coalesce(unique_benchmark_count, 0) unique_benchmark_count, """ + ", ".join(f"coalesce({f[3:]}_share, 0) {f[3:]}_share" for f in composition.FLAGS) + " from r left join m using (provider, period)",
    "hypothesis_axis_shares": _HU + "select provider, period, facet_axis, facet_label, round(sum(w / k), 6) weighted_mentions, sum(multiplicity)::bigint raw_mention_count, round(sum(w / k) / any_value(t), 6) share from hu join lk using (benchmark_id) join (select provider, period, sum(w) t from hu group by 1, 2) using (provider, period) group by 1, 2, 3, 4",
    "long_context_by_period": _LU + "select provider, period, round(sum(release_weight), 6) release_weight_total, sum(multiplicity)::bigint raw_mentions, round(sum(case when broad then release_weight else 0 end), 6) broad_weight, round(sum(case when prim then release_weight else 0 end), 6) primary_weight, count(distinct model_row_id) benchmarked_releases, round(sum(case when broad then release_weight else 0 end) / sum(release_weight), 6) broad_share, round(sum(case when prim then release_weight else 0 end) / sum(release_weight), 6) primary_share from lu group by 1, 2",
    "long_context_drivers": _LU + "select provider, period, benchmark_id, round(sum(release_weight), 6) weighted_mentions, sum(multiplicity)::bigint raw_mentions, string_agg(distinct model_name, '; ' order by model_name) models, any_value(context_labels) context_labels from lu left join (select benchmark_id, string_agg(distinct facet_label, '; ' order by facet_label) context_labels from fac where facet_axis = 'context_pressure' group by 1) using (benchmark_id) where broad group by 1, 2, 3",
    "run_summary": VIEWS + f"""select unnest(['total_mentions', 'unique_benchmarks', 'models_with_mentions', 'providers', 'periods']) "key", unnest([count(*)::varchar, count(distinct benchmark_id)::varchar, count(distinct (provider, model_name, release_date))::varchar, string_agg(distinct provider, '; ' order by provider), string_agg(distinct period, '; ' order by period)]) "value" from (select *, {period_sql("release_year", "two_years")} period from men)""",
    "period_labels": VIEWS + f"""select model_row_id, release_year, {", ".join(f"{period_sql('release_year', s)} {s}" for s in SCHEMES)}, case when release_year = year({CUT}) then release_year || ' YTD' else release_year::varchar end year_label, {_PCT} share_text, format('{{:,}}', n) count_text
from (select model_row_id, year(release_date)::bigint release_year, count(*) over (partition by year(release_date)) n, 1.0::double / count(*) over (partition by year(release_date)) s from rel)""",
    "release_keys": VIEWS + "select model_row_id, provider || '|' || model_name || '|' || strftime(release_date, '%Y-%m-%d') model_key, trim(regexp_replace(lower('release_' || provider || '_' || model_name || '_' || strftime(release_date, '%Y-%m-%d')), '[^a-z0-9]+', '_', 'g'), '_') ascii_id, trim(regexp_replace(lower('release_' || provider || '_' || model_name || '_' || strftime(release_date, '%Y-%m-%d')), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') letter_id from rel",
    "facet_status_pivot": VIEWS + "select facet_axis, " + ", ".join(f"count_if(review_status = '{s}') {s}" for s in composition.STATUSES) + " from facall group by 1",
    "facet_status_long": VIEWS + f"select a.facet_axis, s.review_status, count(f.facet_row_id) facet_rows from (select distinct facet_axis from facall) a cross join (select unnest({list(composition.STATUSES)}) review_status) s left join facall f on f.facet_axis = a.facet_axis and f.review_status = s.review_status group by 1, 2",
    "import_lags_rounded": provenance.ENRICHED + provenance._EVENTS + "select provider, count(*) imports, round_even(round(avg(lag_days_since_benchmark_first), 9), 1) mean_lag, round_even(median(lag_days_since_benchmark_first), 1) median_of_lags from ae where not is_first_provider group by provider",
    "isolated_share_days": "select \"day\", category, share is not null covered, share is not null and lag(share) over (partition by category order by \"day\") is null and lead(share) over (partition by category order by \"day\") is null isolated from (" + composition.SQL["domain_trend"].replace(f"interval {composition.WINDOW_DAYS - 1} days", "interval 1 days") + ")",
    "stacked_portfolio": UNITS + ", c as (select provider, facet_label, sum(w / k) v from un join lk using (benchmark_id) where facet_axis = 'domain' group by 1, 2) select provider, facet_label, round(v, 6) weight, round(sum(v) over w - v, 6) low, round(sum(v) over w, 6) high from c window w as (partition by provider order by facet_label)",
    "facets_with_headline": f"select benchmark_id, facet_axis, facet_label, confidence, review_status from ({VIEWS} select * from facall) union all select benchmark_id, '{HEADLINE_AXIS}', projection, confidence, 'needs_review' from ({composition.SQL['headline_projections']}) where benchmark_id not in (select benchmark_id from ({VIEWS} select * from fac where facet_axis = '{HEADLINE_AXIS}'))",
    "affiliations": VIEWS + "select benchmark_id, frontier_lab_author_affiliations on_record, coalesce(nullif(array_to_string([x for x in [" + ", ".join(f"case when regexp_matches(lower(source_author), '(^|[^a-z]){x.lower()}($|[^a-z])') then '{x}' end" for x in base.LABS) + "] if x is not null], '; '), ''), 'none') inferred from cat",
}
