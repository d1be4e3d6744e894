"""What releases measure: weighted, faceted compositions, frames, windows and trends: R34 to R59, R63 to R71."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.vocab import CONFIDENCE, CONSTRUCT_AXES, HEADLINE_AXIS, HEADLINE_RULES
from tidemark.operators.facets import headline_projection, with_headline
from tidemark.operators.shares import all_facet_weights, dedup_mentions, facet_weights, joined, ratio, ratio_or_zero, top_labels
from tidemark.operators.sizes import lookup_join
from tidemark.operators.trends import lanes, moving_ratio, rolling_share
from tidemark.plans import base
from tidemark.plans.base import CUT, VIEWS
from tidemark.plans.provenance import _PER, _period

AXES = ("context_pressure", "domain", "interaction_pattern", "metric", "modality")
#: Flags of a benchmark: the labels of an axis of which one must be present.
FLAGS = {
    "is_agentic": {"interaction_pattern": ("environment", "tool_use")},
    "is_multimodal": {"modality": ("audio", "image", "table")},
    "is_coding": {"domain": ("software",), "modality": ("code",)},
    "is_long_context": {"context_pressure": ("long", "very_long")},
    "is_work": {"interaction_pattern": ("environment",), "metric": ("cost",)},
    "is_specialized": {"domain": ("chemistry", "finance", "law")},
    "is_risky": {"context_pressure": ("unknown",)},
}
STATUSES = ("accepted", "needs_review", "legacy_seed", "disputed")
RECENT_DAYS = 365
WINDOW_DAYS = 90
TREND_LABELS, TREND_DAYS = 10, 180
_FLAGS = (*FLAGS, "is_static", "is_complete")


def _flags(facets: DataFrame) -> DataFrame:
    hit = lambda spec: F.coalesce(F.bool_or(F.expr(" or ".join(f"(facet_axis = '{a}' and facet_label in ({', '.join(repr(x) for x in ls)}))" for a, ls in spec.items()))), F.lit(False))
    g = facets.groupBy("benchmark_id").agg(*[hit(s).alias(k) for k, s in FLAGS.items()], hit({"interaction_pattern": ("single_turn",)}).alias("single"), F.size(F.collect_set("facet_axis")).cast("bigint").alias("axes_covered"))
    return g.withColumn("is_static", F.col("single") & ~F.col("is_work")).withColumn("is_complete", F.col("axes_covered") == len(AXES)).drop("single")


@base.scoped
def benchmark_flags(spark: SparkSession, d: str) -> DataFrame:
    """The flags of every labelled benchmark, and on how many axes it is labelled."""
    return _flags(base.facets(spark, d))


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Mentions per release and benchmark with period and flags; w is the share of the release's mentions."""
    u = dedup_mentions(base.mentions(spark, d)).withColumn("release_year", F.year("release_date").cast("bigint"))
    u = lookup_join(u.withColumnRenamed("raw_weight", "w"), benchmark_flags(spark, d), "benchmark_id", "left").na.fill(False, list(_FLAGS))
    return u.withColumn("period", _period())


@base.scoped
def provider_period_summary(spark: SparkSession, d: str) -> DataFrame:
    """Releases, mentions and weighted shares by provider and period; all releases count, mentioned or not."""
    u = _units(spark, d)
    bearing = u.select("model_row_id", F.lit(1).alias("b")).distinct()
    rel = base.releases(spark, d).withColumn("release_year", F.year("release_date")).withColumn("period", _period()).join(bearing, "model_row_id", "left")
    left = rel.groupBy("provider", "period").agg(F.count("*").alias("release_count"), F.count("b").alias("benchmarked_release_count"))
    share = [ratio_or_zero(F.sum(F.when(F.col(f), F.col("w")).otherwise(0.0)), F.sum("w")).alias(f"{f[3:]}_share") for f in FLAGS]
    right = u.groupBy("provider", "period").agg(F.sum("multiplicity").alias("raw_mention_count"), F.round(F.sum("w"), 6).alias("normalized_release_mentions"), F.count_distinct("benchmark_id").alias("unique_benchmark_count"), ratio_or_zero(F.sum("multiplicity"), F.count_distinct("model_name")).alias("avg_benchmarks_per_benchmarked_release"), *share)
    return left.join(right, ["provider", "period"], "left").na.fill(0)


@base.scoped
def axis_shares(spark: SparkSession, d: str) -> DataFrame:
    """Label shares of all axes by provider and period; the denominator is the weight of all mentions, labelled or not."""
    u = _units(spark, d).groupBy("provider", "period", "benchmark_id").agg(F.sum("w").alias("w"), F.sum("multiplicity").alias("n"))
    total = u.groupBy("provider", "period").agg(F.sum("w").alias("t"))
    out = all_facet_weights(u, base.facets(spark, d), AXES, "w").groupBy("provider", "period", "facet_axis", "facet_label").agg(F.sum("label_weight").alias("lw"), F.sum("n").alias("raw_mention_count"))
    return out.join(total, ["provider", "period"]).select("provider", "period", "facet_axis", "facet_label", F.round("lw", 6).alias("weighted_mentions"), "raw_mention_count", ratio(F.col("lw"), F.col("t")).alias("share"))


@base.scoped
def benchmark_drivers(spark: SparkSession, d: str) -> DataFrame:
    """What each benchmark adds to a provider's period, with its flags."""
    u = _units(spark, d)
    g = u.groupBy("provider", "period", "benchmark_id").agg(F.sum("multiplicity").alias("raw_mentions"), F.sum("w").alias("w"), *[F.bool_or(f).alias(f) for f in FLAGS])
    return g.select("provider", "period", "benchmark_id", "raw_mentions", F.round("w", 6).alias("weighted_mentions"), ratio(F.col("w"), F.sum("w").over(Window.partitionBy("provider", "period"))).alias("share"), *FLAGS)


@base.scoped
def facet_status_summary(spark: SparkSession, d: str) -> DataFrame:
    """Active facet rows by axis and status, with the share within the axis."""
    g = base.facets(spark, d).groupBy("facet_axis", "review_status").agg(F.count("*").alias("facet_rows"))
    return g.withColumn("share", ratio(F.col("facet_rows"), F.sum("facet_rows").over(Window.partitionBy("facet_axis"))))


@base.scoped
def launch_density(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of every release, and how many were resolved; 0 where there are none."""
    from tidemark.sources.tables import load

    m = load(spark, d, "mentions").where(F.col("release_date") <= F.lit(base.cutoff(spark, d))).groupBy("mention_id").agg(F.min("model_row_id").alias("model_row_id"), F.max(F.col("benchmark_id").isNotNull()).alias("ok"))
    g = m.groupBy("model_row_id").agg(F.count("*").alias("raw_mentions"), F.count_if("ok").alias("resolved_mentions"))
    out = base.releases(spark, d).select("model_row_id", "provider", "release_date").join(g, "model_row_id", "left").na.fill(0)
    return out.withColumn("unresolved_mentions", F.col("raw_mentions") - F.col("resolved_mentions")).withColumn("resolution_rate", ratio_or_zero(F.col("resolved_mentions"), F.col("raw_mentions")))


def _covered(spark: SparkSession, d: str, axis: str = "domain") -> DataFrame:
    u = _units(spark, d).groupBy("provider", "benchmark_id").agg(F.sum("w").alias("w"))
    return facet_weights(u, base.facets(spark, d), axis, "w").groupBy("provider", "facet_label").agg(F.sum("label_weight").alias("lw"))


@base.scoped
def covered_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """Label shares of one axis by provider; the denominator is the labelled weight."""
    c = _covered(spark, d)
    return c.select("provider", "facet_label", F.round("lw", 6).alias("weight"), ratio(F.col("lw"), F.sum("lw").over(Window.partitionBy("provider"))).alias("share"))


@base.scoped
def signature_lift(spark: SparkSession, d: str) -> DataFrame:
    """A provider's share of a label over the share of all providers together."""
    c = _covered(spark, d)
    whole = Window.partitionBy(F.lit(1))  # providers x labels rows
    own = F.col("lw") / F.sum("lw").over(Window.partitionBy("provider"))
    everyone = F.sum("lw").over(Window.partitionBy("facet_label")) / F.sum("lw").over(whole)
    return c.select("provider", "facet_label", F.round(own, 6).alias("share"), F.round(everyone, 6).alias("global_share"), ratio(own, everyone).alias("lift"))


@base.scoped
def release_frames(spark: SparkSession, d: str) -> DataFrame:
    """Weight of each flag within every release that has mentions."""
    u = _units(spark, d)
    return u.groupBy("model_row_id", "provider", "release_year").agg(F.sum("multiplicity").alias("raw_mentions"), *[F.round(F.sum(F.when(F.col(f), F.col("w")).otherwise(0.0)), 6).alias(f"{f[3:]}_share") for f in _FLAGS])


@base.scoped
def annual_frames(spark: SparkSession, d: str) -> DataFrame:
    """Yearly means of the releases' shares, each release alike, by provider."""
    u = _units(spark, d)
    r = u.groupBy("model_row_id", "provider", "release_year").agg(*[F.sum(F.when(F.col(f), F.col("w")).otherwise(0.0)).alias(f) for f in _FLAGS])
    return r.groupBy("provider", "release_year").agg(F.count("*").alias("releases"), *[F.round(F.avg(f), 6).alias(f"mean_{f[3:]}_share") for f in _FLAGS])


@base.scoped
def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """R55 in part: the yearly mean share of acting benchmarks under variants of what counts: without risky ones, with two mentions or more, both,
    and completely labelled ones only; weights are shared out anew among what is left. Mentions are counted before anything is left out.
    All active labels count, however sure; sensitivity_confident has the variants of sure labels."""
    u = _units(spark, d).select("model_row_id", "release_year", "benchmark_id", "multiplicity", "is_risky", "is_complete", "is_agentic")
    often = u.groupBy("benchmark_id").agg(F.sum("multiplicity").alias("times"))
    u = lookup_join(u, often, "benchmark_id")
    v = F.explode(F.array(*map(F.lit, ("all", "exclude_risk", "min_mentions", "exclude_risk_min_mentions", "complete_axes")))).alias("variant")
    x = u.select("*", v)
    keep = F.when(F.col("variant").contains("exclude_risk"), ~F.col("is_risky")).otherwise(True) & F.when(F.col("variant").contains("min_mentions"), F.col("times") >= 2).otherwise(True) & F.when(F.col("variant") == "complete_axes", F.col("is_complete")).otherwise(True)
    r = x.where(keep).groupBy("variant", "model_row_id", "release_year").agg((F.sum(F.when(F.col("is_agentic"), F.col("multiplicity")).otherwise(0)) / F.sum("multiplicity")).alias("s"))
    return r.groupBy("variant", "release_year").agg(F.count("*").alias("releases"), F.round(F.avg("s"), 6).alias("mean_agentic_share"))


@base.scoped
def sensitivity_confident(spark: SparkSession, d: str) -> DataFrame:
    """The yearly mean share of acting benchmarks by labels of a confidence of CONFIDENCE or more: a lower bound over all mentions, and over the benchmarks
    that such labels cover on every axis, weights shared out anew among these."""
    u = dedup_mentions(base.mentions(spark, d)).select("model_row_id", F.year("release_date").cast("bigint").alias("release_year"), "benchmark_id", "multiplicity")
    u = lookup_join(u, _flags(base.facets(spark, d).where(F.col("confidence") >= CONFIDENCE)), "benchmark_id", "left").na.fill(False, ["is_agentic", "is_complete"])
    x = u.select("*", F.explode(F.array(F.lit("confident_lower_bound"), F.lit("confident_complete_axes"))).alias("variant"))
    r = x.where((F.col("variant") == "confident_lower_bound") | F.col("is_complete")).groupBy("variant", "model_row_id", "release_year").agg((F.sum(F.when(F.col("is_agentic"), F.col("multiplicity")).otherwise(0)) / F.sum("multiplicity")).alias("s"))
    return r.groupBy("variant", "release_year").agg(F.count("*").alias("releases"), F.round(F.avg("s"), 6).alias("mean_agentic_share"))


@base.scoped
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """In the last year, each provider's shares of the four heaviest labels of each axis; the denominator is all labels."""
    u = _units(spark, d).where(F.col("release_date") >= F.date_sub(F.lit(base.cutoff(spark, d)), RECENT_DAYS)).groupBy("provider", "benchmark_id").agg(F.sum("w").alias("w"))
    g = all_facet_weights(u, base.facets(spark, d), AXES, "w").groupBy("provider", "facet_axis", "facet_label").agg(F.sum("label_weight").alias("lw"))
    g = g.withColumn("total", F.round(F.sum("lw").over(Window.partitionBy("facet_axis", "facet_label")), 9))  # providers x labels rows
    g = g.withColumn("place", F.dense_rank().over(Window.partitionBy("facet_axis").orderBy(F.desc("total"), "facet_label")))
    g = g.withColumn("share_of_provider_axis", ratio(F.col("lw"), F.sum("lw").over(Window.partitionBy("provider", "facet_axis"))))
    return g.where("place <= 4").select("provider", "facet_axis", "facet_label", F.round("lw", 6).alias("weighted_mentions"), "share_of_provider_axis")


@base.scoped
def pair_flow(spark: SparkSession, d: str) -> DataFrame:
    """Weight that runs from a domain to an interaction; labels outside the three heaviest and below 2.5 percent are Other. A benchmark's weight
    is split over the pairs of its labels."""
    u = _units(spark, d).where(F.col("release_date") >= F.date_sub(F.lit(base.cutoff(spark, d)), RECENT_DAYS)).groupBy("benchmark_id").agg(F.sum("w").alias("w"), F.sum("multiplicity").alias("n"))
    f = base.facets(spark, d)
    side = lambda axis, x: f.where(F.col("facet_axis") == axis).groupBy("benchmark_id", F.col("facet_label").alias(x)).agg(F.max("confidence").alias(f"c_{x}"), F.bool_and(F.col("review_status") == "accepted").alias(f"a_{x}")).withColumn(f"k_{x}", F.count("*").over(Window.partitionBy("benchmark_id")))
    p = u.join(side("domain", "domain"), "benchmark_id").join(side("interaction_pattern", "interaction"), "benchmark_id")
    p = p.withColumn("pw", F.col("w") / (F.col("k_domain") * F.col("k_interaction"))).withColumn("both", F.col("a_domain") & F.col("a_interaction"))
    p = top_labels(top_labels(p, "domain", "pw", 3, 0.025), "interaction", "pw", 3, 0.025)
    g = p.groupBy("domain", "interaction").agg(F.sum("pw").alias("weight"), F.round(F.avg((F.col("c_domain") + F.col("c_interaction")) / 2), 6).alias("mean_confidence"), F.round(F.avg(F.col("both").cast("double")), 6).alias("accepted_pair_share"), F.sum("n").alias("raw_mentions"))
    return g.withColumn("share", ratio(F.col("weight"), F.sum("weight").over(Window.partitionBy(F.lit(1))))).withColumn("weight", F.round("weight", 6))


@base.scoped
def review_leverage(spark: SparkSession, d: str) -> DataFrame:
    """Recent weight times the share of label rows that are not accepted; without any row that share is 1."""
    u = _units(spark, d).where(F.col("release_date") >= F.date_sub(F.lit(base.cutoff(spark, d)), RECENT_DAYS))
    m = u.groupBy("benchmark_id", "provider").agg(F.sum("w").alias("w"), F.sum("multiplicity").alias("n")).groupBy("benchmark_id").agg(F.sum("w").alias("w"), F.sum("n").alias("recent_raw_mentions"), F.count("*").alias("provider_count"), joined("provider").alias("providers"))
    s = base.facets(spark, d).groupBy("benchmark_id").agg(F.count_if(F.col("review_status").isin(*STATUSES)).alias("facet_rows"), F.count_if(F.col("review_status") == "accepted").alias("accepted"))
    out = m.join(s, "benchmark_id", "left").na.fill(0, ["facet_rows", "accepted"])
    non = 1 - F.coalesce(F.try_divide(F.col("accepted"), F.col("facet_rows")), F.lit(0.0))
    return out.select("benchmark_id", F.round("w", 6).alias("recent_weighted_mentions"), "recent_raw_mentions", "provider_count", "providers", "facet_rows", F.round(non, 6).alias("nonaccepted_share"), F.round(F.col("w") * non, 6).alias("review_leverage"))


@base.scoped
def review_leverage_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten benchmarks whose review would change most."""
    return review_leverage(spark, d).select("benchmark_id", "review_leverage", "nonaccepted_share").orderBy(F.desc("review_leverage"), "benchmark_id").limit(10)


@base.scoped
def lifecycle_table(spark: SparkSession, d: str) -> DataFrame:
    """Active days and mentions a month of 30.44 days, one at least."""
    g = base.mentions(spark, d).groupBy("benchmark_id", "provider").agg(F.count("*").alias("n"), F.min("release_date").alias("a"), F.max("release_date").alias("b")).groupBy("benchmark_id").agg(F.sum("n").alias("mentions"), F.count("*").alias("provider_count"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    days = (F.datediff("last_seen", "first_seen") + 1).cast("bigint")
    return g.withColumn("active_days", days).withColumn("mentions_per_month", F.round(F.col("mentions") / F.greatest(F.lit(1.0), days / 30.44), 6))


@base.scoped
def long_context_case(spark: SparkSession, d: str) -> DataFrame:
    """Each provider's weight of long context in 2024, 0 where there is none, and the benchmark that drives it."""
    u = _units(spark, d).where("release_year = 2024").groupBy("provider", "benchmark_id").agg(F.sum("w").alias("w"), F.bool_or("is_long_context").alias("long"))
    lw = F.when(F.col("long"), F.col("w")).otherwise(0.0)
    g = u.groupBy("provider").agg(F.sum("w").alias("t"), F.sum(lw).alias("l"), F.max_by("benchmark_id", F.when(F.col("long"), F.struct(F.round("w", 6), F.transform(F.split("benchmark_id", ""), lambda c: -F.ascii(c))))).alias("main_driver"))
    out = base.releases(spark, d).select("provider").distinct().join(g, "provider", "left")
    return out.select("provider", F.coalesce(F.round("l", 6), F.lit(0.0)).alias("long_context_weight"), ratio_or_zero(F.col("l"), F.col("t")).alias("long_context_share"), F.coalesce("main_driver", F.lit("")).alias("main_driver"))


@base.scoped
def release_counts_smoothed(spark: SparkSession, d: str, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Mean number of benchmarks of the releases in the trailing window, those with none included."""
    n = base.mentions(spark, d).select("model_row_id", "benchmark_id").distinct().groupBy("model_row_id").agg(F.count("*").alias("n"))
    rows = base.releases(spark, d).select("model_row_id", "release_date").join(n, "model_row_id", "left").na.fill(0, ["n"])
    return moving_ratio(rows, "release_date", "n", base.cutoff(spark, d), base.positive_days(window_days))


@base.scoped
def timeline_status(spark: SparkSession, d: str) -> DataFrame:
    """Every release with its domain composition, how far it is labelled, and its status."""
    w = facet_weights(dedup_mentions(base.mentions(spark, d)).withColumnRenamed("raw_weight", "w"), base.facets(spark, d), "domain", "w")
    g = w.groupBy("model_row_id").agg(F.sum("label_weight").alias("c"), *[F.sum(F.when(F.col("facet_label") == x, F.col("label_weight")).otherwise(0.0)).alias(x) for x in ("chemistry", "finance", "general", "law", "software")])
    raw = base.mentions(spark, d).groupBy("model_row_id").agg(F.count("*").alias("raw_mention_count"))
    out = base.releases(spark, d).select("model_row_id", "provider", "release_date").join(raw, "model_row_id", "left").join(g, "model_row_id", "left").na.fill(0)
    status = F.when(F.col("raw_mention_count") == 0, "empty").when(F.col("c") == 0, "unclassified").when(F.col("c") < 1 - 1e-9, "partial").otherwise("projected")
    return out.select("model_row_id", "provider", "release_date", "raw_mention_count", F.round("c", 6).alias("projection_coverage"), status.alias("status"), *[ratio_or_zero(F.col(x), F.col("c")).alias(f"{x}_ratio") for x in ("chemistry", "finance", "general", "law", "software")])


@base.scoped
def domain_trend(spark: SparkSession, d: str, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Trailing shares of the domains, all but the three heaviest called Other; axis_trends has all axes."""
    w = facet_weights(dedup_mentions(base.mentions(spark, d)).withColumnRenamed("raw_weight", "w"), base.facets(spark, d), "domain", "w")
    w = w.groupBy("release_date", "facet_label").agg(F.sum("label_weight").alias("lw"))
    return rolling_share(top_labels(w, "facet_label", "lw", 3), "release_date", "facet_label", "lw", base.cutoff(spark, d), base.positive_days(window_days))


@base.scoped
def axis_trends(spark: SparkSession, d: str, window_days: int = TREND_DAYS, labels: int = TREND_LABELS) -> DataFrame:
    """(facet_axis, day, category, share), trailing shares of the labels of every axis and of the headline that the labels give, all but the
    `labels` heaviest of an axis called Other."""
    top = labels
    men = dedup_mentions(base.mentions(spark, d)).groupBy("release_date", "benchmark_id").agg(F.sum("raw_weight").alias("w"))
    labels = with_headline(base.facets(spark, d)).where(F.col("facet_axis").isin(*AXES, HEADLINE_AXIS)).select("benchmark_id", "facet_axis", "facet_label").distinct()
    labels = labels.withColumn("n", F.count("*").over(Window.partitionBy("benchmark_id", "facet_axis")))
    w = men.join(labels, "benchmark_id").groupBy("facet_axis", "release_date", "facet_label").agg(F.sum(F.col("w") / F.col("n")).alias("lw"))
    total = F.sum("lw").over(Window.partitionBy("facet_axis", "facet_label"))
    heaviest = F.dense_rank().over(Window.partitionBy("facet_axis").orderBy(F.desc("t"), "facet_label"))
    w = w.withColumn("t", F.round(total, 9)).withColumn("facet_label", F.when(heaviest <= top, F.col("facet_label")).otherwise("Other"))
    return rolling_share(w, "release_date", "facet_label", "lw", base.cutoff(spark, d), base.positive_days(window_days), by="facet_axis").withColumnRenamed("by", "facet_axis")


@base.scoped
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts over all mentions, those of the year before the last one, and all facet rows, deprecated ones too."""
    m, recent = base.mentions(spark, d), F.col("release_date") >= F.date_sub("latest", RECENT_DAYS)
    m = m.crossJoin(F.broadcast(m.agg(F.max("release_date").alias("latest"))))  # one row
    a = m.agg(
        F.max("release_date").alias("latest_release_date"), F.count_distinct("model_row_id").alias("model_rows_with_benchmarks"), F.count("*").alias("resolved_mentions"), F.count_distinct("benchmark_id").alias("unique_resolved_benchmarks"),
        F.count_if(recent).alias("recent_365d_resolved_mentions"), F.count_distinct(F.when(recent, F.col("benchmark_id"))).alias("recent_365d_unique_benchmarks"),
    )
    f = base.facets(spark, d, False).agg(F.count("*").alias("facet_rows"), *[F.count_if(F.col("review_status") == x).alias(f"facet_{x}_rows") for x in ("needs_review", "legacy_seed", "accepted")])
    return a.crossJoin(f)  # a row each


@base.scoped
def story_summary(spark: SparkSession, d: str) -> DataFrame:
    """(metric, value) of the cutoff, mentions, benchmarks and releases that have some; a benchmark counts once a release."""
    m = base.mentions(spark, d).select("model_row_id", "benchmark_id").distinct().agg(F.count("*").alias("m"), F.count_distinct("benchmark_id").alias("b"), F.count_distinct("model_row_id").alias("r"))
    rows = {"as_of": F.lit(str(base.cutoff(spark, d))), "resolved_mentions": F.col("m"), "unique_benchmarks": F.col("b"), "benchmarked_releases": F.col("r")}
    return m.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in rows.items()])))


@base.scoped
def headline_projections(spark: SparkSession, d: str) -> DataFrame:
    """The headline projection that each benchmark's labels give by the rules in their order."""
    return headline_projection(base.facets(spark, d))


@base.scoped
def timeline_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Lanes for the releases of a timeline chart with labels 30 days wide."""
    rows = base.releases(spark, d).select("provider", "release_date", F.format_string("%s #%012d", "model_name", "model_row_id").alias("label"))
    return lanes(rows, "provider", "release_date", "label", 30.0)


QUERIES = {f.__name__: f for f in (
    benchmark_flags, provider_period_summary, axis_shares, benchmark_drivers, facet_status_summary, launch_density, covered_portfolio, signature_lift, release_frames, annual_frames, sensitivity, sensitivity_confident, fingerprints, pair_flow,
    review_leverage, review_leverage_top, lifecycle_table, long_context_case, release_counts_smoothed, timeline_status, domain_trend, axis_trends, summary_stats, story_summary, headline_projections, timeline_lanes,
)}


def _hit(spec: dict) -> str:
    return "coalesce(bool_or(" + " or ".join(f"(facet_axis = '{a}' and facet_label in ({', '.join(repr(x) for x in ls)}))" for a, ls in spec.items()) + "), false)"


UNITS = VIEWS + ", fl as (select * exclude (single), single and not is_work is_static, axes_covered = 5 is_complete from (select benchmark_id, " + ", ".join(f"{_hit(s)} {k}" for k, s in FLAGS.items()) + f""", {_hit({"interaction_pattern": ("single_turn",)})} single, count(distinct facet_axis) axes_covered from fac group by 1)),
un as (select ded.* exclude (raw_weight), raw_weight w, {_PER} period, """ + ", ".join(f"coalesce({f}, false) {f}" for f in _FLAGS) + """ from ded left join fl using (benchmark_id)),
lb as (select distinct benchmark_id, facet_axis, facet_label from fac), lk as (select *, count(*) over (partition by benchmark_id, facet_axis) k from lb)
"""
_DOM = ("chemistry", "finance", "general", "law", "software")

SQL = {
    "benchmark_flags": UNITS + "select * from fl",
    "provider_period_summary": UNITS + f""", r as (select provider, {_PER} period, count(*) release_count, count(b) benchmarked_release_count from (select *, year(release_date) release_year from rel) left join (select distinct model_row_id, 1 b from un) using (model_row_id) group by 1, 2),
m as (select provider, period, sum(multiplicity)::bigint raw_mention_count, round(sum(w), 6) normalized_release_mentions, count(distinct benchmark_id) unique_benchmark_count, round(sum(multiplicity)::double / count(distinct model_name), 6) avg_benchmarks_per_benchmarked_release, """ + ", ".join(f"round(sum(case when {f} then w else 0 end) / sum(w), 6) {f[3:]}_share" for f in FLAGS) + """ from un group by 1, 2)
select provider, period, release_count, benchmarked_release_count, coalesce(raw_mention_count, 0) raw_mention_count, coalesce(normalized_release_mentions, 0) normalized_release_mentions, coalesce(unique_benchmark_count, 0) unique_benchmark_count, coalesce(avg_benchmarks_per_benchmarked_release, 0) avg_benchmarks_per_benchmarked_release, """ + ", ".join(f"coalesce({f[3:]}_share, 0) {f[3:]}_share" for f in FLAGS) + " from r left join m using (provider, period)",
    "axis_shares": UNITS + "select provider, period, facet_axis, facet_label, round(sum(w / k), 6) weighted_mentions, sum(multiplicity)::bigint raw_mention_count, round(sum(w / k) / any_value(t), 6) share from un join lk using (benchmark_id) join (select provider, period, sum(w) t from un group by 1, 2) using (provider, period) group by 1, 2, 3, 4",
    "benchmark_drivers": UNITS + "select provider, period, benchmark_id, sum(multiplicity)::bigint raw_mentions, round(sum(w), 6) weighted_mentions, round(sum(w) / sum(sum(w)) over (partition by provider, period), 6) share, " + ", ".join(f"bool_or({f}) {f}" for f in FLAGS) + " from un group by 1, 2, 3",
    "facet_status_summary": VIEWS + "select facet_axis, review_status, count(*) facet_rows, round(count(*)::double / sum(count(*)) over (partition by facet_axis), 6) share from fac group by 1, 2",
    "launch_density": VIEWS + f", q as (select model_row_id, count(*) a, count_if(ok) b from (select mention_id, min(model_row_id) model_row_id, max(benchmark_id is not null) ok from mentions where release_date <= {CUT} group by 1) group by 1) select model_row_id, provider, release_date, coalesce(a, 0) raw_mentions, coalesce(b, 0) resolved_mentions, coalesce(a - b, 0) unresolved_mentions, coalesce(round(b::double / nullif(a, 0), 6), 0) resolution_rate from rel left join q using (model_row_id)",
    "covered_portfolio": UNITS + "select provider, facet_label, round(sum(w / k), 6) weight, round(sum(w / k) / sum(sum(w / k)) over (partition by provider), 6) share from un join lk using (benchmark_id) where facet_axis = 'domain' group by 1, 2",
    "signature_lift": UNITS + ", c as (select provider, facet_label, sum(w / k) lw from un join lk using (benchmark_id) where facet_axis = 'domain' group by 1, 2), s as (select provider, facet_label, lw / sum(lw) over (partition by provider) a, sum(lw) over (partition by facet_label) / sum(lw) over () b from c) select provider, facet_label, round(a, 6) share, round(b, 6) global_share, round(a / b, 6) lift from s",
    "release_frames": UNITS + "select model_row_id, provider, release_year, sum(multiplicity)::bigint raw_mentions, " + ", ".join(f"round(sum(case when {f} then w else 0 end), 6) {f[3:]}_share" for f in _FLAGS) + " from un group by 1, 2, 3",
    "annual_frames": UNITS + ", r as (select model_row_id, provider, release_year, " + ", ".join(f"sum(case when {f} then w else 0 end) {f}" for f in _FLAGS) + " from un group by 1, 2, 3) select provider, release_year, count(*) releases, " + ", ".join(f"round(avg({f}), 6) mean_{f[3:]}_share" for f in _FLAGS) + " from r group by 1, 2",
    "sensitivity": UNITS + """, x as (select un.*, times, v.variant from un join (select benchmark_id, sum(multiplicity) times from un group by 1) using (benchmark_id) cross join (select unnest(['all', 'exclude_risk', 'min_mentions', 'exclude_risk_min_mentions', 'complete_axes']) variant) v),
r as (select variant, model_row_id, release_year, sum(case when is_agentic then multiplicity else 0 end)::double / sum(multiplicity) s from x where (not contains(variant, 'exclude_risk') or not is_risky) and (not contains(variant, 'min_mentions') or times >= 2) and (variant <> 'complete_axes' or is_complete) group by 1, 2, 3)
select variant, release_year, count(*) releases, round(avg(s), 6) mean_agentic_share from r group by 1, 2""",
    "fingerprints": UNITS + f""", g as (select provider, facet_axis, facet_label, sum(w / k) lw from un join lk using (benchmark_id) where release_date >= {CUT} - {RECENT_DAYS} group by 1, 2, 3), s as (select *, round(lw / sum(lw) over (partition by provider, facet_axis), 6) share_of_provider_axis, round(sum(lw) over (partition by facet_axis, facet_label), 9) t from g),
k as (select facet_axis, facet_label, row_number() over (partition by facet_axis order by t desc, facet_label) r from (select distinct facet_axis, facet_label, t from s)) select provider, facet_axis, facet_label, round(lw, 6) weighted_mentions, share_of_provider_axis from s join k using (facet_axis, facet_label) where r <= 4""",
    "pair_flow": UNITS + f""", u as (select benchmark_id, sum(w) w, sum(multiplicity) n from un where release_date >= {CUT} - {RECENT_DAYS} group by 1), side as (select benchmark_id, facet_axis, facet_label, max(confidence) c, bool_and(review_status = 'accepted') a, count(*) over (partition by benchmark_id, facet_axis) k from fac group by 1, 2, 3),
p as (select a.facet_label dm, b.facet_label it, w / (a.k * b.k) pw, n, (a.c + b.c) / 2 cf, a.a and b.a acc from u join side a using (benchmark_id) join side b using (benchmark_id) where a.facet_axis = 'domain' and b.facet_axis = 'interaction_pattern'),
kd as (select dm from (select dm, row_number() over (order by round(sum(pw), 9) desc, dm) r, sum(pw) / sum(sum(pw)) over () s from p group by 1) where r <= 3 or s >= 0.025), ki as (select it from (select it, row_number() over (order by round(sum(pw), 9) desc, it) r, sum(pw) / sum(sum(pw)) over () s from p group by 1) where r <= 3 or s >= 0.025)
select case when dm in (from kd) then dm else 'Other' end "domain", case when it in (from ki) then it else 'Other' end interaction, round(sum(pw), 6) weight, round(avg(cf), 6) mean_confidence, round(avg(acc::int), 6) accepted_pair_share, sum(n)::bigint raw_mentions, round(sum(pw) / sum(sum(pw)) over (), 6) share from p group by 1, 2""",
    "review_leverage": UNITS + f""", m as (select benchmark_id, sum(w) w, sum(multiplicity)::bigint recent_raw_mentions, count(distinct provider) provider_count, string_agg(distinct provider, '; ' order by provider) providers from un where release_date >= {CUT} - {RECENT_DAYS} group by 1),
s as (select benchmark_id, count_if(review_status in {STATUSES}) fr, count_if(review_status = 'accepted') ac from fac group by 1), o as (select m.*, coalesce(fr, 0) facet_rows, 1 - coalesce(ac::double / nullif(fr, 0), 0) non from m left join s using (benchmark_id))
select benchmark_id, round(w, 6) recent_weighted_mentions, recent_raw_mentions, provider_count, providers, facet_rows, round(non, 6) nonaccepted_share, round(w * non, 6) review_leverage from o""",
    "lifecycle_table": VIEWS + "select benchmark_id, count(*) mentions, count(distinct provider) provider_count, min(release_date) first_seen, max(release_date) last_seen, datediff('day', min(release_date), max(release_date)) + 1 active_days, round(count(*)::double / greatest(1.0, (datediff('day', min(release_date), max(release_date)) + 1) / 30.44::double), 6) mentions_per_month from men group by 1",
    "long_context_case": UNITS + ", u as (select provider, benchmark_id, sum(w) w, bool_or(is_long_context) lc from un where release_year = 2024 group by 1, 2), g as (select provider, sum(w) t, sum(case when lc then w else 0 end) l from u group by 1), b as (select provider, benchmark_id, row_number() over (partition by provider order by round(w, 6) desc, benchmark_id) r from u where lc) select p.provider, coalesce(round(l, 6), 0) long_context_weight, coalesce(round(l / t, 6), 0) long_context_share, coalesce(b.benchmark_id, '') main_driver from (select distinct provider from rel) p left join g using (provider) left join b on b.provider = p.provider and r = 1",
    "release_counts_smoothed": VIEWS + f""", x as (select release_date d, sum(coalesce(n, 0)) v, count(*) c from rel left join (select model_row_id, count(distinct benchmark_id) n from men group by 1) using (model_row_id) group by 1), sp as (select unnest(generate_series((select min(d) from x), {CUT}, interval 1 day))::date d),
r as (select sp.d, round(sum(v) over w / nullif(sum(c) over w, 0)::double, 6) m from sp left join x using (d) window w as (order by sp.d range between interval {WINDOW_DAYS - 1} days preceding and current row)) select d "day", coalesce(last_value(m ignore nulls) over (order by d rows between unbounded preceding and current row), 0) average from r""",
    "timeline_status": UNITS + ", g as (select model_row_id, sum(w / k) c, " + ", ".join(f"sum(case when facet_label = '{x}' then w / k else 0 end) {x}" for x in _DOM) + " from un join lk using (benchmark_id) where facet_axis = 'domain' group by 1) select model_row_id, provider, release_date, coalesce(n, 0) raw_mention_count, coalesce(round(c, 6), 0) projection_coverage, case when coalesce(n, 0) = 0 then 'empty' when coalesce(c, 0) = 0 then 'unclassified' when c < 1 - 1e-9 then 'partial' else 'projected' end status, " + ", ".join(f"coalesce(round({x} / nullif(c, 0), 6), 0) {x}_ratio" for x in _DOM) + " from rel left join (select model_row_id, count(*) n from men group by 1) using (model_row_id) left join g using (model_row_id)",
    "domain_trend": UNITS + f""", e as (select release_date d, facet_label l, sum(w / k) lw from un join lk using (benchmark_id) where facet_axis = 'domain' group by 1, 2), kp as (select l from (select l, row_number() over (order by round(sum(lw), 9) desc, l) r from e group by 1) where r <= 3),
dy as (select d, case when l in (from kp) then l else 'Other' end c, sum(lw) lw, count(*) n from e group by 1, 2), sp as (select unnest(generate_series((select min(d) from dy), {CUT}, interval 1 day))::date d),
s as (select sp.d, q.c, coalesce(sum(lw) over w, 0) w, coalesce(sum(n) over w, 0) n from sp cross join (select distinct c from dy) q left join dy on dy.d = sp.d and dy.c = q.c window w as (partition by q.c order by sp.d range between interval {WINDOW_DAYS - 1} days preceding and current row))
select d "day", c category, case when sum(n) over (partition by d) > 0 then round(w / sum(w) over (partition by d), 6) end share from s""",
}
SQL["review_leverage_top"] = "select benchmark_id, review_leverage, nonaccepted_share from (" + SQL["review_leverage"] + ") order by review_leverage desc, benchmark_id limit 10"


def _rule(spec: dict) -> str:
    return "bool_or(" + " or ".join(f"(axis = '{a.removeprefix('!')}' and label {'not ' * (a[0] == '!')}in ({', '.join(repr(x) for x in ls)}))" for a, ls in spec.items()) + ")"


_RULE_AXES = sorted({a.removeprefix("!") for _, r in HEADLINE_RULES for a in r})
SQL["headline_projections"] = VIEWS + f""", x as (select benchmark_id, case when facet_axis in {CONSTRUCT_AXES} then 'construct_claim' else facet_axis end axis, lower(trim(facet_label)) label, confidence from fac)
select * from (select benchmark_id, case {" ".join(f"when {_rule(r)} then '{n}'" for n, r in HEADLINE_RULES)} end projection, coalesce(min(confidence), {CONFIDENCE}) confidence from x where axis in {tuple(_RULE_AXES)} group by 1) where projection is not null"""
SQL["timeline_lanes"] = VIEWS.replace("with ", "with recursive ", 1) + """, o as (select provider, release_date, label, datediff('day', date '1970-01-01', release_date) x, row_number() over (partition by provider order by release_date, label) k from (select provider, release_date, model_name || ' #' || lpad(model_row_id::varchar, 12, '0') label from rel)),
r as (select provider, release_date, label, k, 0 lane, [x + 15] ends from o where k = 1 union all select provider, release_date, label, k, l, case when l < len(ends) then ends[1:l] || [x + 15] || ends[l + 2:] else ends || [x + 15] end
  from (select o.provider, o.release_date, o.label, o.k, o.x, r.ends, coalesce(list_position(list_transform(r.ends, lambda e: e <= o.x - 15), true), len(r.ends) + 1) - 1 l from r join o on o.provider = r.provider and o.k = r.k + 1))
select provider, release_date, label, lane::bigint lane from r"""
SQL["summary_stats"] = VIEWS + ", m as (select *, release_date >= (select max(release_date) from men) - " + str(RECENT_DAYS) + """ recent from men) select max(release_date) latest_release_date, count(distinct model_row_id) model_rows_with_benchmarks, count(*) resolved_mentions, count(distinct benchmark_id) unique_resolved_benchmarks,
count_if(recent) recent_365d_resolved_mentions, count(distinct benchmark_id) filter (recent) recent_365d_unique_benchmarks, (select count(*) from facall) facet_rows, (select count_if(review_status = 'needs_review') from facall) facet_needs_review_rows, (select count_if(review_status = 'legacy_seed') from facall) facet_legacy_seed_rows, (select count_if(review_status = 'accepted') from facall) facet_accepted_rows from m"""
SQL["story_summary"] = VIEWS + f"""select unnest(['as_of', 'resolved_mentions', 'unique_benchmarks', 'benchmarked_releases']) metric, unnest([strftime({CUT}, '%Y-%m-%d'), count(*)::varchar, count(distinct benchmark_id)::varchar, count(distinct model_row_id)::varchar]) "value" from ded"""
SQL["sensitivity_confident"] = VIEWS + f""", cf as (select benchmark_id, {_hit(FLAGS["is_agentic"])} ag, count(distinct facet_axis) = {len(AXES)} full_ from fac where confidence >= {CONFIDENCE} group by 1), x as (select ded.*, coalesce(ag, false) ag, coalesce(full_, false) full_, v.variant from ded left join cf using (benchmark_id) cross join (select unnest(['confident_lower_bound', 'confident_complete_axes']) variant) v),
r as (select variant, model_row_id, release_year, sum(case when ag then multiplicity else 0 end)::double / sum(multiplicity) s from x where variant = 'confident_lower_bound' or full_ group by 1, 2, 3) select variant, release_year, count(*) releases, round(avg(s), 6) mean_agentic_share from r group by 1, 2"""
SQL["axis_trends"] = VIEWS + f""", hp as ({SQL["headline_projections"]}), lx as (select distinct benchmark_id, facet_axis, facet_label from (select benchmark_id, facet_axis, facet_label from fac where facet_axis in {(*AXES, HEADLINE_AXIS)} union all select benchmark_id, '{HEADLINE_AXIS}', projection from hp where benchmark_id not in (select benchmark_id from fac where facet_axis = '{HEADLINE_AXIS}'))),
ly as (select *, count(*) over (partition by benchmark_id, facet_axis) k from lx), e as (select facet_axis a, release_date d, facet_label l, sum(raw_weight / k) lw from ded join ly using (benchmark_id) group by 1, 2, 3), kp as (select a, l, dense_rank() over (partition by a order by round(sum(lw), 9) desc, l) r from e group by 1, 2),
dy as (select e.a, d, case when r <= {TREND_LABELS} then e.l else 'Other' end c, sum(lw) lw, count(*) n from e join kp on kp.a = e.a and kp.l = e.l group by 1, 2, 3), sp as (select a, unnest(generate_series(min(d), {CUT}, interval 1 day))::date d from dy group by a),
s as (select sp.a, sp.d, q.c, coalesce(sum(lw) over w, 0) w, coalesce(sum(n) over w, 0) n from sp join (select distinct a, c from dy) q on q.a = sp.a left join dy on dy.a = sp.a and dy.d = sp.d and dy.c = q.c window w as (partition by sp.a, q.c order by sp.d range between interval {TREND_DAYS - 1} days preceding and current row))
select a facet_axis, d "day", c category, case when sum(n) over (partition by a, d) > 0 then round(w / sum(w) over (partition by a, d), 6) end share from s"""
