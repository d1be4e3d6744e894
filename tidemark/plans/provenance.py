"""Who made what is mentioned, and how it spreads from provider to provider: R17 to R19, R22 to R32, R60 to R62."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.keyfigures import key_quantiles
from tidemark.operators.shares import joined, ratio_or_zero
from tidemark.operators.sizes import lookup_join
from tidemark.plans import base
from tidemark.plans.base import LABS, VIEWS
from tidemark.session import written

_LABS = [x.lower() for x in LABS]
POSITIONS = ("unknown_affiliation", "neutral_or_non_frontier", "mixed_own_and_competitor", "own_lab_only", "competitor_lab_only")
GROUPS = ("self_affiliated", "other_frontier", "academia", "independent", "unknown")
#: The lab whose adoption by two others R19 compares.
OWNER, ADOPTERS = "hexamere ai", ("norvane labs", "quillon")
#: Author texts that say nothing.
UNSAID = ("", "unknown", "needs_review", "none")


@base.scoped
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Per catalogue entry: the labs among its authors' affiliations (sorted), whether these are unknown, the labs that the author text
    names, and the author text's parts."""
    c = base.catalogue(spark, d)
    parts = F.filter(F.transform(F.split("frontier_lab_author_affiliations", ";"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    known = F.array(*map(F.lit, _LABS))
    none = F.lower(F.trim("frontier_lab_author_affiliations")) == "none"
    named = [F.when(F.lower("source_author").rlike(rf"(?<![a-z]){x}(?![a-z])"), F.lit(x)) for x in _LABS]
    return c.select(
        "benchmark_id", "benchmark_name", "source_author",
        F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isin(*_LABS)))).alias("labs"),
        (~none & ((F.size(parts) == 0) | (F.size(F.array_except(parts, known)) > 0))).alias("unknown"),
        F.array_compact(F.array(*named)).alias("author_labs"),
        F.filter(F.transform(F.split(F.lower("source_author"), "[,;]"), lambda x: F.trim(x)), lambda x: x != "").alias("authors"),
    )


def _position() -> F.Column:
    own = F.array_contains("labs", F.col("provider"))
    return F.when(F.coalesce("unknown", F.lit(True)), POSITIONS[0]).when(F.size("labs") == 0, POSITIONS[1]).when(own & (F.size("labs") > 1), POSITIONS[2]).when(own, POSITIONS[3]).otherwise(POSITIONS[4])


def _group() -> F.Column:
    own = F.array_contains("labs", F.col("provider")) | F.array_contains("authors", F.col("provider"))
    other = (F.size("labs") > 0) | F.exists("authors", lambda x: x.isin(*_LABS))
    unsaid = F.lower(F.trim("source_author")).isin(*UNSAID) | (F.col("unknown") & (F.size("labs") == 0))
    return F.when(F.col("labs").isNull(), GROUPS[4]).when(own, GROUPS[0]).when(other, GROUPS[1]).when(unsaid, GROUPS[4]).when(F.lower("source_author").startswith("academia"), GROUPS[2]).otherwise(GROUPS[3])


def _period(year: str = "release_year") -> F.Column:
    return F.when(F.col(year) <= 2022, "2021-2022").when(F.col(year) <= 2024, "2023-2024").otherwise("2025-2026")


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with period, author position and source group. Counted per release and benchmark first, which thins out hot ids."""
    m = base.mentions(spark, d).groupBy("model_row_id", "benchmark_id", "provider", "model_name", "release_date", "release_year").agg(F.count("*").alias("n"))
    m = lookup_join(m, provenance(spark, d), "benchmark_id", "left").withColumn("period", _period())
    return m.withColumn("position", _position()).withColumn("source_group", _group())


def _shares(df: DataFrame, keys: list[str], column: str, values: tuple[str, ...]) -> DataFrame:
    out = df.groupBy(*keys).agg(F.sum("n").alias("total_mentions"), *[F.coalesce(F.sum(F.when(F.col(column) == v, F.col("n"))), F.lit(0)).alias(f"{v}_mentions") for v in values])
    return out.select("*", *[ratio_or_zero(F.col(f"{v}_mentions"), F.col("total_mentions")).alias(f"{v}_share") for v in values])


@base.scoped
def author_period_shares(spark: SparkSession, d: str) -> DataFrame:
    """Author positions by provider and period."""
    return _shares(_enriched(spark, d), ["provider", "period"], "position", POSITIONS)


@base.scoped
def author_year_shares(spark: SparkSession, d: str) -> DataFrame:
    """Author positions by provider and year."""
    return _shares(_enriched(spark, d), ["provider", "release_year"], "position", POSITIONS)


@base.scoped
def adoption_comparison(spark: SparkSession, d: str) -> DataFrame:
    """How much two providers, and both together, mention benchmarks of a lab."""
    e = _enriched(spark, d).where(F.col("provider").isin(*ADOPTERS))
    aff, src = F.coalesce(F.array_contains("labs", F.lit(OWNER)), F.lit(False)), F.coalesce(F.array_contains("author_labs", F.lit(OWNER)), F.lit(False))
    e = e.withColumn("aff", aff).withColumn("src", src).withColumn("who", F.explode(F.array("provider", F.lit("+".join(ADOPTERS)))))
    cnt = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = e.groupBy(F.col("who").alias("provider"), "period").agg(F.sum("n").alias("total_mentions"), cnt(F.col("aff")).alias("affiliated_mentions"), cnt(F.col("src")).alias("source_author_mentions"), cnt(F.col("aff") | F.col("src")).alias("either_mentions"), joined(F.when(F.col("aff") | F.col("src"), F.col("benchmark_name"))).alias("benchmarks"))
    return out.withColumn("either_share", ratio_or_zero(F.col("either_mentions"), F.col("total_mentions")))


@base.scoped
def cross_lab_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Mentions and benchmarks by provider, period and lab; a mention counts with each of its labs."""
    target = F.when(F.size("labs") > 0, F.col("labs")).when(F.coalesce("unknown", F.lit(True)), F.array(F.lit("Unknown affiliation"))).otherwise(F.array(F.lit("Neutral/no frontier lab")))
    e = _enriched(spark, d).groupBy("provider", "period", "benchmark_id", target.alias("targets")).agg(F.sum("n").alias("n"))
    return e.select("provider", "period", "benchmark_id", "n", F.explode("targets").alias("target_lab")).groupBy("provider", "period", "target_lab").agg(F.sum("n").alias("mentions"), F.count("*").alias("unique_benchmarks"))


def _firsts(spark: SparkSession, d: str, mentions: DataFrame | None = None) -> DataFrame:
    """The first mention of each benchmark by each provider."""
    return (base.mentions(spark, d) if mentions is None else mentions).groupBy("benchmark_id", "provider").agg(F.min(F.struct("release_date", "model_name", "mention_index", "raw_mention")).alias("f"), F.count("*").alias("n"), F.max("release_date").alias("last")).select("benchmark_id", "provider", "f.release_date", "f.model_name", "f.raw_mention", "n", "last")


@base.scoped
def first_adoption_lags(spark: SparkSession, d: str) -> DataFrame:
    """Days from the first mention by an owning lab to the first by another provider; negative if that came earlier."""
    f = _firsts(spark, d).join(provenance(spark, d).where(F.size("labs") > 0), "benchmark_id")
    providers = base.releases(spark, d).select("provider").distinct().agg(F.collect_set("provider").alias("all"))  # one row, the list of providers
    f = f.crossJoin(providers).withColumn("owners", F.array_intersect("labs", "all")).where(F.size("owners") > 0)
    own = F.array_contains("owners", F.col("provider"))
    least = lambda c: F.min(F.when(c, F.struct("release_date", "provider", "model_name")))
    g = f.groupBy("benchmark_id", "benchmark_name", "owners").agg(least(F.lit(True)).alias("a"), least(own).alias("o"), least(~own).alias("c"))
    lag = F.datediff("c.release_date", "o.release_date").cast("bigint")
    return g.select(
        "benchmark_id", "benchmark_name", F.array_join(F.array_sort("owners"), "; ").alias("owner_providers"), F.col("a.provider").alias("first_any_provider"), F.col("a.release_date").alias("first_any_date"),
        F.col("o.provider").alias("first_owner_provider"), F.col("o.release_date").alias("first_owner_date"), F.col("c.provider").alias("first_competitor_provider"), F.col("c.release_date").alias("first_competitor_date"), lag.alias("lag_days"), (lag < 0).alias("competitor_first"),
    )


@base.scoped
def high_signal(spark: SparkSession, d: str) -> DataFrame:
    """Benchmarks by how much their spread says, with the reason."""
    f = _firsts(spark, d).groupBy("benchmark_id").agg(F.sum("n").alias("mention_count"), F.count("*").alias("provider_count"), joined("provider").alias("providers_mentioning"), F.min(F.struct("release_date", "provider")).alias("a"))
    g = f.join(provenance(spark, d), "benchmark_id", "left")
    cross, lab, labs = F.col("provider_count") >= 2, F.size(F.coalesce("labs", F.array().cast("array<string>"))) > 0, F.array_join("labs", ";")
    reason = (
        F.when(F.coalesce("unknown", F.lit(True)), F.when(cross, "unknown_affiliation_cross_provider").otherwise("unknown_affiliation"))
        .when(cross & lab, F.concat(F.lit("frontier_lab_cross_provider:"), labs)).when(cross & (F.col("mention_count") >= 6), "neutral_cross_provider_anchor")
        .when(lab & (F.col("mention_count") >= 3), F.concat(F.lit("frontier_lab_repeated_within_provider:"), labs)).otherwise("lower_signal")
    )
    return g.select("benchmark_id", "mention_count", "provider_count", "providers_mentioning", F.col("a.provider").alias("first_seen_provider"), F.col("a.release_date").alias("first_seen_date"), reason.alias("high_signal_reason"))


@base.scoped
def cascade_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Reach, path and pace of each benchmark; the second provider is the first that did not tie with the first day."""
    # cleaned once; its readers take the columns that they need
    m = written(base.mentions(spark, d).select("benchmark_id", "provider", "release_date", "model_name", "mention_index", "raw_mention", "model_row_id"), "mentions")
    f = _firsts(spark, d, m)
    start = F.min("release_date").over(Window.partitionBy("benchmark_id"))
    f = f.withColumn("start", start).withColumn("follows", F.col("release_date") > F.col("start"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("release_date", "provider"))), lambda s: F.concat(s["provider"], F.lit(" ("), F.date_format(s["release_date"], "yyyy-MM-dd"), F.lit(")"))), " -> ")
    g = f.groupBy("benchmark_id").agg(
        F.min("release_date").alias("first_date"), F.max("last").alias("last_date"), joined(F.when(~F.col("follows"), F.col("provider"))).alias("first_providers"), F.count_if(~F.col("follows")).alias("first_provider_count"),
        F.count("*").alias("provider_count"), F.sum("n").alias("total_mentions"), path.alias("provider_adoption_path"), F.min(F.when(F.col("follows"), F.struct("release_date", "provider"))).alias("s"),
    )
    raw = m.select("benchmark_id", "raw_mention").distinct().groupBy("benchmark_id").agg(F.count("*").alias("raw_variant_count"))
    rel = m.select("benchmark_id", "model_row_id").distinct().groupBy("benchmark_id").agg(F.count("*").alias("release_count"))
    half = key_quantiles(m, "benchmark_id", "release_date", (0.5,)).select(F.col("key").alias("benchmark_id"), F.col("value").alias("half"))
    ends = base.releases(spark, d).groupBy("provider").agg(F.max("release_date").alias("e")).agg(F.collect_list("e").alias("ends"), F.max("e").alias("as_of"))  # one row, a date per provider
    out = g.join(raw, "benchmark_id").join(rel, "benchmark_id").join(half, "benchmark_id").crossJoin(ends)
    eligible = F.size(F.filter("ends", lambda x: x >= F.col("first_date"))).cast("bigint")
    days = lambda a, b: F.datediff(a, b).cast("bigint")
    return out.select(
        "benchmark_id", "first_date", "last_date", "first_providers", "first_provider_count", "provider_count", eligible.alias("eligible_provider_count"), ratio_or_zero(F.col("provider_count"), eligible).alias("provider_reach_share"),
        "total_mentions", "release_count", "raw_variant_count", "provider_adoption_path", F.col("s.provider").alias("second_provider"), F.col("s.release_date").alias("second_provider_date"), days("s.release_date", "first_date").alias("days_to_second_provider"),
        days("last_date", "first_date").alias("active_span_days"), days("half", "first_date").alias("time_to_50pct_mentions_days"), days("as_of", "first_date").alias("observed_days_since_first"), (F.col("provider_count") > F.col("first_provider_count")).alias("cross_provider_cascade"),
    )


@base.scoped
def fastest_cascades(spark: SparkSession, d: str) -> DataFrame:
    """The ten benchmarks that reached a second provider fastest."""
    c = cascade_metrics(spark, d).where("days_to_second_provider is not null")
    return c.select("benchmark_id", "first_date", "second_provider", "days_to_second_provider", "provider_count").orderBy("days_to_second_provider", F.desc("provider_count"), "benchmark_id").limit(10)


@base.scoped
def adoption_events(spark: SparkSession, d: str) -> DataFrame:
    """The first mention of each benchmark by each provider, in order of adoption."""
    f = _firsts(spark, d)
    w = Window.partitionBy("benchmark_id")
    f = f.withColumn("start", F.min("release_date").over(w)).withColumn("adoption_order", F.dense_rank().over(w.orderBy("release_date")).cast("bigint"))
    return f.select("benchmark_id", "provider", F.col("release_date").alias("provider_first_date"), F.col("model_name").alias("provider_first_model"), "adoption_order", F.datediff("release_date", "start").cast("bigint").alias("lag_days_since_benchmark_first"), (F.col("release_date") == F.col("start")).alias("is_first_provider"))


@base.scoped
def diffusion_roles(spark: SparkSession, d: str) -> DataFrame:
    """What each provider mentions first, passes on and takes over."""
    e = adoption_events(spark, d)
    w = Window.partitionBy("benchmark_id")
    e = e.withColumn("followers", F.count_if(~F.col("is_first_provider")).over(w))
    first, late = F.col("is_first_provider"), ~F.col("is_first_provider")
    g = e.groupBy("provider").agg(
        F.count("*").alias("unique_benchmarks_mentioned"), F.count_if(first).alias("first_mover_benchmarks"), F.count_if(first & (F.col("followers") > 0)).alias("exported_benchmarks_later_adopted"),
        F.coalesce(F.sum(F.when(first, F.col("followers"))), F.lit(0)).alias("follower_adoptions_created"), F.count_if(late).alias("imported_benchmarks"),
        F.round(F.avg(F.when(late, F.col("lag_days_since_benchmark_first"))), 6).alias("avg_import_lag_days"), F.median(F.when(late, F.col("lag_days_since_benchmark_first"))).alias("median_import_lag_days"),
    )
    return g.withColumn("net_export_balance", F.col("exported_benchmarks_later_adopted") - F.col("imported_benchmarks")).withColumn("first_mover_share_of_portfolio", ratio_or_zero(F.col("first_mover_benchmarks"), F.col("unique_benchmarks_mentioned")))


@base.scoped
def release_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Of each release's benchmarks, how many are new, repeated, or used before by others. First dates replace any look into the past."""
    m = written(base.mentions(spark, d).select("benchmark_id", "provider", "release_date", "model_name", "mention_index", "raw_mention", "model_row_id"), "mentions")
    f = _firsts(spark, d, m).select("benchmark_id", "provider", F.col("release_date").alias("p"))
    two = f.groupBy("benchmark_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("p", "provider"))), 1, 2).alias("two"))
    ids = m.select("model_row_id", "provider", "release_date", "benchmark_id").distinct()
    x = lookup_join(ids, two, "benchmark_id").withColumn("g", F.col("two")[0]["p"])
    x = x.withColumn("others", F.when(F.col("two")[0]["provider"] != F.col("provider"), F.col("two")[0]["p"]).otherwise(F.try_element_at("two", F.lit(2))["p"]))
    both = F.concat_ws("\u0001", "benchmark_id", "provider")
    x = lookup_join(x.withColumn("k", both), f.select(both.alias("k"), "p"), "k")
    day = F.col("release_date")
    g = x.groupBy("model_row_id").agg(F.count("*").alias("t"), F.count_if(F.col("g") == day).alias("new_global"), F.count_if(F.col("p") == day).alias("new_to_provider"), F.count_if(F.col("p") < day).alias("self_repeat"), F.count_if(F.col("others") < day).alias("used_by_others"))
    out = base.releases(spark, d).select("model_row_id", "provider", "release_date").join(g, "model_row_id", "left").na.fill(0)
    names = ("new_global", "new_to_provider", "self_repeat", "used_by_others")
    return out.select("model_row_id", "provider", "release_date", F.col("t").alias("total_unique_benchmarks"), *[F.col(c).alias(f"{c}_benchmarks") for c in names], *[ratio_or_zero(F.col(c), F.col("t")).alias(f"{c}_share") for c in names])


@base.scoped
def similarity_timeseries(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of all providers' portfolios so far, at each release date. First dates turn into running counts; nothing is compared set by set."""
    f = _firsts(spark, d).select("benchmark_id", "provider", F.col("release_date").alias("day"))
    rel = base.releases(spark, d)
    days = rel.select(F.col("release_date").alias("day")).distinct()
    provs = rel.select("provider").distinct()
    w = lambda *k: Window.partitionBy(*k).orderBy("day")
    size = f.groupBy("provider", "day").agg(F.count("*").alias("n"))
    size = provs.crossJoin(days).join(size, ["provider", "day"], "left").select("provider", "day", F.coalesce(F.sum("n").over(w("provider")), F.lit(0)).alias("size"))  # providers x days
    a, b = f.select("benchmark_id", F.col("provider").alias("left_provider"), F.col("day").alias("x")), f.select("benchmark_id", F.col("provider").alias("right_provider"), F.col("day").alias("y"))
    both = a.join(b, "benchmark_id").where("left_provider < right_provider").groupBy("left_provider", "right_provider", F.greatest("x", "y").alias("day")).agg(F.count("*").alias("n"))
    left, right = size.select(F.col("provider").alias("left_provider"), "day", F.col("size").alias("left_portfolio_size")), size.select(F.col("provider").alias("right_provider"), "day", F.col("size").alias("right_portfolio_size"))
    spine = left.join(right, "day").where("left_provider < right_provider")
    out = spine.join(both, ["left_provider", "right_provider", "day"], "left").withColumn("intersection_size", F.coalesce(F.sum("n").over(w("left_provider", "right_provider")), F.lit(0)))
    out = out.withColumn("union_size", F.col("left_portfolio_size") + F.col("right_portfolio_size") - F.col("intersection_size"))
    return out.select(F.col("day").alias("snapshot_date"), "left_provider", "right_provider", "left_portfolio_size", "right_portfolio_size", "intersection_size", "union_size", ratio_or_zero(F.col("intersection_size"), F.col("union_size")).alias("jaccard_similarity"))


@base.scoped
def similarity_latest(spark: SparkSession, d: str) -> DataFrame:
    """The similarities at the last release date."""
    t = similarity_timeseries(spark, d)
    last = base.releases(spark, d).agg(F.max("release_date").alias("snapshot_date"))
    return t.join(F.broadcast(last), "snapshot_date")  # one row


@base.scoped
def source_author_dependency(spark: SparkSession, d: str) -> DataFrame:
    """Whose benchmarks each provider mentions."""
    return _shares(_enriched(spark, d), ["provider"], "source_group", GROUPS)


@base.scoped
def release_source_mix(spark: SparkSession, d: str) -> DataFrame:
    """Whose benchmarks each release mentions; releases without mentions have zeros."""
    mix = _shares(_enriched(spark, d), ["model_row_id"], "source_group", GROUPS)
    return base.releases(spark, d).select("model_row_id", "provider", "release_date").join(mix, "model_row_id", "left").na.fill(0)


@base.scoped
def borrowed_authority(spark: SparkSession, d: str) -> DataFrame:
    """Share of mentions, raw and with equal weight per release, whose benchmark has another lab's authors and none of the provider's own."""
    e = _enriched(spark, d).withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("model_row_id")))
    b = F.col("position") == POSITIONS[4]
    g = e.groupBy("provider", "period").agg(F.sum("n").alias("raw_mentions"), F.coalesce(F.sum(F.when(b, F.col("n"))), F.lit(0)).alias("borrowed_mentions"), F.sum("w").alias("w"), F.sum(F.when(b, F.col("w")).otherwise(0.0)).alias("bw"))
    return g.select("provider", "period", "raw_mentions", "borrowed_mentions", ratio_or_zero(F.col("borrowed_mentions"), F.col("raw_mentions")).alias("raw_share"), ratio_or_zero(F.col("bw"), F.col("w")).alias("release_weighted_share"))


QUERIES = {f.__name__: f for f in (
    author_period_shares, author_year_shares, adoption_comparison, cross_lab_matrix, first_adoption_lags, high_signal, cascade_metrics, fastest_cascades, adoption_events, diffusion_roles,
    release_strategy, similarity_timeseries, similarity_latest, source_author_dependency, release_source_mix, borrowed_authority,
)}

_IN = ", ".join(f"'{x}'" for x in _LABS)
_PER = "case when release_year <= 2022 then '2021-2022' when release_year <= 2024 then '2023-2024' else '2025-2026' end"
_AUTHOR_LABS = ", ".join(f"case when regexp_matches(lower(source_author), '(^|[^a-z]){x}($|[^a-z])') then '{x}' end" for x in _LABS)
ENRICHED = VIEWS + f""", dim as (select *, lower(trim(frontier_lab_author_affiliations)) <> 'none' and (len(parts) = 0 or len([x for x in parts if x not in ({_IN})]) > 0) unknown, list_sort(list_distinct([x for x in parts if x in ({_IN})])) labs from
  (select benchmark_id, benchmark_name, source_author, frontier_lab_author_affiliations, [lower(trim(x)) for x in string_split(frontier_lab_author_affiliations, ';') if trim(x) <> ''] parts, [x for x in [{_AUTHOR_LABS}] if x is not null] author_labs,
   [lower(trim(x)) for x in string_split(replace(source_author, ',', ';'), ';') if trim(x) <> ''] authors from cat)),
en as (select men.*, dim.benchmark_name, labs, unknown, author_labs, {_PER} period,
  case when coalesce(unknown, true) then 'unknown_affiliation' when len(labs) = 0 then 'neutral_or_non_frontier' when list_contains(labs, provider) and len(labs) > 1 then 'mixed_own_and_competitor' when list_contains(labs, provider) then 'own_lab_only' else 'competitor_lab_only' end "position",
  case when labs is null then 'unknown' when list_contains(labs, provider) or list_contains(authors, provider) then 'self_affiliated' when len(labs) > 0 or len([x for x in authors if x in ({_IN})]) > 0 then 'other_frontier'
    when lower(trim(source_author)) in ('', 'unknown', 'needs_review', 'none') or unknown then 'unknown' when lower(source_author) like 'academia%' then 'academia' else 'independent' end source_group
  from men left join dim using (benchmark_id)),
fi as (select benchmark_id, provider, min(release_date) dy, count(*) n, max(release_date) l from men group by 1, 2)
"""


def _share_sql(keys: str, column: str, values: tuple[str, ...], source: str = "en") -> str:
    cols = ", ".join(f'count_if("{column}" = \'{v}\') {v}_mentions, round(count_if("{column}" = \'{v}\')::double / count(*), 6) {v}_share' for v in values)
    return f"select {keys}, count(*) total_mentions, {cols} from {source} group by {keys}"


_MIX = ", ".join(f"coalesce({v}_mentions, 0) {v}_mentions, coalesce({v}_share, 0) {v}_share" for v in GROUPS)
_SIM = """, days as (select distinct release_date d from rel), pr as (select distinct provider p from rel),
sz as (select p, d, (select count(*) from fi where fi.provider = p and dy <= d) s from pr cross join days),
ii as (select a.provider l, b.provider r, greatest(a.dy, b.dy) x, count(*) n from fi a join fi b on a.benchmark_id = b.benchmark_id and a.provider < b.provider group by all),
sim as (select a.d snapshot_date, a.p left_provider, b.p right_provider, a.s left_portfolio_size, b.s right_portfolio_size, coalesce((select sum(n) from ii where l = a.p and r = b.p and x <= a.d), 0)::bigint intersection_size from sz a join sz b on a.d = b.d and a.p < b.p),
st as (select *, left_portfolio_size + right_portfolio_size - intersection_size union_size, coalesce(round(intersection_size::double / nullif(left_portfolio_size + right_portfolio_size - intersection_size, 0), 6), 0) jaccard_similarity from sim)
"""
_CASCADE = ENRICHED + """, s as (select *, min(dy) over (partition by benchmark_id) d0 from fi),
casc as (select g.benchmark_id, first_date, last_date, first_providers, first_provider_count, provider_count, el eligible_provider_count, coalesce(round(provider_count::double / nullif(el, 0), 6), 0) provider_reach_share, total_mentions, release_count, raw_variant_count, provider_adoption_path, s2.provider second_provider, s2.dy second_provider_date,
  datediff('day', first_date, s2.dy) days_to_second_provider, datediff('day', first_date, last_date) active_span_days, datediff('day', first_date, h.h) time_to_50pct_mentions_days, datediff('day', first_date, (select max(release_date) from rel)) observed_days_since_first, provider_count > first_provider_count cross_provider_cascade
  from (select benchmark_id, min(dy) first_date, max(l) last_date, string_agg(provider, '; ' order by provider) filter (dy = d0) first_providers, count_if(dy = d0) first_provider_count, count(*) provider_count, sum(n)::bigint total_mentions, string_agg(provider || ' (' || strftime(dy, '%Y-%m-%d') || ')', ' -> ' order by dy, provider) provider_adoption_path,
    (select count(*) from (select max(release_date) e from rel group by provider) where e >= min(s.dy)) el from s group by 1) g
  left join (select benchmark_id, dy, provider, row_number() over (partition by benchmark_id order by dy, provider) k from s where dy > d0) s2 on s2.benchmark_id = g.benchmark_id and k = 1
  join (select benchmark_id, count(distinct model_row_id) release_count, count(distinct raw_mention) raw_variant_count, quantile_disc(release_date, 0.5) h from men group by 1) h on h.benchmark_id = g.benchmark_id)
"""
_EVENTS = """, ae as (select benchmark_id, provider, dy provider_first_date, model provider_first_model, dense_rank() over (partition by benchmark_id order by dy) adoption_order, datediff('day', min(dy) over (partition by benchmark_id), dy) lag_days_since_benchmark_first, dy = min(dy) over (partition by benchmark_id) is_first_provider
  from (select fi.benchmark_id, fi.provider, dy, (select m.model_name from men m where m.benchmark_id = fi.benchmark_id and m.provider = fi.provider and m.release_date = fi.dy order by m.model_name limit 1) model from fi))
"""

SQL = {
    "author_period_shares": ENRICHED + _share_sql("provider, period", "position", POSITIONS),
    "author_year_shares": ENRICHED + _share_sql("provider, release_year", "position", POSITIONS),
    "adoption_comparison": ENRICHED + f""", x as (select *, coalesce(list_contains(labs, '{OWNER}'), false) aff, coalesce(list_contains(author_labs, '{OWNER}'), false) src from en where provider in {ADOPTERS}), y as (select * from x union all select * replace ('{"+".join(ADOPTERS)}' as provider) from x)
select provider, period, count(*) total_mentions, count_if(aff) affiliated_mentions, count_if(src) source_author_mentions, count_if(aff or src) either_mentions, coalesce(string_agg(distinct benchmark_name, '; ' order by benchmark_name) filter (aff or src), '') benchmarks, round(count_if(aff or src)::double / count(*), 6) either_share from y group by 1, 2""",
    "cross_lab_matrix": ENRICHED + "select provider, period, t target_lab, count(*) mentions, count(distinct benchmark_id) unique_benchmarks from (select provider, period, benchmark_id, unnest(case when len(labs) > 0 then labs when coalesce(unknown, true) then ['Unknown affiliation'] else ['Neutral/no frontier lab'] end) t from en) group by 1, 2, 3",
    "first_adoption_lags": ENRICHED + """, o as (select fi.*, benchmark_name, [x for x in labs if list_contains(ps, x)] owners from fi join dim using (benchmark_id) cross join (select list(distinct provider) ps from rel)), k as (select *, list_contains(owners, provider) own from o where len(owners) > 0),
r as (select benchmark_id, own, dy, provider, row_number() over (partition by benchmark_id, own order by dy, provider) k, row_number() over (partition by benchmark_id order by dy, provider) ka from k)
select b.benchmark_id, benchmark_name, array_to_string(list_sort(owners), '; ') owner_providers, a.provider first_any_provider, a.dy first_any_date, w.provider first_owner_provider, w.dy first_owner_date, c.provider first_competitor_provider, c.dy first_competitor_date, datediff('day', w.dy, c.dy) lag_days, datediff('day', w.dy, c.dy) < 0 competitor_first
from (select distinct benchmark_id, benchmark_name, owners from k) b join r a on a.benchmark_id = b.benchmark_id and a.ka = 1 left join r w on w.benchmark_id = b.benchmark_id and w.own and w.k = 1 left join r c on c.benchmark_id = b.benchmark_id and not c.own and c.k = 1""",
    "high_signal": ENRICHED + """, g as (select benchmark_id, sum(n)::bigint mention_count, count(*) provider_count, string_agg(provider, '; ' order by provider) providers_mentioning, min(dy) first_seen_date from fi group by 1)
select g.*, (select provider from fi where fi.benchmark_id = g.benchmark_id order by dy, provider limit 1) first_seen_provider, case when coalesce(unknown, true) then case when provider_count >= 2 then 'unknown_affiliation_cross_provider' else 'unknown_affiliation' end when provider_count >= 2 and len(labs) > 0 then 'frontier_lab_cross_provider:' || array_to_string(labs, ';')
  when provider_count >= 2 and mention_count >= 6 then 'neutral_cross_provider_anchor' when len(labs) > 0 and mention_count >= 3 then 'frontier_lab_repeated_within_provider:' || array_to_string(labs, ';') else 'lower_signal' end high_signal_reason from g left join dim using (benchmark_id)""",
    "cascade_metrics": _CASCADE + "select * from casc",
    "fastest_cascades": _CASCADE + "select benchmark_id, first_date, second_provider, days_to_second_provider, provider_count from casc where days_to_second_provider is not null order by days_to_second_provider, provider_count desc, benchmark_id limit 10",
    "adoption_events": ENRICHED + _EVENTS + "select * from ae",
    "diffusion_roles": ENRICHED + _EVENTS + ", e as (select *, count_if(not is_first_provider) over (partition by benchmark_id) f from ae) select provider, count(*) unique_benchmarks_mentioned, count_if(is_first_provider) first_mover_benchmarks, count_if(is_first_provider and f > 0) exported_benchmarks_later_adopted, coalesce(sum(f) filter (is_first_provider), 0)::bigint follower_adoptions_created, count_if(not is_first_provider) imported_benchmarks, round(avg(lag_days_since_benchmark_first) filter (not is_first_provider), 6) avg_import_lag_days, median(lag_days_since_benchmark_first) filter (not is_first_provider) median_import_lag_days, count_if(is_first_provider and f > 0) - count_if(not is_first_provider) net_export_balance, round(count_if(is_first_provider)::double / count(*), 6) first_mover_share_of_portfolio from e group by 1",
    "release_strategy": ENRICHED + """, g as (select benchmark_id, min(dy) g from fi group by 1), x as (select distinct model_row_id, benchmark_id, provider, release_date from men),
y as (select x.model_row_id, x.release_date d, g.g, p.dy p, (select min(dy) from fi q where q.benchmark_id = x.benchmark_id and q.provider <> x.provider) o from x join g using (benchmark_id) join fi p on p.benchmark_id = x.benchmark_id and p.provider = x.provider),
z as (select model_row_id, count(*) t, count_if(g = d) a, count_if(p = d) b, count_if(p < d) c, count_if(o < d) e from y group by 1)
select model_row_id, provider, release_date, coalesce(t, 0) total_unique_benchmarks, coalesce(a, 0) new_global_benchmarks, coalesce(b, 0) new_to_provider_benchmarks, coalesce(c, 0) self_repeat_benchmarks, coalesce(e, 0) used_by_others_benchmarks, coalesce(round(a::double / t, 6), 0) new_global_share, coalesce(round(b::double / t, 6), 0) new_to_provider_share, coalesce(round(c::double / t, 6), 0) self_repeat_share, coalesce(round(e::double / t, 6), 0) used_by_others_share from rel left join z using (model_row_id)""",
    "similarity_timeseries": ENRICHED + _SIM + "select * from st",
    "similarity_latest": ENRICHED + _SIM + "select * from st where snapshot_date = (select max(release_date) from rel)",
    "source_author_dependency": ENRICHED + _share_sql("provider", "source_group", GROUPS),
    "release_source_mix": ENRICHED + ", mix as (" + _share_sql("model_row_id", "source_group", GROUPS) + f") select model_row_id, provider, release_date, coalesce(total_mentions, 0) total_mentions, {_MIX} from rel left join mix using (model_row_id)",
    "borrowed_authority": ENRICHED + ", x as (select *, 1.0::double / count(*) over (partition by model_row_id) w from en) select provider, period, count(*) raw_mentions, count_if(\"position\" = 'competitor_lab_only') borrowed_mentions, round(count_if(\"position\" = 'competitor_lab_only')::double / count(*), 6) raw_share, round(coalesce(sum(w) filter (\"position\" = 'competitor_lab_only'), 0) / sum(w), 6) release_weighted_share from x group by 1, 2",
}
