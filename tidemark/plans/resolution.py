"""Resolution, keys, page scans and data quality: D1 to D14, B1 to B12, G12, V2 to V14, V16."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import benchmark_id, edit_name, exact_key, identity_key, name_tokens, stable_id
from tidemark.functions.text import norm_id
from tidemark.functions.url import normalize_url
from tidemark.functions.vocab import HEADLINE_AXIS
from tidemark.operators.facets import headline_projection
from tidemark.operators.nearnames import near_duplicates as near
from tidemark.operators.pages import accuracy, scan_aliases
from tidemark.operators.resolve import build_resolved_mentions, exploded
from tidemark.plans import base
from tidemark.plans.base import LABS, LAUNCHES, VIEWS
from tidemark.plans.composition import AXES
from tidemark.plans.composition import SQL as COMPOSITION
from tidemark.sources.tables import load

STATUSES = ("accepted", "deprecated", "disputed", "legacy_seed", "needs_review")
MATCH_TYPES = ("case_variant", "exact", "legacy_name", "provider_abbreviation", "version_alias")
#: The closed vocabularies of the catalogue and of the facet labels; the blank task mode and domain are allowed.
TASK_MODES = ("agent", "static", "tool")
TASK_DOMAINS = ("code", "general", "law", "science")
FACET_LABELS = {
    "context_pressure": ("long", "medium", "short", "unknown", "very_long"),
    "domain": ("chemistry", "finance", "general", "law", "software"),
    "interaction_pattern": ("dialogue", "environment", "single_turn", "survey", "tool_use"),
    "metric": ("accuracy", "cost", "pass_rate", "rubric", "win_rate"),
    "modality": ("audio", "code", "image", "table", "text"),
    HEADLINE_AXIS: TASK_MODES,
}


@base.scoped
def names_and_aliases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(name_key, benchmark_id) of both catalogues and (alias_key, target, match_type), one row per key."""
    both = load(spark, d, "benchmarks").select(norm_id("benchmark_id").alias("benchmark_id"), "benchmark_name").unionByName(load(spark, d, "community_benchmarks").select(norm_id("benchmark_id").alias("benchmark_id"), "benchmark_name"))
    names = both.where("benchmark_id is not null and trim(benchmark_name) <> ''").groupBy(exact_key("benchmark_name").alias("name_key")).agg(F.min("benchmark_id").alias("benchmark_id"))
    al = load(spark, d, "benchmark_aliases").where("trim(alias) <> '' and benchmark_id is not null").groupBy(exact_key("alias").alias("alias_key")).agg(F.min(F.struct(norm_id("benchmark_id").alias("target"), "match_type")).alias("m"))
    return names, al.select("alias_key", "m.target", "m.match_type")


def _rounded(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("release_weight", F.round("release_weight", 6)).withColumn("raw_weight", F.round("raw_weight", 6))


@base.scoped
def resolved_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every element of the comma lists that resolves, with weights; unresolved ones are collected apart."""
    return _rounded(build_resolved_mentions(base.releases(spark, d), *names_and_aliases(spark, d), policy="collect")[0])


@base.scoped
def unresolved_mentions(spark: SparkSession, d: str) -> DataFrame:
    """K7: the elements that do not resolve."""
    return build_resolved_mentions(base.releases(spark, d), *names_and_aliases(spark, d), policy="collect")[1]


@base.scoped
def resolved_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row per release and benchmark."""
    return _rounded(build_resolved_mentions(base.releases(spark, d), *names_and_aliases(spark, d), deduplicate=True, policy="collect")[0])


@base.scoped
def resolved_drop_release(spark: SparkSession, d: str) -> DataFrame:
    """Only releases of which every element resolves."""
    return _rounded(build_resolved_mentions(base.releases(spark, d), *names_and_aliases(spark, d), policy="drop_release")[0])


@base.scoped
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of every catalogue name."""
    c = base.catalogue(spark, d)
    n = F.col("benchmark_name")
    return c.select("benchmark_id", exact_key("benchmark_name").alias("exact_key"), identity_key("benchmark_name").alias("identity_key"), benchmark_id(n).alias("made_id"), edit_name(n).alias("edit_name"), F.array_join(name_tokens(n), " ").alias("tokens"), stable_id("facet", n, F.col("review_status")).alias("stable_id"))


@base.scoped
def source_urls(spark: SparkSession, d: str) -> DataFrame:
    """Every release's address as a key."""
    return base.releases(spark, d).select("model_row_id", "link", normalize_url("link").alias("source_url"))


@base.scoped
def near_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """V8: catalogue names that look like one entity."""
    return near(base.catalogue(spark, d).select(F.col("benchmark_id").alias("id"), F.col("benchmark_name").alias("name")))


@base.scoped
def page_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The benchmarks named in every document, by name or alias, with the place of the best hit."""
    names = base.catalogue(spark, d).select(F.col("benchmark_name").alias("alias"), "benchmark_id")
    al = load(spark, d, "benchmark_aliases").select("alias", norm_id("benchmark_id").alias("benchmark_id")).join(names.select("benchmark_id").distinct(), "benchmark_id", "left_semi")
    return scan_aliases(load(spark, d, "documents"), "doc_id", "source_kind", "text", names.unionByName(al.select("alias", "benchmark_id")))


@base.scoped
def resolution_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Per release, how the exact resolution of its list compares with the mentions on record."""
    gold, found = base.mentions(spark, d), resolved_mentions(spark, d)
    return accuracy(gold, found, "model_row_id", "benchmark_id").withColumnRenamed("page", "model_row_id")


@base.scoped
def resolution_accuracy_micro(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision summed over all releases."""
    s = resolution_accuracy(spark, d).agg(F.sum("gold").alias("gold"), F.sum("predicted").alias("predicted"), F.sum("true_positive").alias("true_positive"))
    return s.select("*", F.coalesce(F.round(F.try_divide("true_positive", "gold"), 6), F.lit(1.0)).alias("recall"), F.coalesce(F.round(F.try_divide("true_positive", "predicted"), 6), F.lit(0.0)).alias("precision"))


@base.scoped
def violations(spark: SparkSession, d: str) -> DataFrame:
    """V3, V4, V6, V9, V10, V12, V14 and parts of V5, V7, V11: (rule, severity, key) of what breaks these rules, as one table; a key that breaks a rule
    several times stands once. all_violations has the other rules too."""
    bm = load(spark, d, "benchmarks").select(norm_id("benchmark_id").alias("id"), F.trim("benchmark_name").alias("name"), "review_status", F.coalesce("frontier_lab_author_affiliations", F.lit("")).alias("aff")).distinct()
    al = load(spark, d, "benchmark_aliases").select(F.col("alias_id").cast("string").alias("k"), F.trim("alias").alias("alias"), norm_id("benchmark_id").alias("target"), "match_type").distinct()
    fa = base.facets(spark, d, active=False)
    raw = load(spark, d, "benchmark_facets").select("facet_row_id", norm_id("benchmark_id").alias("id"), "facet_axis", "facet_label").distinct()
    ids = bm.select("id").distinct()
    k = lambda c: F.col(c).cast("string").alias("key")
    parts = F.transform(F.split("aff", ";"), lambda x: F.trim(x))
    checks: list[tuple[str, str, DataFrame]] = [
        ("duplicate_benchmark_id", "error", bm.groupBy("id").agg(F.count_distinct("name").alias("n")).where("n > 1").select(k("id"))),
        ("duplicate_benchmark_name", "error", bm.where("name <> ''").groupBy(F.lower("name").alias("name")).agg(F.count_distinct("id").alias("n")).where("n > 1").select(k("name"))),
        ("id_not_from_name", "error", bm.where("name <> ''").where(F.col("id") != benchmark_id(F.col("name"))).select(k("id"))),
        ("invalid_review_status", "error", bm.where(~F.coalesce("review_status", F.lit("")).isin(*STATUSES)).select(k("id"))),
        ("affiliation_list", "error", bm.where((F.lower("aff") != "none") & (F.exists(parts, lambda x: (x == "") | ~x.isin(*LABS)) | (F.size(parts) != F.size(F.array_distinct(parts))))).select(k("id"))),
        ("alias_blank", "error", al.where("coalesce(alias, '') = '' or target is null").select(k("k"))),
        ("alias_duplicate", "error", al.groupBy("alias").agg(F.count_distinct("target").alias("n")).where("n > 1").select(k("alias"))),
        ("alias_target_missing", "error", al.join(ids, al.target == ids.id, "left_anti").where("target is not null").select(k("k"))),
        ("alias_shadows_name", "error", al.join(bm, (F.col("alias") == F.col("name")) & (F.col("target") != F.col("id"))).select(k("k"))),
        ("alias_match_type", "error", al.where(~F.coalesce("match_type", F.lit("")).isin(*MATCH_TYPES)).select(k("k"))),
        ("unresolved_mention", "error", unresolved_mentions(spark, d).select(k("raw_mention"))),
        ("unused_benchmark", "warning", ids.join(base.mentions(spark, d).select(F.col("benchmark_id").alias("id")).distinct(), "id", "left_anti").select(k("id"))),
        ("facet_blank", "error", raw.where("id is null or coalesce(trim(facet_axis), '') = '' or coalesce(trim(facet_label), '') = ''").select(k("facet_row_id"))),
        ("facet_confidence_range", "error", fa.where("confidence < 0 or confidence > 1").select(k("facet_row_id"))),
        ("facet_confidence_status", "error", fa.where("confidence < 0.7 and review_status not in ('needs_review', 'disputed', 'deprecated')").select(k("facet_row_id"))),
        ("facet_axis_unknown", "error", fa.where(~F.col("facet_axis").isin(*AXES)).select(k("facet_row_id"))),
        ("facet_owner_unknown", "error", fa.join(ids, fa.benchmark_id == ids.id, "left_anti").select(k("facet_row_id"))),
        ("facet_duplicate", "error", fa.where("review_status <> 'deprecated'").groupBy("benchmark_id", "facet_axis", "facet_label").agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("|", "benchmark_id", "facet_axis", "facet_label").alias("key"))),
        ("facet_axis_missing", "error", ids.select("id", F.explode(F.array(*map(F.lit, AXES))).alias("axis")).join(fa.where("review_status <> 'deprecated'").select(F.col("benchmark_id").alias("id"), F.col("facet_axis").alias("axis")), ["id", "axis"], "left_anti").select(F.concat_ws("|", "id", "axis").alias("key"))),
    ]
    out = None
    for rule, severity, rows in checks:
        part = rows.distinct().select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "key")
        out = part if out is None else out.unionByName(part)
    return out


@base.scoped
def further_violations(spark: SparkSession, d: str) -> DataFrame:
    """What violations leaves out: closed vocabularies, unused aliases and names, several or underivable headlines, release dates, missing
    confidences and names equal but for case and form. Rules of one table are tested in one read of it."""
    bm = load(spark, d, "benchmarks").select(norm_id("benchmark_id").alias("id"), "benchmark_name", F.trim("legacy_task_mode").alias("mode"), F.trim("legacy_task_domain").alias("domain")).distinct()
    al = load(spark, d, "benchmark_aliases").select(F.col("alias_id").cast("string").alias("k"), "alias").distinct()
    confidence = F.max(F.when(~F.isnan("classification_confidence"), F.col("classification_confidence")))
    raw = load(spark, d, "benchmark_facets").groupBy("facet_row_id").agg(F.min(F.trim("facet_axis")).alias("axis"), F.min(F.trim("facet_label")).alias("label"), F.min(F.trim("review_status")).alias("status"), confidence.alias("confidence"))
    fa = base.facets(spark, d)
    used = exploded(base.releases(spark, d), ["model_row_id"]).select(F.col("raw_mention").alias("used")).distinct()
    names = bm.select(F.trim("benchmark_name").alias("name"), exact_key("benchmark_name").alias("used"))
    headed = fa.where(F.col("facet_axis") == HEADLINE_AXIS).groupBy("benchmark_id").agg(F.count("*").alias("n"))
    full = fa.where(F.col("facet_axis").isin(*AXES)).groupBy("benchmark_id").agg(F.count_distinct("facet_axis").alias("n")).where(F.col("n") == len(AXES))
    k = lambda c: F.col(c).cast("string").alias("key")

    def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
        """(rule, severity, key) of the rows, read once, that meet the conditions of errors."""
        return rows.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in rules.items()]))).alias("rule"), F.lit("error").alias("severity"), k(key))

    odd = F.lit(False)
    for axis, labels in FACET_LABELS.items():
        odd = odd | ((F.col("axis") == axis) & (F.col("label") != "") & ~F.col("label").isin(*labels))
    out = broken(bm, "id", {
        "invalid_task_mode": (F.col("mode") != "") & ~F.col("mode").isin(*TASK_MODES), "invalid_task_domain": (F.col("domain") != "") & ~F.col("domain").isin(*TASK_DOMAINS),
    }).unionByName(broken(raw, "facet_row_id", {
        "facet_status_blank": F.coalesce("status", F.lit("")) == "", "facet_status_invalid": (F.col("status") != "") & ~F.col("status").isin(*STATUSES), "facet_confidence_missing": F.col("confidence").isNull(), "facet_label_invalid": odd,
    }))
    checks: list[tuple[str, str, DataFrame]] = [
        ("invalid_release_date", "error", load(spark, d, "models").where("release_date is null").select(k("model_row_id"))),
        ("duplicate_name_identity", "error", bm.where("trim(benchmark_name) <> ''").select("id", identity_key("benchmark_name").alias("i")).groupBy("i").agg(F.count_distinct("id").alias("n")).where("n > 1").select(k("i"))),
        ("duplicate_alias_identity", "error", al.where("trim(alias) <> ''").select("k", identity_key("alias").alias("i")).groupBy("i").agg(F.count_distinct("k").alias("n")).where("n > 1").select(k("i"))),
        ("unused_alias", "warning", al.select("k", exact_key("alias").alias("used")).join(used, "used", "left_anti").select(k("k"))),
        ("unused_name", "warning", names.join(used, "used", "left_anti").select(F.coalesce("name", F.lit("")).alias("key"))),
        ("headline_repeated", "error", headed.where("n > 1").select(k("benchmark_id"))),
        ("headline_not_derivable", "error", full.join(headline_projection(fa), "benchmark_id", "left_anti").select(k("benchmark_id"))),
    ]
    for rule, severity, rows in checks:
        out = out.unionByName(rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "key"))
    return out.distinct()


@base.scoped
def all_violations(spark: SparkSession, d: str, reviewed: DataFrame | None = None) -> DataFrame:
    """Violations, further_violations and near duplicates (V8).

    reviewed: (benchmark_id_a, benchmark_id_b, note), near duplicates that were found to be two entries; such pairs are no violation, and the
    list itself is checked. V1 and V15 are checked where files are read (read_csv, merge_reviewed), which raise.
    """
    pairs = near_duplicate_names(spark, d).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    pair = F.concat_ws("|", "a", "b").alias("key")
    checks: list[tuple[str, str, DataFrame]] = []
    if reviewed is not None:
        known = load(spark, d, "benchmarks").select(norm_id("benchmark_id").alias("id")).where("id is not null").distinct()
        x, y = (F.coalesce(norm_id(c), F.lit("")) for c in ("benchmark_id_a", "benchmark_id_b"))
        rv = reviewed.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), exact_key("note").alias("note"))
        two = rv.where("a <> '' and a <> b")
        good = two.join(known, F.col("a") == known.id, "left_semi").join(known, F.col("b") == known.id, "left_semi")
        checks += [
            ("reviewed_pair_not_two", "error", rv.where("a = '' or a = b").select(pair)),
            ("reviewed_pair_missing", "error", two.select("a", "b").distinct().join(good.select("a", "b").distinct(), ["a", "b"], "left_anti").select(pair)),
            ("reviewed_pair_without_note", "error", good.where("note = ''").select(pair)),
            ("reviewed_pair_repeated", "error", good.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select(pair)),
        ]
        pairs = pairs.join(good.select("a", "b").distinct(), ["a", "b"], "left_anti")
    checks.append(("near_duplicate", "warning", pairs.select(pair)))
    out = violations(spark, d).unionByName(further_violations(spark, d))
    for rule, severity, rows in checks:
        out = out.unionByName(rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "key"))
    return out.distinct()


QUERIES = {f.__name__: f for f in (
    resolved_mentions, unresolved_mentions, resolved_dedup, resolved_drop_release, name_keys, source_urls, near_duplicate_names, page_mentions, resolution_accuracy, resolution_accuracy_micro, violations, further_violations, all_violations,
)}

_KEY = "trim(regexp_replace(replace(replace({c}, chr(160), ' '), '，', ','), '\\s+', ' ', 'g'))"
_RES = VIEWS + f""", ca as (select lower(trim(benchmark_id)) benchmark_id, benchmark_name from benchmarks union all select lower(trim(benchmark_id)), benchmark_name from community_benchmarks), nm as (select {_KEY.format(c="benchmark_name")} k, min(benchmark_id) id from ca where trim(benchmark_id) <> '' and trim(benchmark_name) <> '' group by 1),
al as (select {_KEY.format(c="alias")} k, min((lower(trim(benchmark_id)), match_type)) m from benchmark_aliases where trim(alias) <> '' and benchmark_id is not null group by 1),
en as (select coalesce(al.k, nm.k) k, case when al.k is not null then (select any_value(ca.benchmark_id) from ca where ca.benchmark_id = al.m[1] and trim(ca.benchmark_name) <> '') else nm.id end id, case when al.k is not null then 'alias' else 'canonical' end src, case when al.k is not null then al.m[2] else 'exact' end typ from al full join nm on al.k = nm.k),
pt as (select model_row_id, provider, model_name, release_date, unnest(string_split(benchmarks, ',')) p, generate_subscripts(string_split(benchmarks, ','), 1) pos_ from rel where benchmarks is not null),
ex as (select model_row_id, provider, model_name, release_date, raw_mention, row_number() over (partition by model_row_id order by pos_) "position" from (select *, {_KEY.format(c="p")} raw_mention from pt) where raw_mention <> ''),
rs as (select ex.*, en.id benchmark_id, case when en.id is not null then src end match_source, case when en.id is not null then typ end match_type from ex left join en on en.k = ex.raw_mention)
"""
_ACC = _RES + """, acc as (select model_row_id, count(g) gold, count(p) predicted, count_if(g is not null and p is not null) true_positive from (select distinct model_row_id, benchmark_id, 1 g from men) full join (select distinct model_row_id, benchmark_id, 1 p from rs where benchmark_id is not null) using (model_row_id, benchmark_id) group by 1)
"""
_SLUG = "lower(trim(regexp_replace(strip_accents({c}), '[^a-zA-Z0-9]+', '_', 'g'), '_'))"
_ROW = "select model_row_id, provider, model_name, release_date, raw_mention, \"position\", benchmark_id, match_source, match_type, 1::bigint multiplicity, round(1.0::double / count(*) over (partition by model_row_id), 6) release_weight, round(1.0::double / count(*) over (partition by model_row_id), 6) raw_weight from "


def _in(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


SQL_HEADLINE = COMPOSITION["headline_projections"]

SQL = {
    "resolved_mentions": _RES + _ROW + "rs where benchmark_id is not null",
    "unresolved_mentions": _RES + "select model_row_id, provider, \"position\", raw_mention from rs where benchmark_id is null",
    "resolved_dedup": _RES + ", g as (select model_row_id, provider, model_name, release_date, benchmark_id, string_agg(raw_mention, '; ' order by \"position\") raw_mention, count(*) multiplicity, arg_min(match_source, \"position\") match_source, arg_min(match_type, \"position\") match_type, min(\"position\") \"position\" from rs where benchmark_id is not null group by 1, 2, 3, 4, 5) select *, round(1.0::double / count(*) over (partition by model_row_id), 6) release_weight, round(multiplicity::double / sum(multiplicity) over (partition by model_row_id), 6) raw_weight from g",
    "resolved_drop_release": _RES + _ROW + "rs where model_row_id not in (select model_row_id from rs where benchmark_id is null)",
    "name_keys": VIEWS + f"select benchmark_id, {_KEY.format(c='benchmark_name')} exact_key, lower({_KEY.format(c='benchmark_name')}) identity_key, 'benchmark_' || {_SLUG.format(c='benchmark_name')} made_id, regexp_replace(lower(benchmark_name), '[^a-z0-9]+', '', 'g') edit_name, array_to_string(regexp_extract_all(lower(benchmark_name), '[a-z0-9]+'), ' ') tokens, trim(regexp_replace(lower('facet_' || benchmark_name || '_' || review_status), '[^a-z0-9]+', '_', 'g'), '_') stable_id from cat",
    "source_urls": LAUNCHES + "select model_row_id, link, source_url from lrel",
    "resolution_accuracy": _ACC + "select *, coalesce(round(true_positive::double / nullif(gold, 0), 6), 1) recall, coalesce(round(true_positive::double / nullif(predicted, 0), 6), case when gold = 0 then 1 else 0 end) \"precision\" from acc",
    "resolution_accuracy_micro": _ACC + "select sum(gold)::bigint gold, sum(predicted)::bigint predicted, sum(true_positive)::bigint true_positive, coalesce(round(sum(true_positive)::double / nullif(sum(gold), 0), 6), 1) recall, coalesce(round(sum(true_positive)::double / nullif(sum(predicted), 0), 6), 0) \"precision\" from acc",
    "violations": _RES + f""", bm as (select distinct lower(trim(benchmark_id)) id, trim(benchmark_name) name, review_status, coalesce(frontier_lab_author_affiliations, '') aff from benchmarks), ids as (select distinct id from bm),
a as (select distinct alias_id::varchar k, trim(alias) alias, lower(trim(benchmark_id)) target, match_type from benchmark_aliases)
select distinct rule, severity, key from (
select 'duplicate_benchmark_id' rule, 'error' severity, id "key" from bm group by id having count(distinct name) > 1
union all select 'duplicate_benchmark_name', 'error', lower(name) from bm where name <> '' group by lower(name) having count(distinct id) > 1
union all select 'id_not_from_name', 'error', id from bm where name <> '' and id <> 'benchmark_' || {_SLUG.format(c="name")}
union all select 'invalid_review_status', 'error', id from bm where coalesce(review_status, '') not in {_in(STATUSES)}
union all select 'affiliation_list', 'error', id from (select id, aff, [trim(x) for x in string_split(aff, ';')] p from bm) where lower(aff) <> 'none' and (len([x for x in p if x = '' or x not in {_in(LABS)}]) > 0 or len(p) <> len(list_distinct(p)))
union all select 'alias_blank', 'error', k from a where coalesce(alias, '') = '' or target is null
union all select 'alias_duplicate', 'error', alias from a group by alias having count(distinct target) > 1
union all select 'alias_target_missing', 'error', k from a where target is not null and target not in (select id from ids)
union all select 'alias_shadows_name', 'error', k from a join bm on a.alias = bm.name and a.target <> bm.id
union all select 'alias_match_type', 'error', k from a where coalesce(match_type, '') not in {_in(MATCH_TYPES)}
union all select 'unresolved_mention', 'error', raw_mention from rs where benchmark_id is null
union all select 'unused_benchmark', 'warning', id from ids where id not in (select benchmark_id from men)
union all select 'facet_blank', 'error', facet_row_id::varchar from benchmark_facets where nullif(trim(benchmark_id), '') is null or coalesce(trim(facet_axis), '') = '' or coalesce(trim(facet_label), '') = ''
union all select 'facet_confidence_range', 'error', facet_row_id::varchar from facall where confidence < 0 or confidence > 1
union all select 'facet_confidence_status', 'error', facet_row_id::varchar from facall where confidence < 0.7 and review_status not in ('needs_review', 'disputed', 'deprecated')
union all select 'facet_axis_unknown', 'error', facet_row_id::varchar from facall where facet_axis not in {_in(AXES)}
union all select 'facet_owner_unknown', 'error', facet_row_id::varchar from facall where benchmark_id not in (select id from ids)
union all select 'facet_duplicate', 'error', benchmark_id || '|' || facet_axis || '|' || facet_label from fac group by benchmark_id, facet_axis, facet_label having count(*) > 1
union all select 'facet_axis_missing', 'error', id || '|' || x from ids cross join (select unnest({list(AXES)}) x) where not exists (select 1 from fac where fac.benchmark_id = ids.id and fac.facet_axis = x))""",
    "further_violations": _RES + f""", bm as (select distinct lower(trim(benchmark_id)) id, benchmark_name, trim(legacy_task_mode) m, trim(legacy_task_domain) o from benchmarks), a as (select distinct alias_id::varchar k, alias from benchmark_aliases), u as (select distinct raw_mention from ex),
fr as (select facet_row_id::varchar k, min(trim(facet_axis)) x, min(trim(facet_label)) l, min(trim(review_status)) s, max(case when not isnan(classification_confidence) then classification_confidence end) c from benchmark_facets group by facet_row_id),
hp as ({SQL_HEADLINE})
select distinct rule, severity, "key" from (
select 'invalid_task_mode' rule, 'error' severity, id "key" from bm where m <> '' and m not in {_in(TASK_MODES)}
union all select 'invalid_task_domain', 'error', id from bm where o <> '' and o not in {_in(TASK_DOMAINS)}
union all select 'facet_status_blank', 'error', k from fr where coalesce(s, '') = ''
union all select 'facet_status_invalid', 'error', k from fr where s <> '' and s not in {_in(STATUSES)}
union all select 'facet_confidence_missing', 'error', k from fr where c is null
union all select 'facet_label_invalid', 'error', k from fr where l <> '' and ({" or ".join(f"(x = '{axis}' and l not in {_in(labels)})" for axis, labels in FACET_LABELS.items())})
union all select 'invalid_release_date', 'error', model_row_id::varchar from models where release_date is null
union all select 'duplicate_name_identity', 'error', lower({_KEY.format(c="benchmark_name")}) from bm where trim(benchmark_name) <> '' group by 3 having count(distinct id) > 1
union all select 'duplicate_alias_identity', 'error', lower({_KEY.format(c="alias")}) from a where trim(alias) <> '' group by 3 having count(distinct k) > 1
union all select 'unused_alias', 'warning', k from a where coalesce({_KEY.format(c="alias")}, '') not in (select raw_mention from u)
union all select 'unused_name', 'warning', coalesce(trim(benchmark_name), '') from bm where coalesce({_KEY.format(c="benchmark_name")}, '') not in (select raw_mention from u)
union all select 'headline_repeated', 'error', benchmark_id from fac where facet_axis = '{HEADLINE_AXIS}' group by benchmark_id having count(*) > 1
union all select 'headline_not_derivable', 'error', benchmark_id from fac where facet_axis in {_in(AXES)} group by benchmark_id having count(distinct facet_axis) = {len(AXES)} and benchmark_id not in (select benchmark_id from hp))""",
}
