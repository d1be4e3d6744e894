"""Queries p3, p4, p6, p7, p8 and p9, and the SQL that checks those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import norm_id, norm_name
from tidemark.llm import canonical, cooccur, langid, leakage, packing, setjoin
from tidemark.sources.tables import load

#: Least jaccard of similar releases, and least number of their benchmarks.
SIMILAR, LEAST_SIZE = 0.7, 4
#: Least number of baskets of a pair, and least ratio to chance.
TOGETHER, LIFT = 10, 3.0
#: Loads in which the mentions come to the pair table, by the time they were loaded.
LOADS = 3


def _releases(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "mentions").select("model_row_id", norm_id("benchmark_id").alias("benchmark_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of releases whose sets of benchmarks are similar."""
    pairs, members = setjoin.similar_records(_releases(spark, d), "model_row_id", "benchmark_id", SIMILAR, LEAST_SIZE)
    return setjoin.expand(pairs, members).select(F.col("id_a").alias("model_row_id_a"), F.col("id_b").alias("model_row_id_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every release with its class of equal sets and the number of similar releases."""
    pairs, members = setjoin.similar_records(_releases(spark, d), "model_row_id", "benchmark_id", SIMILAR, LEAST_SIZE)
    return setjoin.links(pairs, members).select(F.col("id").alias("model_row_id"), "class_id", "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark meant by each value that the exact lookup did not resolve, or `unmatched`."""
    seen = load(spark, d, "resolutions")
    often = seen.where("match_source is not null").groupBy(norm_id("benchmark_id").alias("target")).agg(F.count("*").alias("n"))
    names = load(spark, d, "benchmarks").select(F.col("benchmark_name").alias("name"), norm_id("benchmark_id").alias("target")).where("target is not null").distinct()
    aliases = load(spark, d, "benchmark_aliases").select(F.col("alias").alias("name"), norm_id("benchmark_id").alias("named")).distinct()
    live = names.select("target").distinct()
    aliases = aliases.join(live, aliases.named == live.target, "left").select("name", "target")  # a target that is not there names nothing
    entries = names.unionByName(aliases).join(often, "target", "left").select("name", "target", "n")
    providers = load(spark, d, "models").select(F.trim("provider").alias("provider"))
    found = canonical.map_to_canonical(seen.where("match_source is null"), "resolution_id", "raw_mention", entries, providers)
    return found.select("resolution_id", F.col("target").alias("benchmark_id"))


def _pair_table(spark: SparkSession, d: str) -> tuple[cooccur.PairTable, DataFrame]:
    """The pair table after mentions were applied as they were loaded, and the items that the last load touched."""
    table = cooccur.PairTable(spark)
    rows = load(spark, d, "mentions").select(norm_name("model_name").alias("basket"), norm_id("benchmark_id").alias("item"), F.col("loaded_at").alias("at"))
    return table, cooccur.apply_in_loads(table, rows, LOADS)


def _score_columns(scores: DataFrame) -> DataFrame:
    return scores.select(F.col("item_a").alias("benchmark_id_a"), F.col("item_b").alias("benchmark_id_b"), "n", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of benchmarks that are evaluated together far more often than chance."""
    return _pair_table(spark, d)[0].scores(TOGETHER, LIFT).select(F.col("item_a").alias("benchmark_id_a"), F.col("item_b").alias("benchmark_id_b"))


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    """Count and lift of every pair of benchmarks in at least TOGETHER baskets."""
    return _score_columns(_pair_table(spark, d)[0].scores(TOGETHER))


def p6_affected(spark: SparkSession, d: str) -> DataFrame:
    """The scores that the last load affected: those of pairs with an item of a basket that it changed."""
    table, touched = _pair_table(spark, d)
    return _score_columns(table.scores(TOGETHER, touching=touched))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Training sequences of 2,048 tokens: where each document, or part of a longer one, stands."""
    return packing.pack(packing.token_counts(load(spark, d, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold test items, and the items."""
    found = leakage.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"), "doc_id", "text", "item_id", "item_text")
    return found.select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold test items, without the leaked spans."""
    return leakage.without_leaks(load(spark, d, "documents"), load(spark, d, "eval_items"), "doc_id", "text", "item_id", "item_text")


def _stretches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = load(spark, d, "documents")
    return documents, langid.language_stretches(documents, "doc_id", "text", langid.fit_profiles(documents, "doc_id", "text", "lang"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the documents whose label does not name exactly these."""
    documents, found = _stretches(spark, d)
    return langid.mislabelled(documents, "doc_id", "text", "lang", found)


def p9_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every document in one language, with language and confidence."""
    return _stretches(spark, d)[1]


QUERIES = {f.__name__: f for f in (p3_found, p3_classes, p4_found, p6_found, p6_scores, p6_affected, p7_packed, p8_found, p8_cleaned, p9_found, p9_stretches)}

_SETS = """with m as (select distinct model_row_id r, lower(trim(benchmark_id)) b from mentions where nullif(trim(benchmark_id), '') is not null),
s as (select r, count(*) n, md5(string_agg(b, '|' order by b)) h from m group by r having count(*) >= 4),
p as (select x.r a, y.r b, count(*) c from m x join m y on x.b = y.b and x.r < y.r where x.r in (select r from s) and y.r in (select r from s) group by 1, 2),
f as (select p.a, p.b from p join s sa on sa.r = p.a join s sb on sb.r = p.b where c * 10 >= 7 * (sa.n + sb.n - c))
"""
_BASKETS = """with m as (select distinct lower(trim(regexp_replace(model_name, '\\s+', ' ', 'g'))) k, lower(trim(benchmark_id)) b from mentions
  where nullif(trim(benchmark_id), '') is not null and nullif(trim(model_name), '') is not null),
c as (select b, count(*) n from m group by 1), t as (select count(distinct k) b from m),
p as (select x.b a, y.b b, count(*) n from m x join m y on x.k = y.k and x.b < y.b group by 1, 2 having count(*) >= 10)
"""

SQL = {
    "p3_found": _SETS + "select a model_row_id_a, b model_row_id_b from f",
    "p3_classes": _SETS + "select s.r model_row_id, min(s.r) over (partition by h) class_id, coalesce(l.n, 0) links from s left join (select r, count(*) n from (select a r from f union all select b from f) group by 1) l on l.r = s.r",
    "p6_found": _BASKETS + "select p.a benchmark_id_a, p.b benchmark_id_b from p join c x on x.b = p.a join c y on y.b = p.b, t where p.n * t.b >= 3 * x.n * y.n",
    "p6_scores": _BASKETS + "select p.a benchmark_id_a, p.b benchmark_id_b, p.n, x.n n_a, y.n n_b, round(p.n * t.b::double / (x.n * y.n::double), 6) lift from p join c x on x.b = p.a join c y on y.b = p.b, t",
    "p6_affected": _BASKETS + """, r as (select lower(trim(regexp_replace(model_name, '\\s+', ' ', 'g'))) k, lower(trim(benchmark_id)) b, min(epoch_us(loaded_at)) seen from mentions
  where nullif(trim(benchmark_id), '') is not null and nullif(trim(model_name), '') is not null group by 1, 2), e as (select min(seen) + (max(seen) - min(seen)) * 2 // 3 t from r),
x as (select distinct b from r where k in (select k from r, e where seen > e.t))
select p.a benchmark_id_a, p.b benchmark_id_b, p.n, x.n n_a, y.n n_b, round(p.n * t.b::double / (x.n * y.n::double), 6) lift from p join c x on x.b = p.a join c y on y.b = p.b, t where p.a in (select b from x) or p.b in (select b from x)""",
}
