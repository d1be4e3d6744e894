"""Long facet tables: headline projections and reviewed replacements."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import benchmark_id
from tidemark.functions.vocab import CONFIDENCE, CONSTRUCT_AXES, HEADLINE_AXIS, HEADLINE_RULES


def headline_projection(facets: DataFrame, rules: Sequence[tuple[str, dict[str, tuple[str, ...]]]] = HEADLINE_RULES) -> DataFrame:
    """(benchmark_id, projection, confidence): the first rule that a benchmark's labels meet, with the least confidence among its labels on the
    axes of the rules, or CONFIDENCE where none is rated. Benchmarks that meet no rule give no row.

    facets: active rows (benchmark_id, facet_axis, facet_label, confidence). Labels are compared in lower case, the axes of construct claims as one.
    """
    axes = {a.removeprefix("!") for _, r in rules for a in r}
    axis = F.when(F.col("facet_axis").isin(*CONSTRUCT_AXES), "construct_claim").otherwise(F.col("facet_axis"))
    rows = facets.select("benchmark_id", axis.alias("axis"), F.lower(F.trim("facet_label")).alias("label"), "confidence").where(F.col("axis").isin(*axes) & (F.col("label") != ""))

    def met(spec: dict[str, tuple[str, ...]]) -> Column:
        tests = [(F.col("axis") == a.removeprefix("!")) & (~F.col("label").isin(*ls) if a[0] == "!" else F.col("label").isin(*ls)) for a, ls in spec.items()]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return F.bool_or(out)

    g = rows.groupBy("benchmark_id").agg(*[met(spec).alias(f"r{i}") for i, (_, spec) in enumerate(rules)], F.min("confidence").alias("confidence"))
    projection = F.coalesce(*[F.when(F.col(f"r{i}"), F.lit(name)) for i, (name, _) in enumerate(rules)])
    return g.select("benchmark_id", projection.alias("projection"), F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence")).where("projection is not null")


def with_headline(facets: DataFrame) -> DataFrame:
    """facets (benchmark_id, facet_axis, facet_label, confidence, review_status) and one derived headline row, to be reviewed, for every benchmark that has none."""
    active = facets.where("review_status <> 'deprecated' and trim(facet_axis) <> '' and trim(facet_label) <> ''")
    there = active.where(F.col("facet_axis") == HEADLINE_AXIS).select("benchmark_id").distinct()
    made = headline_projection(active).join(there, "benchmark_id", "left_anti")
    cols = ["benchmark_id", "facet_axis", "facet_label", "confidence", "review_status"]
    derived = made.select("benchmark_id", F.lit(HEADLINE_AXIS).alias("facet_axis"), F.col("projection").alias("facet_label"), "confidence", F.lit("needs_review").alias("review_status"))
    return facets.select(*cols).unionByName(derived)


def merge_reviewed(existing: DataFrame, reviewed: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """existing facet rows, with every (benchmark, axis) that `reviewed` has replaced by its rows. Persisted headline rows and rows of benchmarks that are gone are dropped.

    reviewed: the columns of existing and benchmark_name; a row without an id is found by its name, without case. Raises where a row names no benchmark.
    """
    names = benchmarks.groupBy(F.lower(F.trim(F.regexp_replace("benchmark_name", r"(?U)\s+", " "))).alias("_name")).agg(F.min("benchmark_id").alias("_id"))
    key = F.lower(F.trim(F.regexp_replace(F.coalesce("benchmark_name", F.lit("")), r"(?U)\s+", " ")))
    named = reviewed.withColumn("_name", key).join(names, "_name", "left").withColumn("benchmark_id", F.coalesce(F.nullif(F.trim("benchmark_id"), F.lit("")), F.col("_id")))
    ids = benchmarks.select("benchmark_id").distinct()
    lost = named.join(ids, "benchmark_id", "left_anti").limit(20).collect()
    if lost:
        raise ValueError(f"reviewed rows that name no benchmark: {sorted({str(r.benchmark_id or r._name) for r in lost})}")
    kept = existing.where(F.col("facet_axis") != HEADLINE_AXIS).join(ids, "benchmark_id", "left_semi").join(named.select("benchmark_id", "facet_axis").distinct(), ["benchmark_id", "facet_axis"], "left_anti")
    return kept.select(*existing.columns).unionByName(named.select(*existing.columns))


def with_made_ids(catalogue: DataFrame, names: Sequence[str] = ("benchmark_name", "name")) -> DataFrame:
    """A catalogue with benchmark_name, from the first of its columns `names` that is there and not blank, and the benchmark_id that belongs to the name, whatever id it came with.
    Rows without a name are dropped."""
    there = [c for c in names if c in catalogue.columns]
    if not there:
        raise ValueError(f"none of the columns {', '.join(names)} is there")
    name = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in there])
    rest = [c for c in catalogue.columns if c not in (*there, "benchmark_id", "benchmark_name")]
    return catalogue.select(name.alias("benchmark_name"), *rest).where("benchmark_name is not null").withColumn("benchmark_id", benchmark_id(F.col("benchmark_name")))


def ordered(rows: DataFrame, ranks: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """rows sorted by columns whose values have a given order; values that are not listed come after them, by their own order."""
    keys = [k for c, values in ranks for k in (F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(c)), F.lit(0)), F.lit(len(values) + 1)), F.col(c))]
    return rows.orderBy(*keys)


def inferred_affiliations(author: Column, labs: Sequence[str]) -> Column:
    """The labs that an author text names as whole words, in any case, in the order of the list and joined by semicolons; `none` where it names none."""
    hits = F.array_compact(F.array(*[F.when(F.lower(author).rlike(rf"(?<![a-z]){re.escape(x.lower())}(?![a-z])"), F.lit(x)) for x in labs]))
    return F.when(F.size(hits) > 0, F.array_join(hits, "; ")).otherwise("none")
