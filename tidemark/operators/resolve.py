"""Exact resolution of mentioned names against a catalogue and its aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import exact_key
from tidemark.operators.sizes import lookup_join

POLICIES = ("error", "collect", "drop_release")


def check_catalogue(names: DataFrame, aliases: DataFrame) -> None:
    """Raises where an id has two names, a name two ids, an alias two targets, or an alias hides another entry's name.

    names: (benchmark_id, name_key, benchmark_name), aliases: (alias_key, target). One row of each fault is named.
    """
    faults = {
        "one id for two names": names.groupBy("benchmark_id").agg(F.count_distinct("benchmark_name").alias("n")).where("n > 1"),
        "one name for two ids": names.groupBy("name_key").agg(F.count_distinct("benchmark_id").alias("n")).where("n > 1"),
        "one alias for two targets": aliases.groupBy("alias_key").agg(F.count_distinct("target").alias("n")).where("n > 1"),
        "an alias that hides a name": aliases.join(names, F.col("alias_key") == F.col("name_key")).where("target <> benchmark_id").select("alias_key", "target"),
    }
    for what, rows in faults.items():
        if (row := rows.first()) is not None:
            raise ValueError(f"{what}: {row.asDict()}")


def exploded(releases: DataFrame, keep: list[str]) -> DataFrame:
    """One row per element of the comma list `benchmarks`, keyed exactly; blank elements are dropped before places are counted."""
    parts = releases.select(*keep, F.posexplode(F.split(F.coalesce("benchmarks", F.lit("")), ",")).alias("at", "part")).where(F.length("part") > 0)
    keyed = parts.withColumn("raw_mention", exact_key("part")).where("raw_mention <> ''")
    place = F.row_number().over(Window.partitionBy("model_row_id").orderBy("at")).cast("bigint")
    return keyed.withColumn("position", place).drop("at", "part")


def resolve(rows: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (raw_mention) with benchmark_id, match_source and match_type. An alias comes before a name, and an alias whose target is no
    catalogue entry resolves to nothing. names: (name_key, benchmark_id), aliases: (alias_key, target, match_type), one row per key."""
    ids = names.select(F.col("benchmark_id").alias("known")).distinct()
    a = aliases.join(ids, F.col("target") == F.col("known"), "left").select(F.col("alias_key").alias("key"), F.lit(1).alias("rank"), F.col("known").alias("benchmark_id"), F.lit("alias").alias("match_source"), "match_type")
    n = names.select(F.col("name_key").alias("key"), F.lit(2).alias("rank"), "benchmark_id", F.lit("canonical").alias("match_source"), F.lit("exact").alias("match_type"))
    first = a.unionByName(n).groupBy("key").agg(F.min(F.struct("rank", "benchmark_id", "match_source", "match_type")).alias("m"))
    entry = first.select("key", "m.benchmark_id", "m.match_source", "m.match_type")
    blank = lambda c: F.when(F.col("benchmark_id").isNotNull(), F.col(c)).alias(c)
    out = lookup_join(rows.withColumn("key", F.col("raw_mention")), entry, "key", "left").drop("key")
    return out.select(*rows.columns, "benchmark_id", blank("match_source"), blank("match_type"))


def build_resolved_mentions(releases: DataFrame, names: DataFrame, aliases: DataFrame, deduplicate: bool = False, policy: str = "error") -> tuple[DataFrame, DataFrame]:
    """(mentions, unresolved) of releases (model_row_id, provider, model_name, release_date, benchmarks).

    policy: `error` raises with up to 20 samples if any element is unresolved, `collect` returns them, `drop_release` drops every
    mention of a release with one. deduplicate: one row per release and benchmark, at its first place, raw forms joined. release_weight shares
    a release among the rows that are left; raw_weight shares it among its surviving elements.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    keep = ["model_row_id", "provider", "model_name", "release_date"]
    rows = resolve(exploded(releases, keep), names, aliases)
    unresolved = rows.where("benchmark_id is null").select("model_row_id", "provider", "position", "raw_mention")
    if policy == "error" and (sample := unresolved.limit(20).collect()):
        raise ValueError("unresolved: " + ", ".join(sorted({r.raw_mention for r in sample})))
    if policy == "drop_release":
        rows = rows.withColumn("bad", F.max(F.col("benchmark_id").isNull()).over(Window.partitionBy("model_row_id"))).where("not bad").drop("bad")
    good = rows.where("benchmark_id is not null")
    w = Window.partitionBy("model_row_id")
    if deduplicate:
        good = good.groupBy(*keep, "benchmark_id").agg(
            F.min("position").alias("position"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "raw_mention"))), lambda s: s["raw_mention"]), "; ").alias("raw_mention"), F.count("*").alias("multiplicity"),
            F.min_by("match_source", "position").alias("match_source"), F.min_by("match_type", "position").alias("match_type"),
        )
    else:
        good = good.withColumn("multiplicity", F.lit(1).cast("bigint"))
    good = good.withColumn("release_weight", 1.0 / F.count("*").over(w)).withColumn("raw_weight", F.col("multiplicity") / F.sum("multiplicity").over(w))
    return good, unresolved


