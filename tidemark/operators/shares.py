"""Ratios, weights and shares: the common steps of the result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sizes import lookup_join

DIGITS = 6


def ratio(a: Column, b: Column, digits: int | None = DIGITS) -> Column:
    """a / b, rounded for a result; null where b is 0 or null. digits: None leaves it as it is, for further steps."""
    made = F.try_divide(a.cast("double"), b.cast("double"))
    return made if digits is None else F.round(made, digits)


def ratio_or_zero(a: Column, b: Column, digits: int = DIGITS) -> Column:
    """a / b, rounded; 0 where b is 0 or null."""
    return F.coalesce(ratio(a, b, digits), F.lit(0.0))


def joined(c: Column, sep: str = "; ") -> Column:
    """The distinct non-null values, sorted by code point and joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def dedup_mentions(mentions: DataFrame) -> DataFrame:
    """One row per (model_row_id, benchmark_id) of mentions: first place, raw forms joined in order, multiplicity, and
    weights that sum to 1 in each release: release_weight by identity, raw_weight by mention."""
    one = mentions.groupBy("model_row_id", "benchmark_id").agg(
        F.min("provider").alias("provider"), F.min("model_name").alias("model_name"), F.min("release_date").alias("release_date"),
        F.min("mention_index").alias("mention_index"), F.count("*").alias("multiplicity"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mention_index", "raw_mention"))), lambda s: s["raw_mention"]), "; ").alias("raw_mentions"),
    )
    w = Window.partitionBy("model_row_id")
    return one.withColumn("release_weight", 1.0 / F.count("*").over(w)).withColumn("raw_weight", F.col("multiplicity") / F.sum("multiplicity").over(w))


def share_of(df: DataFrame, keys: Sequence[str], within: Sequence[str], value: str, out: str) -> DataFrame:
    """Sums of value by keys, and each sum's share of the total within `within` (a subset of keys)."""
    summed = df.groupBy(*keys).agg(F.sum(value).alias(value))
    total = F.sum(value).over(Window.partitionBy(*within)) if within else F.sum(value).over(Window.partitionBy(F.lit(1)))
    return summed.withColumn(out, ratio(F.col(value), total))


def facet_weights(units: DataFrame, facets: DataFrame, axis: str, weight: str = "release_weight") -> DataFrame:
    """units joined to their labels on one axis, the weight split evenly over the distinct labels of a benchmark."""
    return all_facet_weights(units, facets, (axis,), weight).drop("facet_axis")


def all_facet_weights(units: DataFrame, facets: DataFrame, axes: Sequence[str], weight: str = "release_weight") -> DataFrame:
    """units joined to their labels on each of the axes (facet_axis, facet_label), the weight of a unit split evenly over the distinct labels that its benchmark has on the axis
    (n_labels, label_weight). The labels of a benchmark go as one row, so a hot benchmark's units are not gathered."""
    labels = facets.where(F.col("facet_axis").isin(*axes)).groupBy("benchmark_id", "facet_axis").agg(F.collect_set("facet_label").alias("labels"))
    side = labels.groupBy("benchmark_id").agg(F.collect_list(F.struct("facet_axis", "labels")).alias("_axes"))
    x = lookup_join(units, side, "benchmark_id").select("*", F.inline("_axes")).drop("_axes")
    x = x.withColumn("n_labels", F.size("labels").cast("bigint")).withColumn("label_weight", F.col(weight) / F.col("n_labels"))
    return x.select("*", F.explode("labels").alias("facet_label")).drop("labels")


def top_labels(df: DataFrame, label: str, weight: str, k: int, least_share: float | None = None) -> DataFrame:
    """df with all labels but the k heaviest (and, if given, those with a share of at least least_share) called Other. Ties go
    to the label that sorts first. The labels are a closed vocabulary, which bounds the broadcast."""
    totals = df.groupBy(label).agg(F.sum(weight).alias("_t"))
    ranked = totals.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(F.round("_t", 9)), label))).withColumn("_s", F.col("_t") / F.sum("_t").over(Window.partitionBy(F.lit(1))))
    keep = F.col("_r") <= k
    if least_share is not None:
        keep = keep | (F.col("_s") >= least_share)
    kept = ranked.where(keep).select(label, F.lit(True).alias("_kept"))
    return df.join(F.broadcast(kept), label, "left").withColumn(label, F.when(F.col("_kept"), F.col(label)).otherwise("Other")).drop("_kept")
