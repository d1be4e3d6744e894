"""Model responses as tables: JSON in text, extracted names, and what needs review."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vocab import ACCEPT_CONFIDENCE, CONFIDENCE, SAFE_RELATIONSHIPS
from tidemark.operators.sizes import lookup_join

ITEM = "struct<raw_name:string,canonical_name:string,relationship:string,confidence:string,source_excerpt:string>"
RESPONSE = f"struct<benchmarks:array<{ITEM}>,unknown_mentions:array<{ITEM}>>"


def json_text(c: Column) -> Column:
    """The outermost JSON object of a text, fenced or not; null where there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def confidence(c: Column, default: float = ACCEPT_CONFIDENCE) -> Column:
    """A confidence from 0 to 1: percentages are divided by 100, others cut to the range; the default where it is no number."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v))))


def relationship(c: Column) -> Column:
    """A relationship as one lower-case word."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def extracted_items(responses: DataFrame, page_id: str, text: str) -> DataFrame:
    """(page_id, item, raw_name, canonical_name, relationship, confidence, source_excerpt): the names that responses list, mapped and unknown ones alike.
    Items that are plain strings count as exact. Text without readable JSON gives no row."""
    body = json_text(F.col(text))
    # plain strings are wrapped first, so that one schema reads both forms
    wrapped = F.regexp_replace(body, r'(?<=[\[,])\s*("(?:[^"\\]|\\.)*")\s*(?=[,\]])', r'{"raw_name":$1,"canonical_name":$1,"relationship":"exact"}')
    parsed = responses.select(F.col(page_id).alias("page_id"), F.from_json(wrapped, RESPONSE).alias("r"))
    both = F.concat(
        F.transform(F.coalesce("r.benchmarks", F.array().cast(f"array<{ITEM}>")), lambda x: F.struct(x.alias("i"), F.lit(False).alias("unknown"))),
        F.transform(F.coalesce("r.unknown_mentions", F.array().cast(f"array<{ITEM}>")), lambda x: F.struct(x.alias("i"), F.lit(True).alias("unknown"))),
    )
    x = parsed.select("page_id", F.posexplode(both).alias("item", "e"))
    return x.select("page_id", "item", F.trim(F.coalesce("e.i.raw_name", F.lit(""))).alias("raw_name"), F.when(F.col("e.unknown"), "").otherwise(F.trim(F.coalesce("e.i.canonical_name", F.lit("")))).alias("canonical_name"),
                    F.when(F.col("e.unknown"), "unknown").otherwise(relationship(F.col("e.i.relationship"))).alias("relationship"), confidence(F.col("e.i.confidence")).alias("confidence"), "e.i.source_excerpt")


def review_reasons(items: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """items with `reason`, empty where the mapping is safe. names: (name_key, benchmark_id), aliases: (alias_key, target), one row per key. A name is looked up
    before an alias here. Items without a reason are accepted, the others go to review."""
    n = lambda key, out: names.select(F.col("name_key").alias(key), F.col("benchmark_id").alias(out))
    a = lambda key, out: aliases.select(F.col("alias_key").alias(key), F.col("target").alias(out))
    x = items
    for side, key in ((n("canonical_name", "cn"), "canonical_name"), (a("canonical_name", "ca"), "canonical_name"), (n("raw_name", "rn"), "raw_name"), (a("raw_name", "ra"), "raw_name")):
        x = lookup_join(x, side, key, "left")
    target = F.coalesce("cn", "ca")
    rel = F.col("relationship")
    # fixed values: the reasons, in the order in which they are given
    reason = (
        F.when(F.col("raw_name") == "", "missing_raw_name").when(rel == "reject_source_only", "source_only_not_a_benchmark").when(F.col("canonical_name") == "", "new_or_unmapped_benchmark")
        .when(target.isNull(), "canonical_not_in_catalog").when(F.col("confidence") < ACCEPT_CONFIDENCE, "low_confidence_mapping")
        .when(F.col("rn") == target, "").when(rel.isin(*SAFE_RELATIONSHIPS) & (F.col("ra") == target), "")
        .when(rel == "semantic_equivalent", "semantic_mapping_requires_review").when(rel == "variant_or_family", "variant_or_family_mapping_requires_review").when(rel == "ocr_correction", "ocr_correction_requires_review")
        .when(F.col("ra").isNotNull() & (F.col("ra") != target), "explicit_alias_conflicts_with_llm_mapping").otherwise("not_exact_or_explicit_alias")
    )
    return x.select(*items.columns, target.alias("benchmark_id"), reason.alias("reason"))


FACETS = "map<string,array<struct<label:string,classification_confidence:string,evidence:string>>>"


def facet_labels(responses: DataFrame, row_id: str, text: str, allowed: DataFrame, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(labels, faults) of responses with an object `facets` of axes with lists of labels.

    labels: (row_id, facet_axis, facet_label, confidence, evidence, review_status) of the responses without a fault; where the least confidence of a response is below
    CONFIDENCE, its labels are to be reviewed. faults: (row_id, fault, detail): no_object, unknown_axis, invalid_label, missing_evidence, bad_confidence, missing_axis. allowed:
    (facet_axis, facet_label), a closed vocabulary.
    """
    parsed = responses.select(F.col(row_id).alias("row_id"), F.from_json(F.get_json_object(json_text(F.col(text)), "$.facets"), FACETS).alias("f"))
    rows = parsed.where("f is not null").select("row_id", F.explode("f").alias("facet_axis", "entries")).select("row_id", "facet_axis", F.explode_outer("entries").alias("e"))
    text_of = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = rows.select("row_id", "facet_axis", text_of("e.label").alias("facet_label"), F.col("e.classification_confidence").try_cast("double").alias("confidence"), text_of("e.evidence").alias("evidence"), F.col("e").isNotNull().alias("there"))
    axes = allowed.select("facet_axis", F.lit(True).alias("axis_known")).distinct()
    known = allowed.select("facet_axis", "facet_label", F.lit(True).alias("label_known")).distinct()
    x = rows.join(F.broadcast(axes), "facet_axis", "left").join(F.broadcast(known), ["facet_axis", "facet_label"], "left")  # closed vocabularies
    fault = (
        F.when(F.col("axis_known").isNull(), "unknown_axis").when(F.col("label_known").isNull(), "invalid_label").when(F.col("evidence") == "", "missing_evidence")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "bad_confidence")
    )
    x = x.withColumn("fault", F.when(F.col("there") | F.col("axis_known").isNull(), fault))
    faults = x.where("fault is not null").select("row_id", "fault", F.concat_ws(":", "facet_axis", "facet_label").alias("detail"))
    faults = faults.unionByName(parsed.where("f is null").select("row_id", F.lit("no_object").alias("fault"), F.lit("").alias("detail")))
    if required:
        need = parsed.where("f is not null").select("row_id", F.explode(F.array(*map(F.lit, required))).alias("facet_axis"))
        lacking = need.join(x.where("there").select("row_id", "facet_axis").distinct(), ["row_id", "facet_axis"], "left_anti")
        faults = faults.unionByName(lacking.select("row_id", F.lit("missing_axis").alias("fault"), F.col("facet_axis").alias("detail")))
    faults = faults.distinct()
    good = x.where("there").join(faults.select("row_id").distinct(), "row_id", "left_anti")
    least = F.min("confidence").over(Window.partitionBy("row_id"))
    labels = good.withColumn("review_status", F.when(least < CONFIDENCE, "needs_review").otherwise("accepted"))
    return labels.select("row_id", "facet_axis", "facet_label", "confidence", "evidence", "review_status"), faults


def coalesced(rows: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """rows with the columns named by `columns`, each the first text that is not blank among its own and its older names that are there; "" where there is none. Other columns
    stay."""
    taken = {c for old in columns.values() for c in old} | set(columns)
    first = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in names if c in rows.columns], F.lit(""))
    return rows.select(*[f"`{c}`" for c in rows.columns if c not in taken], *[first([new, *old]).alias(new) for new, old in columns.items()])
