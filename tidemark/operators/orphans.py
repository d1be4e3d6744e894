"""References to records that do not exist, or did not when the referring row was written."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sizes import lookup_join
from tidemark.session import written


class Child(NamedTuple):
    """A referring table: its name, rows, key column, reference (already normalised) and time of writing."""

    name: str
    rows: DataFrame
    row_key: str
    reference: Column
    at: str


def _live(at: Column) -> Column:
    return F.exists("spans", lambda s: (s.since <= at) & (s.until.isNull() | (at < s.until)))


def orphan_rows(children: Sequence[Child], parents: DataFrame) -> DataFrame:
    """Rows whose non-null reference no parent was live for when they were written:
    (source_table, row_key string, reference, written_at). A row repeated is returned as often as it stands there.

    parents: (key, since, until), several rows a key allowed; a key is live from since up to but excluding until, or
    for good where until is null. A parent without since was never live. Null references are no orphans; a row
    without a time is one only if its key never was in any parent. Missing parents (an empty table) make all orphans.

    Only the distinct references, merged before the shuffle, meet the parents: a left anti-join gives the keys that
    nobody knows, and of the known ones those go on whose rows may lie outside their live spans. The rows then
    join these suspects alone, by broadcast while they are few, else with the rows of hot keys split off.
    """
    rows = None
    for c in children:
        part = c.rows.select(F.lit(c.name).alias("source_table"), F.col(c.row_key).cast("string").alias("row_key"), c.reference.alias("reference"), F.col(c.at).alias("written_at"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(F.col("reference").isNotNull())
    spans = parents.where("key is not null and since is not null").groupBy("key").agg(F.collect_set(F.struct("since", "until")).alias("spans"))
    keys = rows.groupBy("reference").agg(F.min("written_at").alias("least"), F.max("written_at").alias("most"))
    never = keys.join(spans, keys.reference == spans.key, "left_anti").select("reference", F.expr("cast(null as array<struct<since:timestamp,until:timestamp>>)").alias("spans"))
    whole = F.exists("spans", lambda s: (s.since <= F.col("least")) & (s.until.isNull() | (F.col("most") < s.until)))
    partly = keys.join(spans, keys.reference == spans.key).where(F.col("least").isNotNull() & ~whole).select("reference", spans.spans.cast("array<struct<since:timestamp,until:timestamp>>").alias("spans"))
    suspects = written(never.unionByName(partly), "suspects")  # counted, and joined back
    found = lookup_join(rows, suspects, "reference")
    at = F.col("written_at").cast("timestamp")
    return found.where(F.col("spans").isNull() | (at.isNotNull() & ~_live(at))).drop("spans")


def orphan_counts(children: Sequence[Child], parents: DataFrame, period: str = "month") -> DataFrame:
    """(source_table, period, orphans, orphan_keys) per table and period of writing; each row key counts once. Rows without a
    time stand under a null period. A key delivered in several periods counts in each."""
    rows = orphan_rows(children, parents).select("source_table", "row_key", "reference", F.to_date(F.date_trunc(period, "written_at")).alias("period")).distinct()
    by_key = rows.groupBy("source_table", "period", "reference").agg(F.count("*").alias("n"))  # rows are distinct
    return by_key.groupBy("source_table", "period").agg(F.sum("n").alias("orphans"), F.count("*").alias("orphan_keys"))
