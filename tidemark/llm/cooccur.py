"""Items that appear together: an incremental table of pair counts.

State lives in a shared folder: the set of items of every basket, the count of every pair that occurs together, and
the number of baskets of every item. A change replaces the content of some baskets. The pairs that this adds and takes go out as signed deltas, and so do
the numbers of baskets of their items. Deltas are summed within each task, meet in hash buckets and are written beside the
counts that are there, bucket by bucket; what a bucket holds is the sum of its layers, and a bucket with more than LAYERS of them is merged into one. So a
change writes as much as it alters, however large the table is. Scores are computed from the counts, for all pairs or for those that a
change touched. Versions are never overwritten, so a failed job leaves the last one whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sizes import lookup_join
from tidemark.session import folder_names, register_written, shared_folder, written

#: Hash buckets of a pair table at the least; so many that one holds about BUCKET_PAIRS of the pairs of the first load.
BUCKETS, BUCKET_PAIRS, MOST_BUCKETS = 64, 4_000_000, 100_000
#: Layers that a bucket, the sets and the item counts may have before they are merged.
LAYERS = 4
#: Items of a basket whose pairs are made at once; larger baskets are cut into blocks of so many items.
BLOCK = 256
#: Pairs that a task holds before it sums them and hands them on.
PAIR_BUDGET = 1_000_000

_SETS = "basket bigint, items array<bigint>"
_PAIRS = "a bigint, b bigint, n bigint"
_ITEMS = "item bigint, name string, n bigint"


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, c, s = (np.concatenate(p) for p in zip(*parts, strict=True))
    lo, hi = np.minimum(a, c), np.maximum(a, c)
    order = np.lexsort((hi, lo))
    lo, hi, s = lo[order], hi[order], s[order]
    at = np.nonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))[0]
    return pd.DataFrame({"a": lo[at], "b": hi[at], "n": np.add.reduceat(s, at)})


def _pairs(batches: Iterator[pd.DataFrame], budget: int = PAIR_BUDGET) -> Iterator[pd.DataFrame]:
    """Signed pairs of the batches (left, right, same, sign), those within left where `same` and those of left with right, summed whenever about `budget` of them are held."""
    for b in batches:
        lefts, rights, same, sign = b["left"].tolist(), b["right"].tolist(), b["same"].to_numpy(bool), b["sign"].to_numpy(np.int64)
        size, across = np.array([len(x) for x in lefts], np.int64), np.array([len(x) for x in rights], np.int64)
        pairs = np.where(same, size * (size - 1) // 2, 0) + size * across
        # rows of one size lie together, so that they are paired as one array
        order = np.lexsort((across, size))
        order = order[pairs[order] > 0]
        turn = (np.cumsum(pairs[order]) - pairs[order]) // budget
        for part in np.split(order, np.nonzero(np.diff(turn))[0] + 1) if len(order) else ():
            parts = []
            for k, m in np.unique(np.stack([size[part], across[part]], 1), axis=0):
                at = part[(size[part] == k) & (across[part] == m)]
                grid = np.array([lefts[i] for i in at], np.int64)
                if m:
                    other = np.array([rights[i] for i in at], np.int64)
                    parts.append((np.repeat(grid, m, 1).ravel(), np.tile(other, (1, k)).ravel(), np.repeat(sign[at], k * m)))
                grid, at = grid[same[at]], at[same[at]]
                i, j = np.triu_indices(k, 1)
                parts.append((grid[:, i].ravel(), grid[:, j].ravel(), np.repeat(sign[at], len(i))))
            yield _summed(parts)


def pair_rows(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, n), summed within tasks only: the pairs within items and those of items with others, of sets (items, others array<bigint>, sign). Larger sets are cut into
    blocks of `block` items and pairs of blocks spread over the tasks, so that no task makes all pairs of a huge basket."""
    fits = F.size("items") + F.size("others") <= block
    some = sets.where(F.size("items") > 0)
    small = some.where(fits).select(F.col("items").alias("left"), F.col("others").alias("right"), F.lit(True).alias("same"), "sign")
    cut = lambda c: F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(1), F.size(c), F.lit(block)), lambda i: F.slice(c, i, block))).otherwise(F.expr("cast(array() as array<array<bigint>>)"))
    none = F.expr("cast(array() as array<bigint>)")
    large = some.where(~fits).select("sign", cut("items").alias("blocks"), cut("others").alias("more")).select("sign", "blocks", "more", F.posexplode("blocks").alias("i", "left"))
    own = large.select("sign", "i", "left", F.posexplode("blocks").alias("j", "right")).where("i <= j").select("left", F.when(F.col("i") < F.col("j"), F.col("right")).otherwise(none).alias("right"), (F.col("i") == F.col("j")).alias("same"), "sign")
    far = large.select("left", F.explode("more").alias("right"), F.lit(False).alias("same"), "sign")
    return small.unionByName(own.unionByName(far).repartition("left", "right")).mapInPandas(_pairs, _PAIRS)


def signed_pairs(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, n) summed over sets (items array<bigint>, sign)."""
    return pair_rows(sets.withColumn("others", F.expr("cast(array() as array<bigint>)")), block).groupBy("a", "b").agg(F.sum("n").alias("n"))


class PairTable:
    """Counts of pairs of items over baskets, kept in `folder` (by default one of its own in the shared folder, which clear_written deletes).

    Baskets and items are strings; null ones are skipped, and repeated items of a basket count once. They are held as 64-bit
    hashes; two items with one hash are refused, not mixed up.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, layers: int = LAYERS):
        self.spark, self.layers = spark, layers
        self.folder = folder or f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
        # pairs: layers [folder, buckets written, buckets still read]; sets and items: layers, of sets the later one counts
        self.state: dict = {"version": 0, "buckets": buckets, "sets": [], "pairs": [], "items": []}
        if folder is None:
            register_written(self.folder)
        else:
            try:
                newest = spark.read.text(f"{folder}/log/*").select(F.max(F.struct(F.get_json_object("value", "$.version").cast("int"), "value")).alias("m")).first()
                if newest and newest.m:
                    self.state = json.loads(newest.m["value"])
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        names = [c.split()[0] for c in schema.split(", ")]
        return self.spark.read.schema(schema).parquet(*paths).select(*names)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("a", "b"), F.lit(self.state["buckets"])).cast("int")

    def _pair_layers(self, only: set[int] | None = None) -> DataFrame:
        """Pair rows of all buckets, or some; a whole layer is read by its folder."""
        out = None
        for root, made, live in self.state["pairs"]:
            want = live if only is None else [b for b in live if b in only]
            if want:
                part = self._read([root] if len(want) == made else [f"{root}/bucket={b}" for b in want], _PAIRS)
                out = part if out is None else out.unionByName(part)
        return self._read([], _PAIRS) if out is None else out

    def _depth(self) -> dict[int, int]:
        """The layers of each bucket."""
        depth: dict[int, int] = {}
        for _, _, live in self.state["pairs"]:
            for b in live:
                depth[b] = depth.get(b, 0) + 1
        return depth

    def pairs(self) -> DataFrame:
        """(a, b, n): the counts as they stand."""
        rows = self._pair_layers()
        if max(self._depth().values(), default=0) > 1:
            rows = rows.groupBy("a", "b").agg(F.sum("n").alias("n"))
        return rows.where("n <> 0")

    def baskets(self) -> DataFrame:
        """(basket hash, items): the sets as they stand; of a basket with several versions the newest."""
        out = None
        for version, path in self.state["sets"]:
            part = self._read([path], _SETS).withColumn("version", F.lit(version))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], _SETS)
        if len(self.state["sets"]) > 1:
            out = out.groupBy("basket").agg(F.max_by("items", "version").alias("items"))
        return out.select("basket", "items").where(F.size("items") > 0)

    def items(self) -> DataFrame:
        """(item hash, name, n): the number of baskets of each item. Two names with one hash raise."""
        rows = self._read(self.state["items"], _ITEMS)
        one = rows.groupBy("item").agg(F.min("name").alias("name"), F.max("name").alias("other"), F.sum("n").alias("n"))
        clash = F.raise_error(F.concat(F.lit("one hash for two items: "), "name", F.lit(", "), "other"))
        return one.select("item", F.when(F.col("name") != F.col("other"), clash).otherwise(F.col("name")).alias("name"), "n").where("n > 0")

    def _write_pairs(self, rows: DataFrame, path: str) -> list[int]:
        """Writes pair rows summed by pair, in one shuffle by bucket, so that a bucket is one file; returns the buckets."""
        tasks = min(self.state["buckets"], max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions"))) * 4)
        met = rows.withColumn("bucket", self._bucket()).repartition(tasks, "bucket")
        summed = met.groupBy("bucket", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
        summed.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        return sorted(int(x.split("=")[1]) for x in folder_names(self.spark, path) if x.startswith("bucket="))

    def apply(self, changes: DataFrame, removed: DataFrame | None = None) -> None:
        """Replaces the content of every basket that `changes` (basket, item) names by just these items, and empties those
        of `removed` (basket). All other baskets stay."""
        spark, state = self.spark, self.state
        version = state["version"] + 1
        at = f"{self.folder}/v{version}-{uuid.uuid4().hex[:8]}"
        rows = changes.select("basket", "item").where("basket is not null and item is not null")
        named = rows.select(F.xxhash64("basket").alias("basket"), F.xxhash64("item").alias("item"), F.col("item").alias("name"))
        fresh = named.groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items"))
        if removed is not None:
            gone = removed.select(F.xxhash64("basket").alias("basket"), F.expr("cast(array() as array<bigint>)").alias("items")).distinct()
            fresh = fresh.unionByName(gone.join(fresh, "basket", "left_anti"))
        fresh.write.parquet(f"{at}/sets")
        fresh = self._read([f"{at}/sets"], _SETS)
        plus, minus, none = F.lit(1).cast("bigint"), F.lit(-1).cast("bigint"), F.expr("cast(array() as array<bigint>)")
        if state["sets"]:
            # only what differs is sent: the pairs of items that came, among themselves and with those that stayed, and likewise of items that went
            old = self.baskets().select("basket", F.col("items").alias("old")).join(fresh.select("basket"), "basket", "left_semi")
            both = fresh.join(old, "basket", "left").withColumn("old", F.coalesce("old", none))
            parts = F.array(F.struct(F.array_except("items", "old").alias("items"), plus.alias("sign")), F.struct(F.array_except("old", "items").alias("items"), minus.alias("sign")))
            signed = written(both.select(F.array_intersect("items", "old").alias("others"), F.inline(parts)).where(F.size("items") > 0), "changes")
        else:
            signed = fresh.select(none.alias("others"), "items", plus.alias("sign"))
        if state["buckets"] is None:
            size = F.size("items").cast("bigint")
            made = fresh.agg(F.sum(size * (size - 1) / 2)).first()[0] or 0
            state["buckets"] = int(min(MOST_BUCKETS, max(BUCKETS, made // BUCKET_PAIRS)))
        touched = self._write_pairs(pair_rows(signed), f"{at}/pairs")
        counts = signed.select(F.explode("items").alias("item"), "sign").groupBy("item").agg(F.sum("sign").alias("n"))
        # both names of a hash would be kept, so that a clash shows
        counts.join(named.select("item", "name").distinct(), "item", "left").select("item", "name", "n").write.parquet(f"{at}/items")
        new = [[f"{at}/pairs", len(touched), touched]] if touched else []
        self.state = {"version": version, "buckets": state["buckets"], "sets": [*state["sets"], [version, f"{at}/sets"]], "pairs": [*state["pairs"], *new], "items": [*state["items"], f"{at}/items"]}
        self._merge(at, self.layers)
        spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.text(f"{self.folder}/log/{version}")

    def _merge(self, at: str, layers: int) -> None:
        """Merges buckets, sets and item counts that have more layers than that."""
        state = self.state
        deep = {b for b, n in self._depth().items() if n > layers}
        if deep:
            there = self._write_pairs(self._pair_layers(deep), f"{at}/merged-pairs")
            kept = [[root, made, [b for b in live if b not in deep]] for root, made, live in state["pairs"]]
            state["pairs"] = [*[x for x in kept if x[2]], *([[f"{at}/merged-pairs", len(there), there]] if there else [])]
        if len(state["sets"]) > layers:
            self.baskets().write.parquet(f"{at}/merged-sets")
            state["sets"] = [[state["version"], f"{at}/merged-sets"]]
        if len(state["items"]) > layers:
            self.items().write.parquet(f"{at}/merged-items")
            state["items"] = [f"{at}/merged-items"]

    def compact(self) -> None:
        """Merges all layers, as a version of its own."""
        self.state = json.loads(json.dumps(self.state)) | {"version": self.state["version"] + 1}
        self._merge(f"{self.folder}/v{self.state['version']}-{uuid.uuid4().hex[:8]}", 1)
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.text(f"{self.folder}/log/{self.state['version']}")

    def scores(self, least: int = 1, lift: float = 0.0, touching: DataFrame | None = None) -> DataFrame:
        """(item_a, item_b, n, n_a, n_b, lift, pmi), item_a < item_b: pairs in at least `least` baskets that are together at least
        `lift` times as often as chance, n * B / (n_a * n_b), B the number of baskets with an item. touching (item): only
        pairs with one of these items, to recompute what a change affected. The bound is compared in whole numbers, exactly."""
        bound = Fraction(str(lift))
        if bound < 0 or bound.denominator > 10**6 or bound.numerator > 10**9:
            raise ValueError("lift must be a number from 0 to 1000 with at most six decimals")
        total = self.baskets().count()
        items = written(self.items(), "items")
        pairs = self.pairs().where(F.col("n") >= max(least, 1))
        if touching is not None:
            hit = touching.where("item is not null").select(F.xxhash64("item").alias("t")).distinct()
            pairs = pairs.join(hit.withColumnRenamed("t", "a"), "a", "left_semi").unionByName(pairs.join(hit.withColumnRenamed("t", "a"), "a", "left_anti").join(hit.withColumnRenamed("t", "b"), "b", "left_semi"))
        a, b = (items.select(F.col("item").alias(x), F.col("name").alias(f"name_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
        full = lookup_join(lookup_join(pairs, a, "a"), b, "b")
        whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
        full = full.where(whole("n", 18) * F.lit(total * bound.denominator).cast("decimal(20,0)") >= whole("n_a", 14) * whole("n_b", 14) * F.lit(bound.numerator).cast("decimal(10,0)"))
        first = F.col("name_a") < F.col("name_b")
        ratio = F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b").cast("double"))
        return full.select(
            F.least("name_a", "name_b").alias("item_a"), F.greatest("name_a", "name_b").alias("item_b"), "n",
            F.when(first, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(first, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
            ratio.alias("lift"), F.log2(ratio).alias("pmi"),
        )


def apply_in_loads(table: PairTable, rows: DataFrame, loads: int) -> DataFrame:
    """Applies rows (basket, item, at timestamp) to the table as they arrived, in `loads` loads that cover equal spans of time: each replaces the baskets that got an
    item in its span by their content at its end. Returns the items (item) of the baskets that the last load changed. Rows without a time belong to the first load."""
    first = written(rows.where("basket is not null and item is not null").groupBy("basket", "item").agg(F.unix_micros(F.min(F.col("at").cast("timestamp"))).alias("at")), "arrivals")
    span = first.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    lo, hi = (span.lo or 0, span.hi or 0)
    ends = [lo + (hi - lo) * (i + 1) // loads for i in range(loads)]
    seen, touched = F.coalesce("at", F.lit(lo)), None
    for i, end in enumerate(ends):
        held = first.where(seen <= end)
        if i:
            touched = first.where((seen > ends[i - 1]) & (seen <= end)).select("basket").distinct()
            held = held.join(touched, "basket", "left_semi")
        table.apply(held)
    return held.select("item").distinct()
