"""All pairs of records whose sets of values overlap above a Jaccard threshold, by pigeonhole partitioning.

Two sets r, s with |r| <= |s| and jaccard >= t differ in at most H = floor((1-t)/(1+t) * (|r|+|s|)) values. The token
universe is split into m segments by a hash, m fixed by the size class of r; if s grants points p_i in {0, 1, 2} to
the segments with sum H+1, then in some segment r and s differ in fewer than p_i values: they are equal there (one
point), or at most one deletion apart (two points). So s looks up its segments with a point as they are, and those with
two points also with one value deleted; r stores all its segments, as they are and with one value deleted.

Which points s grants is its own choice. It takes the cheapest by the expected number of sets with the same
segment, from the frequency of the frequent tokens, over several independent splits; thus segments made of hot
tokens alone get no points. Candidates are screened by size and by a 64-bit sketch (the number of differing bits never
exceeds the number of differing values) inside the join, and verified exactly on the sets themselves.

Sets that are equal form one class; signatures and candidates are made per class only.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sizes import heavy_keys
from tidemark.session import written

#: Independent splits of the universe; s uses the best of them.
SPLITS = 2
#: Tokens with this share of all (record, token) rows have their frequency known to the tasks; at most 1/share tokens.
FREQUENT = 0.0005
#: Members of a class that are paired at a time.
BLOCK = 1024
#: Share of the stored signatures from which one is dealt out over blocks, of so many rows each.
HOT, BLOCK_ROWS = 0.0005, 20_000

_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MULT
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _most_different(t: Fraction, a, b):
    """The greatest number of differing values of sets of sizes a and b whose jaccard reaches t."""
    return (t.denominator - t.numerator) * (a + b) // (t.denominator + t.numerator)


def size_classes(t: Fraction, largest: int) -> list[int]:
    """Upper bounds of the size classes; sets that may be similar lie in the same or in neighbouring classes."""
    tops, low = [0], 1
    while low <= largest:
        tops.append(low * t.denominator // t.numerator)
        low = tops[-1] + 1
    return tops


def segments(t: Fraction, top: int) -> int:
    """The number of segments for sets up to size top: enough for all points that are ever needed, and one more."""
    most = int(_most_different(t, top, top * t.denominator // t.numerator))
    return (most + 2) // 2 + 1


def _cells(flat: np.ndarray, rec: np.ndarray, n: int, m: int, salt: int):
    """The split of n records into m segments: the cell of each value, and per cell the sum of its hashes."""
    with np.errstate(over="ignore"):
        own = _mix(flat + np.uint64((salt * 0x632BE59BD9B4E019 + 1) % 2**64))
        cell = rec * m + ((own >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        sums = np.zeros(n * m, np.uint64)
        np.add.at(sums, cell, own)
        place = _mix(np.arange(m, dtype=np.uint64) + np.uint64((salt * 1000003 + m) % 2**64))
        return cell, own, sums, np.tile(place, n)


def _emit(t: Fraction, frequent: np.ndarray, logp: np.ndarray, rare: float, splits: int, probes: bool):
    """A function over batches (id, size, hashes) that gives the signatures of one role: those that sets look up, or those that they store."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["size"].to_numpy(np.int64)
            if not len(sizes):
                continue
            tops = np.array(size_classes(t, int(sizes.max())), np.int64)
            klass = np.searchsorted(tops, sizes)
            for k in np.unique(klass):
                at = np.nonzero(klass == k)[0]
                flat = np.concatenate([np.asarray(x, np.int64) for x in batch["hashes"].iloc[at]]).astype(np.uint64)
                size, n = sizes[at], len(at)
                rec = np.repeat(np.arange(n), size)
                if len(frequent):
                    near = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
                    lp = np.where(frequent[near] == flat, logp[near], rare)
                else:
                    lp = np.full(len(flat), rare)
                sketch = np.bitwise_or.reduceat(np.uint64(1) << (_mix(flat) >> np.uint64(58)), np.concatenate([[0], np.cumsum(size)[:-1]]))
                ids = batch["id"].iloc[at].reset_index(drop=True)

                def frame(keys, who, deleted):
                    return pd.DataFrame({"key": keys.view(np.int64), "id": ids.iloc[who].reset_index(drop=True), "size": size[who].astype(np.int32), "sketch": sketch[who].view(np.int64), "deleted": deleted})

                def keyed(m, split, target):
                    cell, own, sums, place = _cells(flat, rec, n, m, split * 7919 + target)
                    with np.errstate(over="ignore"):
                        return cell, _mix(sums + place), _mix(sums[cell] - own + place[cell])

                m = segments(t, int(tops[k]))
                for split in range(0 if probes else splits):
                    cell, whole, less = keyed(m, split, int(k))
                    yield frame(whole, np.repeat(np.arange(n), m), np.zeros(n * m, bool))
                    yield frame(less, rec, np.ones(len(rec), bool))
                for target in (k, k - 1) if probes else ():
                    if target < 1:
                        continue
                    other = np.minimum(size, tops[target])
                    fits = other * t.denominator >= size * t.numerator
                    if not fits.any():
                        continue
                    m = segments(t, int(tops[target]))
                    need = _most_different(t, size, other) + 1
                    best, choice, made = np.full(n, np.inf), np.zeros(n, np.int64), []
                    for split in range(splits):
                        cell, whole, less = keyed(m, split, int(target))
                        one = np.exp(np.bincount(cell, lp, n * m)).reshape(n, m)
                        two = 3 * one + one * np.bincount(cell, np.exp(-lp), n * m).reshape(n, m)
                        both = np.concatenate([one, np.maximum(two, one)], axis=1)
                        order = np.argsort(both, axis=1, kind="stable")
                        taken = np.arange(2 * m)[None, :] < need[:, None]
                        cost = np.where(taken, np.take_along_axis(both, order, 1), 0).sum(1)
                        granted = np.zeros((n, 2 * m), bool)
                        np.put_along_axis(granted, order, taken, 1)
                        points = granted[:, :m].astype(np.int8) + granted[:, m:]
                        made.append((cell, whole, less, points))
                        choice[cost < best] = split
                        best = np.minimum(best, cost)
                    for split, (cell, whole, less, points) in enumerate(made):
                        mine = (choice == split) & fits
                        flatp = (points * mine[:, None]).reshape(-1)
                        sel = np.nonzero(flatp >= 1)[0]
                        yield frame(whole[sel], sel // m, np.zeros(len(sel), bool))
                        sel = np.nonzero(flatp[cell] >= 2)[0]
                        yield frame(less[sel], rec[sel], np.ones(len(sel), bool))

    return run


def record_sets(df: DataFrame, record: str, token: str, least: int = 1) -> DataFrame:
    """(id, tokens): the sorted distinct non-null tokens of each non-null record with at least `least` of them."""
    rows = df.select(F.col(record).alias("id"), F.col(token).alias("token")).where("id is not null and token is not null").distinct()
    return rows.groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("tokens")).where(F.size("tokens") >= least)


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of sets (id, tokens): classes (id, tokens, n) with the least id of equal sets as its id,
    members (id, class_id, n)."""
    keyed = sets.withColumn("h", F.xxhash64("tokens"))
    classes = keyed.groupBy("h", "tokens").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    many = classes.where("n > 1").select("h", "tokens", "class_id", "n")
    members = keyed.join(many, ["h", "tokens"], "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n", F.lit(1)).alias("n"))
    return classes.select(F.col("class_id").alias("id"), "tokens", "n"), members


def _hashed(sets: DataFrame) -> DataFrame:
    return sets.select("id", F.size("tokens").alias("size"), F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes")).where("size > 0")


def _token_costs(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes of the frequent tokens, sorted, the logarithm of the share of sets that have each, and that of any other token."""
    known = heavy_keys(sets.select(F.explode("tokens").alias("token")), "token", FREQUENT).select(F.xxhash64("key").alias("h"), "n").collect()  # at most 1/FREQUENT rows
    n_sets = max(1, sets.count())
    known = sorted((r.h % 2**64, np.log(min(1.0, r.n / n_sets))) for r in known)
    logp = np.array([p for _, p in known], float)
    return np.array([h for h, _ in known], np.uint64), logp, min([*logp, -6.0]) - 1.0


def _candidates(stored: DataFrame, asking: DataFrame, t: Fraction, costs: tuple[np.ndarray, np.ndarray, float], splits: int, order: str) -> DataFrame:
    """(r, s): ids of stored and asking sets with a signature in common that pass the tests of size and sketch; order: the condition on r and s that keeps each pair once,
    of which the stored set must not be the larger one.

    Stored signatures are written once. Those that hold HOT of them or more, at most 1/HOT, are dealt out over blocks of BLOCK_ROWS rows, to each of which the sets that
    ask for them go; a signature that many sets ask for but few hold is left to the splitting of skewed joins at run time.
    """
    p, q = t.numerator, t.denominator
    id_r, id_s = dict(stored.dtypes)["id"], dict(asking.dtypes)["id"]
    schema = "key bigint, id {}, size int, sketch bigint, deleted boolean"
    index = written(_hashed(stored).mapInPandas(_emit(t, *costs, splits, False), schema.format(id_r)), "signatures")
    probe = _hashed(asking).mapInPandas(_emit(t, *costs, splits, True), schema.format(id_s))
    hot = [(r.key, -(-r.n // BLOCK_ROWS)) for r in heavy_keys(index, "key", HOT).where(F.col("n") > BLOCK_ROWS).collect()]  # at most 1/HOT rows
    on = "r.key = s.key"
    if hot:
        blocks = F.broadcast(index.sparkSession.createDataFrame(hot, "key bigint, blocks bigint"))
        one = F.lit(1).cast("bigint")
        index = index.join(blocks, "key", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", one))).drop("blocks")
        probe = probe.join(blocks, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", one) - 1))).drop("blocks")
        on += " and r.block = s.block"
    return index.alias("r").join(probe.alias("s"), F.expr(
        f"{on} and not (r.deleted and s.deleted) and ({order}) and r.size * {q} >= s.size * {p}"
        f" and bit_count(r.sketch ^ s.sketch) <= ({q - p} * (r.size + s.size)) div {q + p}"
    )).select(F.col("r.id").alias("r"), F.col("s.id").alias("s"))


def _verified(pairs: DataFrame, a: DataFrame, b: DataFrame, t: Fraction) -> DataFrame:
    """(id_a, id_b, shared, jaccard) of the pairs (id_a, id_b) that reach the threshold, by their sets (id, tokens)."""
    a, b = (sets.select(F.col("id").alias(f"id_{x}"), F.col("tokens").alias(f"t_{x}")) for sets, x in ((a, "a"), (b, "b")))
    full = pairs.join(a, "id_a").join(b, "id_b").withColumn("shared", F.size(F.array_intersect("t_a", "t_b")))
    full = full.withColumn("either", F.size("t_a") + F.size("t_b") - F.col("shared")).where(f"shared * {t.denominator} >= either * {t.numerator}")
    return full.select("id_a", "id_b", "shared", (F.col("shared") / F.col("either")).alias("jaccard"))


def _fraction(threshold: float) -> Fraction:
    t = Fraction(str(threshold))
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    return t


def similar_classes(classes: DataFrame, threshold: float, splits: int = SPLITS) -> DataFrame:
    """(id_a, id_b, shared, jaccard) of all pairs of distinct classes (id, tokens) with jaccard >= threshold, id_a < id_b."""
    t = _fraction(threshold)
    found = _candidates(classes, classes, t, _token_costs(classes), splits, "r.size < s.size or (r.size = s.size and r.id < s.id)")
    return _verified(found.select(F.least("r", "s").alias("id_a"), F.greatest("r", "s").alias("id_b")).distinct(), classes, classes, t)


def similar_between(a: DataFrame, b: DataFrame, record: str, token: str, threshold: float, least: int = 1, splits: int = SPLITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, members of a, members of b): the pairs (id_a, id_b, shared, jaccard) of class representatives of table a and of table b that reach the threshold, and
    the members (id, class_id, n) of either table's classes. Equal sets of the two tables are a pair with jaccard 1.

    Both tables have (record, token) rows as in similar_records; their ids may clash. No pair within a table is looked at: the sets of a are stored and
    asked for by the sets of b that are as large or larger, then those of b by the larger sets of a.
    """
    t = _fraction(threshold)
    (ca, ma), (cb, mb) = (set_classes(written(record_sets(df, record, token, least), "sets")) for df in (a, b))
    ca, cb = written(ca, "classes"), written(cb, "classes")
    costs = _token_costs(ca.select("tokens").unionByName(cb.select("tokens")))
    small = _candidates(ca, cb, t, costs, splits, "r.size <= s.size").select(F.col("r").alias("id_a"), F.col("s").alias("id_b"))
    large = _candidates(cb, ca, t, costs, splits, "r.size < s.size").select(F.col("s").alias("id_a"), F.col("r").alias("id_b"))
    return _verified(small.unionByName(large).distinct(), ca, cb, t), ma, mb


def _in_blocks(members: DataFrame, block: int) -> DataFrame:
    """(class_id, part, ids): the members of each class in parts of about `block`, spread by a hash."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block).cast("bigint"))
    return members.groupBy("class_id", part.alias("part")).agg(F.collect_list("id").alias("ids"))


def expand(pairs: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of classes and the pairs within each class, as pairs of their members. Large classes are cut into parts of about `block`
    members, and pairs of parts are what is spread over the tasks, so no task pairs more than two parts at a time. For all pairs of copies this is as much as
    they are; links() says the same by counts."""
    parts = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.coalesce(c, F.lit(1)) / block).cast("bigint") - 1))
    many = members.where("n > 1")
    held = _in_blocks(many, block)
    sizes = many.where("id = class_id").select("class_id", "n")
    side = lambda x: held.select(F.col("class_id").alias(f"id_{x}"), F.col("part").alias(f"part_{x}"), F.col("ids").alias(f"ids_{x}"))
    size = lambda x: sizes.select(F.col("class_id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"))
    cut = pairs.select("id_a", "id_b").join(size("a"), "id_a", "left").join(size("b"), "id_b", "left")
    cut = cut.select("id_a", "id_b", "n_a", "n_b", parts("n_a").alias("part_a")).select("*", parts("n_b").alias("part_b"))
    ids = lambda x: F.explode(f"ids_{x}").alias(x)
    whole = lambda x: F.when(F.col(f"n_{x}").isNull(), F.array(f"id_{x}")).otherwise(F.col(f"ids_{x}")).alias(f"ids_{x}")
    across = cut.join(side("a"), ["id_a", "part_a"], "left").join(side("b"), ["id_b", "part_b"], "left").select(whole("a"), whole("b")).select(ids("a"), "ids_b").select("a", ids("b"))
    own = sizes.select(F.col("class_id").alias("id_a"), F.col("class_id").alias("id_b"), "n", parts("n").alias("part_a")).select("id_a", "id_b", "part_a", parts("n").alias("part_b")).where("part_a <= part_b")
    within = own.join(side("a"), ["id_a", "part_a"]).join(side("b"), ["id_b", "part_b"])
    within = within.select((F.col("part_a") == F.col("part_b")).alias("one"), "ids_b", ids("a")).select("one", "a", ids("b")).where("not one or a < b").drop("one")
    return across.unionByName(within).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def similar_records(df: DataFrame, record: str, token: str, threshold: float, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (id_a, id_b, shared, jaccard) between class representatives, members (id, class_id, n).

    df: (record, token) rows, in any order, repeated or not. Null records and tokens are skipped; records with fewer than
    `least` distinct tokens take no part. Every record is a member of one class, whose id is its least member; equal
    records are linked through their class. similar_between is the form for two tables. Nothing is capped: each pair that reaches the
    threshold comes out once.
    """
    classes, members = set_classes(written(record_sets(df, record, token, least), "sets"))
    classes = written(classes, "classes")
    return similar_classes(classes, threshold), members


def links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, links): each record with its class and the number of records similar to it, copies included."""
    sizes = members.groupBy("class_id").agg(F.max("n").alias("n"))
    both = pairs.select(F.col("id_a").alias("class_id"), F.col("id_b").alias("other")).unionByName(pairs.select(F.col("id_b").alias("class_id"), F.col("id_a").alias("other")))
    near = both.join(sizes.withColumnRenamed("class_id", "other"), "other").groupBy("class_id").agg(F.sum("n").alias("near"))
    per_class = sizes.join(near, "class_id", "left").select("class_id", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links"))
    return members.select("id", "class_id").join(per_class, "class_id").select("id", "class_id", "links")
