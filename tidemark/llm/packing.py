"""Filling sequences of a fixed number of tokens with documents.

Items are packed by bounded-space online best-fit: an item goes to the open bin with the least free space that
still holds it; else a new bin is opened, and where more than `open_bins` are open, the fullest closes first. Open
bins are found by their free space through the bits of one integer. An item is split only if it exceeds the capacity: its full
parts are sequences of their own, and the rest is packed as an item.

Documents are spread by a hash of their id over shards of about equal size, each packed on its own and only by its (id, tokens)
pairs, in the order of the hash. A shard leaves at most `open_bins` bins that are not full; with
SHARD_BINS sequences in a shard these are a small share, whatever the size of the corpus.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

#: Where the vocabularies of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
CAPACITY = 2048
OPEN_BINS = 64
#: Sequences that a shard should hold at least.
SHARD_BINS = 4096
#: Fixed value: the published splitting pattern of this family of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The byte-level tokenizer whose ranks are in a file of lines `base64 rank`."""
    import tiktoken

    lines = Path(folder, vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens): the tokens of every whole text; null and empty texts have 0. Null ids are kept."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(folder, vocabulary)
        for b in batches:
            yield pd.DataFrame({"id": b["d"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["t"]]})

    rows = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    return rows.mapInPandas(count, f"id {dict(documents.dtypes)[doc_id]}, tokens bigint")


class BestFit:
    """Bounded-space online best-fit over one stream of items."""

    def __init__(self, capacity: int, open_bins: int):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be at least 1")
        self.capacity, self.open_bins = capacity, open_bins
        self.free: dict[int, list[int]] = {}  # free space -> bins with it, in the order of opening
        self.bits, self.open, self.made = 0, 0, 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        found = bins.pop(0)
        if not bins:
            del self.free[space]
            self.bits &= ~(1 << space)
        self.open -= 1
        return found

    def _put(self, number: int, space: int) -> None:
        if space:
            self.free.setdefault(space, []).append(number)
            self.bits |= 1 << space
            self.open += 1

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of an item of 1 to capacity."""
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, space = self.made, self.capacity
            self.made += 1
        self._put(number, space - size)
        return number, self.capacity - space

    def fresh(self) -> int:
        """A bin that is full at once."""
        self.made += 1
        return self.made - 1


def pack(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_bins: int = SHARD_BINS) -> DataFrame:
    """(shard, bin, offset, id, part, start, length) of items (id, tokens): every item whole in one bin, or, if it exceeds the
    capacity, its parts. start is the first token of the part in its item, offset its place in the bin.

    Items of no tokens and of null size take no space and give no row. Repeated ids are items of their own. Ties go to the
    bin opened first. The result depends on the items alone, not on how they are stored.
    """
    used = written(items.select("id", "tokens").where("tokens > 0"), "sizes")  # counted once, read for the total and for the packing
    total = used.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, int(total // (capacity * shard_bins)))
    id_type = dict(items.dtypes)["id"]
    rows = used.select("id", "tokens", F.xxhash64("id").alias("h")).withColumn("shard", F.pmod(F.shiftrightunsigned("h", 40), F.lit(shards)))
    ordered = rows.repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", "h", "id", "tokens")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bins = None, None
        for b in batches:
            out: list[tuple] = []
            for i, n, s in zip(b["id"], b["tokens"].tolist(), b["shard"].tolist(), strict=True):
                if s != now:
                    now, bins = s, BestFit(capacity, open_bins)
                at = part = 0
                while n - at > capacity or (part and n - at == capacity):
                    out.append((s, bins.fresh(), 0, i, part, at, capacity))
                    at, part = at + capacity, part + 1
                if n > at:
                    number, offset = bins.place(n - at)
                    out.append((s, number, offset, i, part, at, n - at))
            yield pd.DataFrame(out, columns=["shard", "bin", "offset", "id", "part", "start", "length"])

    return ordered.mapInPandas(run, f"shard bigint, bin bigint, offset bigint, id {id_type}, part int, start bigint, length bigint")
