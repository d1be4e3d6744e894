import duckdb
import pytest

from compare import rows_of
from tidemark.llm import queries
from tidemark.sources.tables import TABLES


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    got = df.collect()
    if name in queries.SQL:
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        cur = con.execute(queries.SQL[name])
        cols = [c[0] for c in cur.description]
        assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())
    else:
        assert got


def test_packed_whole_and_tight(spark, folder):
    """Every token of every document lies in one place, no sequence is overfull, only parts of longer documents are split, and little space is left."""
    from tidemark.llm import packing

    sizes = {r.id: r.tokens for r in packing.token_counts(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text").collect()}
    rows = queries.p7_packed(spark, folder).collect()
    bins: dict = {}
    parts: dict = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append((r.offset, r.offset + r.length))
        parts.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= packing.CAPACITY and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for d, n in sizes.items():
        got = sorted(parts.pop(d, []))
        assert (got[0][0], got[-1][1]) == (0, n) if n else not got
        assert all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False)) and (n > packing.CAPACITY or len(got) <= 1)
    assert not parts


def test_fill_over_many_shards(spark):
    """The share of unused space is below one percent in each of many shards, as it is in one."""
    from pyspark.sql import functions as F

    from tidemark.llm import packing

    items = spark.range(60_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(900)) + 1 + F.when(F.col("id") % 50 == 0, 1500).otherwise(0)).alias("tokens"))
    by = packing.pack(items, shard_bins=1000).groupBy("shard", "bin").agg(F.sum("length").alias("used")).groupBy("shard").agg(F.count("*").alias("bins"), F.sum("used").alias("used")).collect()
    assert len(by) > 5 and sum(r.used for r in by) == items.agg(F.sum("tokens")).first()[0]
    assert all(r.used / (r.bins * packing.CAPACITY) > 0.99 for r in by)


def test_leaks_against_all_alignments(spark, folder):
    """p8_found on the small tables is what trying every alignment of every item with every document gives; pairs with too few words in common are passed over."""
    import numpy as np

    from tidemark.llm.leakage import Scanner

    items = [(r.item_id, r.item_text) for r in spark.read.parquet(f"{folder}/eval_items.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect() if r.text]
    s, want = Scanner(items), set()
    for d, text in docs:
        doc = s.numbers(text)
        for k, item in enumerate(s.items):
            if np.isin(item, doc).sum() >= s._unaltered(s.least[k]) and s._band(s._agree(doc, item, -len(item), len(item) + len(doc) + 1), s.least[k]):
                want.add((d, s.ids[k]))
    assert {tuple(r) for r in queries.p8_found(spark, folder).collect()} == want and want


def test_stretches_are_in_order(spark, folder):
    """Stretches of a document follow each other inside its text and have two languages side by side."""
    sizes = {r.doc_id: len(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect() if r.text}
    rows = sorted(queries.p9_stretches(spark, folder).collect(), key=lambda r: (r.doc_id, r.stretch))
    assert all(0 <= r.first_char < r.end_char <= sizes[r.doc_id] and 0 < r.confidence <= 1 for r in rows)
    assert all(a.doc_id != b.doc_id or (a.end_char <= b.first_char and a.lang != b.lang and b.stretch == a.stretch + 1) for a, b in zip(rows, rows[1:], strict=False))
