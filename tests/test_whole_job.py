"""Queries that do what the queries with SQL leave out."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import base, composition, resolution


@pytest.fixture
def changed(spark, folder, tmp_path):
    """A function that makes a folder of the test tables in which some have further rows, given as changes of their first row."""

    def make(**more):
        for f in os.listdir(folder):
            if f.removesuffix(".parquet") not in more:
                os.symlink(f"{folder}/{f}", tmp_path / f)
        for t, rows in more.items():
            df = spark.read.parquet(f"{folder}/{t}.parquet")
            first = df.first().asDict()
            df.unionByName(spark.createDataFrame([first | r for r in rows], df.schema)).write.parquet(str(tmp_path / f"{t}.parquet"))
        return str(tmp_path)

    return make


def test_all_violations(spark, folder, changed):
    f = lambda i, b, axis, label, status="accepted": {"facet_row_id": i, "benchmark_id": b, "facet_axis": axis, "facet_label": label, "review_status": status, "classification_confidence": 0.9}
    full = [f(900_010 + i, "benchmark_b", a, x) for i, (a, x) in enumerate({"context_pressure": "short", "domain": "law", "interaction_pattern": "survey", "metric": "cost", "modality": "text"}.items())]
    d = changed(
        benchmarks=[{"benchmark_id": "benchmark_zorp_quell", "benchmark_name": "Zorp Quell", "legacy_task_mode": "odd", "legacy_task_domain": "odd"}, {"benchmark_id": "benchmark_zorp_quel", "benchmark_name": "Zorp Quel", "legacy_task_mode": "", "legacy_task_domain": None}],
        benchmark_aliases=[{"alias_id": 900_001, "alias": "never typed by anyone"}],
        benchmark_facets=[f(900_001, "benchmark_a", "headline_task_mode", "agent"), f(900_002, "benchmark_a", "headline_task_mode", "tool"), f(900_003, "benchmark_a", "domain", "alchemy"), f(900_004, "benchmark_a", "domain", "law", "odd"), *full],
    )
    got = {(r.rule, r.key) for r in resolution.all_violations(spark, d).collect()}
    pair = "benchmark_zorp_quel|benchmark_zorp_quell"
    want = {
        ("invalid_task_mode", "benchmark_zorp_quell"), ("invalid_task_domain", "benchmark_zorp_quell"), ("unused_alias", "900001"), ("unused_name", "Zorp Quell"), ("headline_repeated", "benchmark_a"),
        ("facet_label_invalid", "900003"), ("facet_status_invalid", "900004"), ("headline_not_derivable", "benchmark_b"), ("near_duplicate", pair),
    }
    assert want <= got
    assert {r for r in got if r[0] in ("invalid_task_mode", "invalid_task_domain", "facet_label_invalid", "facet_status_invalid", "headline_repeated")} <= want
    assert {(r.rule, r.key) for r in resolution.violations(spark, d).collect()} <= got
    rv = spark.createDataFrame([("benchmark_zorp_quell", "benchmark_zorp_quel", "two"), ("benchmark_zorp_quel", "x_gone", "n"), ("a", "a", "n")], "benchmark_id_a string, benchmark_id_b string, note string")
    got = {(r.rule, r.key) for r in resolution.all_violations(spark, d, rv).collect()}
    assert ("near_duplicate", pair) not in got and {("reviewed_pair_missing", "benchmark_zorp_quel|x_gone"), ("reviewed_pair_not_two", "a|a")} <= got


def _small(spark, monkeypatch, mentions, facets):
    """Puts mentions (model_row_id, day, benchmark_id) and facets (benchmark_id, axis, label, confidence) in place of the tables."""
    m = spark.createDataFrame([(str(i), r, "p", "m", dt.date.fromisoformat(x), i, b, b, int(x[:4])) for i, (r, x, b) in enumerate(mentions)], "mention_id string, model_row_id bigint, provider string, model_name string, release_date date, mention_index int, raw_mention string, benchmark_id string, release_year bigint")
    f = spark.createDataFrame([(i, *x, "accepted") for i, x in enumerate(facets)], "facet_row_id bigint, benchmark_id string, facet_axis string, facet_label string, confidence double, review_status string")
    monkeypatch.setattr(base, "cutoff", lambda *_: dt.date(2025, 12, 31))
    monkeypatch.setattr(base, "mentions", lambda *_: m)
    monkeypatch.setattr(base, "facets", lambda _spark, _d, active=True: f if active else f.unionByName(f.limit(1).withColumn("review_status", F.lit("deprecated"))))


def test_axis_trends(spark, monkeypatch):
    facets = [(x, "domain", f"d{x}", 0.9) for x in "abcde"] + [("a", "modality", "image", 0.9), ("b", "metric", "cost", 0.9)]
    _small(spark, monkeypatch, [(1, "2025-12-31", x) for x in "abcde"], facets)
    got = {(r.facet_axis, r.category): r.share for r in composition.axis_trends(spark, "").collect()}
    assert got == {("domain", f"d{x}"): 0.2 for x in "abcde"} | {("modality", "image"): 1.0, ("metric", "cost"): 1.0, ("headline_task_mode", "Multimodal / Perceptual Understanding"): 1.0}


def test_sensitivity_confident(spark, monkeypatch):
    axes = {"context_pressure": "short", "domain": "law", "metric": "rubric", "modality": "text"}
    facets = [(b, a, x, c) for b, c in (("sure", 0.9), ("mixed", 0.9)) for a, x in axes.items()] + [("sure", "interaction_pattern", "tool_use", 0.7), ("mixed", "interaction_pattern", "tool_use", 0.6), ("none", "interaction_pattern", "tool_use", None)]
    _small(spark, monkeypatch, [(1, "2025-01-01", "sure"), (1, "2025-01-01", "mixed"), (2, "2025-02-01", "none"), (3, "2024-02-01", "mixed")], facets)
    got = {(r.variant, r.release_year): (r.releases, r.mean_agentic_share) for r in composition.sensitivity_confident(spark, "").collect()}
    assert got == {("confident_lower_bound", 2025): (2, 0.25), ("confident_lower_bound", 2024): (1, 0.0), ("confident_complete_axes", 2025): (1, 1.0)}


def test_summaries(spark, monkeypatch):
    _small(spark, monkeypatch, [(1, "2025-12-30", "a"), (1, "2025-12-30", "b"), (1, "2025-12-30", "b"), (2, "2024-12-30", "a"), (3, "2024-12-29", "c")], [("a", "domain", "law", 0.9), ("b", "domain", "law", 0.9)])
    (r,) = composition.summary_stats(spark, "").collect()
    assert tuple(r) == (dt.date(2025, 12, 30), 3, 5, 3, 4, 2, 3, 0, 0, 2)
    assert {x.metric: x.value for x in composition.story_summary(spark, "").collect()} == {"as_of": "2025-12-31", "resolved_mentions": "4", "unique_benchmarks": "3", "benchmarked_releases": "3"}
