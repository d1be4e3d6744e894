import datetime as dt
import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.functions.url import launch_id, normalize_url
from tidemark.operators import launches, pages, responses, trends
from tidemark.operators.facets import headline_projection, merge_reviewed, with_headline
from tidemark.operators.nearnames import near_duplicates
from tidemark.operators.resolve import build_resolved_mentions, check_catalogue
from tidemark.sources import files
from tidemark.streaming import events

D = lambda s: dt.date.fromisoformat(s)


def test_urls(spark):
    rows = [
        ("HTTPS://WWW.A.example/Launch/?utm_source=one#table", "https://www.a.example/Launch"), ("https://a.example/launch?UTM_campaign=two#x", "https://a.example/launch"), ("https://a.example/l?edition=old&gclid=1", "https://a.example/l?edition=old"),
        ("https://a.example/l?b=&a=1&", "https://a.example/l?b=&a=1"), ("https://a.example", "https://a.example"), (None, ""), ("  ", ""),
    ]
    df = spark.createDataFrame(rows, "u string, want string")
    assert all(r.got == r.want for r in df.select(normalize_url("u").alias("got"), "want").collect())
    one = spark.range(1).select(launch_id(F.lit("Alpha"), F.lit(D("2024-01-02")), F.lit("https://a.example")).alias("i")).first().i
    import hashlib

    assert one == "launch_" + hashlib.sha256(b'["Alpha","2024-01-02","https://a.example"]').hexdigest()[:20]


def test_keys(spark):
    df = spark.createDataFrame([("τ³-Ｂank\xa0 x ",), ("Straße",), (None,), ("漢字",)], "n string")
    got = df.select(keys.exact_key("n").alias("e"), keys.identity_key("n").alias("i"), keys.benchmark_id(F.col("n")).alias("b")).collect()
    assert [r.e for r in got] == ["τ3-Bank x", "Straße", "", "漢字"]
    assert [r.i for r in got][1] == "strasse"
    assert got[0].b == "benchmark_3_bank_x" and got[3].b.startswith("benchmark_") and len(got[3].b) == 20


CAT = [("Alpha", "a"), ("Beta", "b")]


@pytest.fixture(scope="module")
def resolver(spark):
    return spark.createDataFrame(CAT, "name_key string, benchmark_id string"), spark.createDataFrame([("Alias Alpha", "a", "abbr"), ("Gone", "zz", "abbr")], "alias_key string, target string, match_type string")


def _releases(spark, lists):
    return spark.createDataFrame([(i, "P", "M", D("2024-01-01"), b) for i, b in enumerate(lists)], "model_row_id bigint, provider string, model_name string, release_date date, benchmarks string")


def test_resolution(spark, resolver):
    rel = _releases(spark, ["Alpha, Alias  Alpha,, Alpha, Beta", "Beta, Nope", None, "Gone"])
    good, bad = build_resolved_mentions(rel, *resolver, policy="collect")
    assert [(r.model_row_id, r.position, r.benchmark_id, r.match_source) for r in good.orderBy("model_row_id", "position").collect()] == [(0, 1, "a", "canonical"), (0, 2, "a", "alias"), (0, 3, "a", "canonical"), (0, 4, "b", "canonical"), (1, 1, "b", "canonical")]
    assert {r.raw_mention for r in bad.collect()} == {"Nope", "Gone"}
    dedup = build_resolved_mentions(rel, *resolver, deduplicate=True, policy="drop_release")[0].orderBy("position").collect()
    assert [(r.benchmark_id, r.raw_mention, r.multiplicity, r.release_weight, r.raw_weight) for r in dedup] == [("a", "Alpha; Alias Alpha; Alpha", 3, 0.5, 0.75), ("b", "Beta", 1, 0.5, 0.25)]
    with pytest.raises(ValueError, match="Gone, Nope"):
        build_resolved_mentions(rel, *resolver)
    with pytest.raises(ValueError, match="policy"):
        build_resolved_mentions(rel, *resolver, policy="x")


@pytest.mark.parametrize(("names", "aliases", "what"), [([("a", "A", "A"), ("a", "B", "B")], [], "two names"), ([("a", "A", "A"), ("b", "A", "A")], [], "two ids"), ([("a", "A", "A")], [("x", "a"), ("x", "b")], "two targets"), ([("a", "A", "A")], [("A", "b")], "hides")])
def test_catalogue_faults(spark, names, aliases, what):
    n = spark.createDataFrame(names, "benchmark_id string, name_key string, benchmark_name string")
    a = spark.createDataFrame(aliases, "alias_key string, target string")
    with pytest.raises(ValueError, match=what):
        check_catalogue(n, a)


def _life(spark, history, cutoff="2024-01-31", window=180):
    """history: (provider, day, benchmarks); one page each."""
    rel = spark.createDataFrame([(i, p, f"m{i}", f"https://x.example/{i}", D(d)) for i, (p, d, _) in enumerate(history)], "model_row_id bigint, provider string, model_name string, link string, release_date date")
    men = spark.createDataFrame([(i, b) for i, (_, _, bs) in enumerate(history) for b in bs], "model_row_id bigint, benchmark_id string")
    cat = spark.createDataFrame([("a", "Alpha", "accepted"), ("z", "Zeta", "accepted")], "benchmark_id string, benchmark_name string, review_status string")
    ev, lm = launches.launch_events(rel, men), launches.launch_mentions(rel, men)
    pl = launches.provider_lifecycles(ev, lm, D(cutoff))
    return {r.benchmark_id: r for r in launches.lifecycles(cat, pl, ev, lm, D(cutoff), window).collect()}, {(r.benchmark_id, r.provider): r for r in pl.collect()}


def test_lifecycle_scenarios(spark):
    life, prov = _life(spark, [("A", "2024-01-01", "a"), ("A", "2024-01-02", ""), ("A", "2024-01-03", "a"), ("A", "2024-01-04", "")])
    p = prov["a", "A"]
    assert (p.followup_launches, p.followup_mention_launches, p.followup_mention_share, p.launches_after_last_seen, p.largest_gap_launches) == (3, 1, round(1 / 3, 6), 1, 1)
    assert life["z"].reporting_pattern == "unobserved" and life["z"].launch_count == 0 and life["z"].adopter_followup_launches is None
    life, _ = _life(spark, [(p, "2024-01-01", "a") for p in "ABC"])
    assert (life["a"].first_providers, life["a"].second_provider_lag_days, life["a"].third_provider_lag_days) == ("A; B; C", 0, 0)
    life, _ = _life(spark, [("A", "2024-01-01", "a"), ("A", "2024-01-02", "a"), ("B", "2024-01-06", "a"), ("C", "2024-01-10", "a")])
    assert (life["a"].second_provider_lag_days, life["a"].third_provider_lag_days, life["a"].launch_count, life["a"].reporting_pattern) == (5, 9, 4, "shared_across_providers")
    life, prov = _life(spark, [("A", "2024-01-10", "a")])
    assert (life["a"].observed_span_days, life["a"].days_since_last_seen, life["a"].adopter_followup_launches, life["a"].followup_mention_share, life["a"].reporting_pattern) == (0, 21, 0, None, "single_launch")
    history = [("A", "2024-01-01", "a"), ("B", "2024-01-01", "a")] + [("A", f"2024-01-{i:02}", "") for i in range(2, 12)] + [("B", "2024-01-05", "")]
    life, prov = _life(spark, history)
    assert (prov["a", "A"].followup_launches, prov["a", "B"].followup_launches, life["a"].adopter_followup_launches, life["a"].followup_mention_share, life["a"].adopter_launches_after_last_seen) == (10, 1, 11, 0.0, 11)
    life, _ = _life(spark, [("A", "2024-01-01", "a"), ("A", "2024-01-02", "a"), ("A", "2024-01-04", "a")], "2024-01-04", 3)
    assert life["a"].recent_launch_count == 2


def test_trends(spark):
    ev = spark.createDataFrame([(D("2024-01-01"), "x", 1.0), (D("2024-01-02"), "y", 3.0), (D("2024-01-07"), "y", 1.0), (None, "x", 1.0), (D("2024-01-03"), None, 1.0)], "d date, c string, w double")
    got = {(r.day.day, r.category): r.share for r in trends.rolling_share(ev, "d", "c", "w", D("2024-01-08"), 3).collect()}
    assert [got[i, "x"] for i in range(1, 9)] == [1.0, 0.25, 0.25, 0.0, None, None, 0.0, 0.0]
    assert trends.rolling_share(ev.limit(0), "d", "c", "w", D("2024-01-08"), 3).count() == 0
    m = spark.createDataFrame([(D("2024-01-01"), 4), (D("2024-01-01"), 0), (D("2024-01-06"), 6)], "d date, n int")
    assert [r.average for r in trends.moving_ratio(m, "d", "n", D("2024-01-07"), 2).orderBy("day").collect()] == [2.0, 2.0, 2.0, 2.0, 2.0, 6.0, 6.0]
    rows = spark.createDataFrame([("P", D(f"2024-01-{i:02}"), f"n{i}") for i in (1, 5, 11, 12)], "g string, d date, n string")
    assert [r.lane for r in trends.lanes(rows, "g", "d", "n", 10).orderBy("d").collect()] == [0, 1, 0, 2]


def test_headline_and_merge(spark):
    f = spark.createDataFrame(
        [("a", "provider_construct_claim", "coding", 0.9, "accepted"), ("a", "modality", "text", 0.8, "accepted"), ("b", "modality", "image", None, "accepted"), ("c", "context_pressure", "long_context_primary", 0.6, "accepted"), ("c", "modality", "image", 0.9, "accepted"), ("d", "modality", "code", 0.9, "accepted"),
         ("e", "headline_task_mode", "Mine", 0.9, "accepted"), ("e", "modality", "image", 0.9, "accepted")],
        "benchmark_id string, facet_axis string, facet_label string, confidence double, review_status string",
    )
    got = {r.benchmark_id: (r.projection, r.confidence) for r in headline_projection(f).collect()}
    assert got == {"a": ("Generative or Deliberative Reasoning", 0.8), "b": ("Multimodal / Perceptual Understanding", 0.7), "c": ("Long Context Projection", 0.6), "e": ("Multimodal / Perceptual Understanding", 0.9)}
    assert with_headline(f).where("facet_axis = 'headline_task_mode'").count() == 4
    bm = spark.createDataFrame([("a", "Alpha"), ("b", "Beta  Two")], "benchmark_id string, benchmark_name string")
    rv = spark.createDataFrame([("", "beta two", "modality", "audio", 0.9, "accepted")], "benchmark_id string, benchmark_name string, facet_axis string, facet_label string, confidence double, review_status string")
    assert {(r.benchmark_id, r.facet_label) for r in merge_reviewed(f, rv, bm).collect()} == {("a", "coding"), ("a", "text"), ("b", "audio")}
    with pytest.raises(ValueError, match="nobody"):
        merge_reviewed(f, rv.withColumn("benchmark_name", F.lit("nobody")), bm)


def test_near_duplicates(spark):
    rng = random.Random(2)
    names = ["Alpha Bench", "Alpha-Bench", "Firefox", "Firefox Extended Suite", "ARC", "ARC Extended", "Gamma Reasoning 2024", "Gamma Reasoning 2025"] + ["".join(rng.choices("abc ", k=rng.randrange(6, 16))) for _ in range(60)]
    names += ["".join(c for c in n if rng.random() > 0.05) for n in names[8:40]]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(900, None), (901, "?")], "id bigint, name string")
    plain = lambda n: "".join(c for c in n.lower() if c.isalnum())
    split = lambda n: "".join(c if c.isalnum() else " " for c in n.lower()).split()

    def contained(x, y):
        s, g = (split(x), split(y)) if len(plain(x)) <= len(plain(y)) else (split(y), split(x))
        return len("".join(s)) >= 7 and s != g and any(g[i : i + len(s)] == s for i in range(len(g) - len(s) + 1))

    want = {(a, b) for a, b in combinations(range(len(names)), 2) if plain(names[a]) and plain(names[b]) and (SequenceMatcher(None, plain(names[a]), plain(names[b])).ratio() > 0.92 or contained(names[a], names[b]))}
    got = [(r.id_a, r.id_b) for r in near_duplicates(df).collect()]
    assert set(got) == want and len(got) == len(want)


def test_pages(spark):
    html = '<html><head><title>The  Page</title><meta name="description" content="About Alpha"><style>x{}</style><script type="application/ld+json">{"a": "Beta"}</script></head><body><p>We ran Alpha &amp; more</p><table><tr><td>Gamma-1</td><td>5</td></tr></table><img alt="chart of Beta"></body>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>unclosed <b>x")], "p bigint, h string")
    frag = pages.page_fragments(df, "p", "h").collect()
    assert {(r.page_id, r.source_kind) for r in frag} == {(1, k) for k in ("metadata", "script_json", "table", "image_text", "static_visible_text")} | {(3, "static_visible_text")}
    al = spark.createDataFrame([("Alpha", "a"), ("ARC", "arc"), ("Gamma 1", "g"), ("Gamma-1", "g"), (None, "n"), ("", "e")], "alias string, benchmark_id string")
    txt = spark.createDataFrame([(1, "metadata", "alpha and Gamma - 1"), (1, "table", "ALPHA here"), (2, "table", "the arc of ALPHABET"), (3, None, "ARC"), (4, "table", None)], "p bigint, k string, t string")
    for limit in (100, 2):
        got = {(r.page_id, r.benchmark_id, r.raw_match, r.score) for r in pages.scan_aliases(txt, "p", "k", "t", al, limit).collect()}
        assert got == {(1, "a", "ALPHA", 0.95), (1, "g", "Gamma - 1", 0.75), (3, "arc", "ARC", 0.5)}
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (5, "a")], "p bigint, i string")
    pred = spark.createDataFrame([(1, "a"), (1, "c"), (1, "d"), (3, "x"), (2, "a")], "p bigint, i string")
    acc = {r.page: (r.recall, r.precision) for r in pages.accuracy(gold, pred, "p", "i").collect()}
    assert acc == {1: (0.5, round(1 / 3, 6)), 2: (1.0, 1.0), 3: (1.0, 0.0), 5: (0.0, 0.0)}


def test_responses(spark, resolver):
    text = 'Sure:\n```json\n{"benchmarks": [{"raw_name": "Alpha", "canonical_name": "Alpha", "relationship": "Exact!", "confidence": 90}, "Beta", {"raw_name": "Alias Alpha", "canonical_name": "Alpha", "relationship": "abbreviation"}, {"raw_name": "Al", "canonical_name": "Alpha", "relationship": "semantic equivalent", "confidence": "x"}, {"raw_name": "Q", "canonical_name": "Q"}, {"raw_name": "Alpha", "canonical_name": "Alpha", "confidence": 0.2}], "unknown_mentions": ["New"]}\n```'
    df = spark.createDataFrame([(1, text), (2, "no json"), (3, None), (4, "{broken")], "p bigint, t string")
    items = responses.extracted_items(df, "p", "t")
    got = [(r.raw_name, r.confidence, r.benchmark_id, r.reason) for r in responses.review_reasons(items, *resolver).orderBy("item").collect()]
    assert got == [("Alpha", 0.9, "a", ""), ("Beta", 0.75, "b", ""), ("Alias Alpha", 0.75, "a", ""), ("Al", 0.75, "a", "semantic_mapping_requires_review"), ("Q", 0.75, None, "canonical_not_in_catalog"), ("Alpha", 0.2, "a", "low_confidence_mapping"), ("New", 0.75, None, "new_or_unmapped_benchmark")]


def test_files(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('﻿Provider,Model name,benchmarks\nA,"x ""y""","a, b\nc"\nNA,,None\n', encoding="utf-8")
    rows = files.read_csv(spark, str(p), ["Provider", "Model name", "benchmarks"], optional=["notes"]).collect()
    assert [tuple(r) for r in rows] == [("A", 'x "y"', "a, b\nc", ""), ("", "", "", "")]
    assert files.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).columns == ["a"]
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none.csv"), ["a"], required=True)
    with pytest.raises(ValueError, match="lacks"):
        files.read_csv(spark, str(p), ["zz"])
    df = spark.createDataFrame([(2, "b|"), (1, None)], "k int, v string")
    files.write_csv(df, str(tmp_path / "out"), ["v", "k"], ["k"])
    assert files.markdown_table(df, ["k", "v"], ["k"]).splitlines()[2:] == ["| 1 | — |", "| 2 | b\\| |"]
    log = str(tmp_path / "cand")
    assert files.append_candidates(df, log, ["k"]) == 2 and files.append_candidates(df.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), log, ["k"]) == 1
    with pytest.raises(ValueError, match="reviewed"):
        files.append_candidates(df, str(tmp_path / "models.csv"), ["k"])
    assert files.summary_json(df.limit(1)) and files.fill_template("{{A}}-{{B}}", {"A": 1, "B": None}) == "1-—"
    with pytest.raises(KeyError):
        files.fill_template("{{C}}", {})
    with pytest.raises(ValueError, match="finite"):
        files.summary_json(spark.sql("select double('nan') as x"))


def test_stream(spark, tmp_path):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = [(1, t(0), 1, "view", 1.0, None), (2, t(0, 50), 1, "view", 2.0, None), (3, t(9), 2, "click", 3.0, None), (4, None, 2, "view", 1.0, None)]
    df = spark.createDataFrame(rows, events.SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = events.windowed(events.read_stream(spark, str(tmp_path / "in")), "1 hour").writeStream.outputMode("complete").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("win").collect()}
    assert got == {tuple(r) for r in events.windowed(df, "1 hour").collect()} and len(got) == 2
    assert events.sessions(df, "1 hour").count() == 2
