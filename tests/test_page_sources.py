"""Page documents, model responses and files beside what they hold."""

import json
import re
from difflib import SequenceMatcher
from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from tidemark.functions.keys import alias_pattern, exact_text
from tidemark.functions.periods import number, percent, period, period_sql
from tidemark.functions.url import normalize_url
from tidemark.operators import facets, pages, pagesources, responses
from tidemark.plans import resolution
from tidemark.sources import files


def test_reader_and_variants(spark):
    df = spark.createDataFrame([(1, "x\nTitle:  A  b \nURL Source: http://a.b/c\nbody"), (2, "plain"), (3, None), (4, " ")], "p int, t string")
    got = {r.page_id: (r.title, r.final_url) for r in pagesources.reader_documents(df, "p", "t").collect()}
    assert got == {1: ("A b", "http://a.b/c"), 2: ("", "")}
    v = spark.createDataFrame([(1, 1, 0.5, "a"), (1, 2, 0.9, "b"), (1, 3, 0.9, "c"), (2, 1, None, "d"), (None, 1, 1.0, "e")], "p int, n int, s double, x string")
    assert sorted(r.x for r in pagesources.best_variants(v, "p", "s", "n").collect()) == ["b", "d", "e"]


def test_image_candidates(spark):
    rows = [(1, 1, "image_text", "score chart https://a/x.png, https://a/logo.png"), (1, 2, "image_text", "table https://a/y.png https://a/x.png."), (1, 3, "table", "score https://a/z.png"), (1, 4, "image_text", "holiday https://a/q.png"), (2, 1, None, None)]
    df = spark.createDataFrame(rows, "p int, fragment int, k string, t string")
    assert [tuple(r) for r in pagesources.image_candidates(df, "p", "k", "t").collect()] == [(1, ["https://a/x.png", "https://a/y.png"])]


def test_merged_documents(spark):
    long = "y" * 250
    rows = [(1, 1, 1, "table", "t", "a"), (1, 2, 1, "table", "t", "a"), (1, 2, 2, "metadata", "m", long + "1"), (1, 1, 2, "metadata", "m", long + "2"), (2, 1, 1, "table", None, None)]
    df = spark.createDataFrame(rows, "p int, doc int, fragment int, source_kind string, label string, text string")
    got = [(r.p, r.doc, r.text) for r in pagesources.merged_documents(df, "p", "doc").orderBy("p", "place").collect()]
    assert got == [(1, 2, "a"), (1, 2, long + "1"), (1, 1, long + "2"), (2, 1, None)]
    assert pagesources.merged_documents(df, "p", "doc", 200).count() == 3


def test_model_context(spark):
    rows = [(1, 1, "script_text", "l", "no such word"), (1, 2, "table", "l", "benchmark " * 3), (1, 3, "metadata", "l", "x" * 9000), (1, 4, "image_ocr", "l", "plain"), (1, 5, "table", "l", ""), (1, 6, "script_json", "l", "eval"), (2, 1, "script_text", "l", None)]
    df = spark.createDataFrame(rows, "p int, fragment int, source_kind string, label string, text string")
    (r,) = pagesources.model_context(df, "p").collect()
    assert r.blocks == 4 and re.findall(r"\[F\d+ original:(\d)", r.context) == ["4", "2", "3", "6"] and len(r.context) < 5400
    (r,) = pagesources.model_context(df, "p", chars=160).collect()
    assert r.blocks == 2  # the first that does not fit ends it, though a later one would


def test_facet_labels(spark):
    entry = lambda label, c=0.9, e="seen": {"label": label, "classification_confidence": c, "evidence": e}
    good = {"facets": {"domain": [entry("law")], "metric": [entry("cost", 0.5)], "modality": []}}
    texts = {1: "```json\n" + json.dumps(good) + "\n```", 2: json.dumps({"facets": {"domain": [entry("alchemy")], "colour": [entry("red")], "metric": [entry("cost", e=" ")]}}), 3: "no json", 4: None, 5: json.dumps({"facets": {"domain": [entry("law", "high"), entry("law", 7)]}}), 6: json.dumps({"facets": {"domain": [entry("law", "0.8")], "metric": [entry("cost")]}})}
    df = spark.createDataFrame(list(texts.items()), "i int, t string")
    allowed = spark.createDataFrame([("domain", "law"), ("metric", "cost"), ("modality", "text")], "facet_axis string, facet_label string")
    labels, faults = responses.facet_labels(df, "i", "t", allowed, ("domain", "metric"))
    assert {tuple(r) for r in labels.select("row_id", "facet_label", "confidence", "review_status").collect()} == {(1, "law", 0.9, "needs_review"), (1, "cost", 0.5, "needs_review"), (6, "law", 0.8, "accepted"), (6, "cost", 0.9, "accepted")}
    assert {(r.row_id, r.fault) for r in faults.collect()} == {(2, "invalid_label"), (2, "unknown_axis"), (2, "missing_evidence"), (3, "no_object"), (4, "no_object"), (5, "bad_confidence"), (5, "missing_axis")}


def test_coalesced_and_made_ids(spark):
    df = spark.createDataFrame([("", "old", "x"), ("new", "old", None)], "a string, b string, c string")
    assert [(r.a, r.c) for r in responses.coalesced(df, {"a": ["b", "gone"]}).collect()] == [("old", "x"), ("new", None)]
    cat = spark.createDataFrame([("Foo Bar", "wrong"), (None, "x"), (" ", "y")], "name string, benchmark_id string")
    assert [tuple(r) for r in facets.with_made_ids(cat).select("benchmark_name", "benchmark_id").collect()] == [("Foo Bar", "benchmark_foo_bar")]
    with pytest.raises(ValueError, match="none of the columns"):
        facets.with_made_ids(cat.select("benchmark_id"))
    order = facets.ordered(spark.createDataFrame([("z",), ("b",), ("a",), ("q",)], "p string"), [("p", ["b", "a"])])
    assert [r.p for r in order.collect()] == ["b", "a", "q", "z"]


def test_urls_as_the_standard_library_writes_them(spark):
    urls = ["HTTPS://Ex.org/A/?b=1&a=%7e%2f&c=x+y&utm_source=q&d#f", "http://e.org?x=%E4%BD%A0&y=a*b~c", "http://e.org/?q=%zz", "http://e.org/p/", None, "", "http://e.org?a=b=c"]
    got = [r.u for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(normalize_url("u").alias("u")).collect()]
    for u, g in zip(urls, got, strict=True):
        if u and "%zz" not in u:
            parts = urlsplit(u.strip())
            query = urlencode([(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not re.match(r"utm_|gclid$|fbclid$", k)])
            assert g == f"{parts.scheme.lower()}://{parts.netloc.lower()}{parts.path.rstrip('/')}" + (f"?{query}" if query else ""), u
    assert got[4] == got[5] == "" and got[2].startswith("http://e.org?q=")


def test_files(spark, tmp_path):
    text = files.write_manifest(spark, f"{tmp_path}/m", ["b.csv", "a.csv"], rows=3)
    assert json.loads(text) == {"files": ["a.csv", "b.csv"], "rows": 3} and spark.read.text(f"{tmp_path}/m", wholetext=True).first()[0].strip() == text
    (tmp_path / "p.json").write_text(json.dumps({"hits": [{"name": "a|b", "n": "1"}, {"name": "c"}], "none": []}))
    packet = files.review_packet(spark, f"{tmp_path}/p.json", {"Hits": ("hits", ["name", "n"]), "Others": ("none", ["x"]), "Gone": ("gone", ["x"])}, rows=1)
    assert "| a\\|b | 1 |" in packet and "1 more." in packet and packet.count("None.") == 2


def test_periods_and_texts(spark):
    df = spark.createDataFrame([(2021, 0.0), (2023, 0.004), (2024, 0.5), (2027, None)], "y int, s double")
    got = df.select(period(F.col("y"), "hypothesis"), period(F.col("y"), "two_years"), percent(F.col("s")), number(F.col("y"))).collect()
    assert [r[0] for r in got] == ["pre-2024", "pre-2024", "2024", "2025-2026"] and [r[1] for r in got] == [None, "2023-2024", "2023-2024", "2025-2026"]
    assert [r[2] for r in got] == ["0.0%", "<1%", "50.0%", "—"] and got[0][3] == "2,021" and "when y < 2024" in period_sql("y", "hypothesis")


def test_near_duplicates_by_force(spark, folder):
    """All pairs of names, each compared with each."""
    names = [(r.benchmark_id, r.benchmark_name) for r in resolution.base.catalogue(spark, folder).collect()]
    plain, words = {i: re.sub("[^a-z0-9]+", "", n.lower()) for i, n in names}, {i: re.findall("[a-z0-9]+", n.lower()) for i, n in names}
    want = set()
    for x, (i, _) in enumerate(names):
        for j, _ in names[x + 1 :]:
            a, b = sorted((i, j))
            if plain[a] and plain[b]:
                short, long = sorted((words[a], words[b]), key=lambda w: len("".join(w)))
                inside = len("".join(short)) >= 7 and short != long and any(long[k : k + len(short)] == short for k in range(len(long)))
                if inside or SequenceMatcher(None, plain[a], plain[b]).ratio() > 0.92:
                    want.add((a, b))
    assert {(r.id_a, r.id_b) for r in resolution.near_duplicate_names(spark, folder).collect()} == want


def test_page_mentions_by_force(spark, folder):
    """Every alias looked for in every document; the best hit of each benchmark."""
    names = [(r.benchmark_name, r.benchmark_id) for r in resolution.base.catalogue(spark, folder).collect()]
    known = {i for _, i in names}
    al = [(r.alias, (r.benchmark_id or "").strip().lower()) for r in spark.read.parquet(f"{folder}/benchmark_aliases.parquet").collect()]
    listed = {(a, i) for a, i in [*names, *al] if a and a.strip() and i in known}
    patterns = [(exact_text(a), i, re.compile(alias_pattern(exact_text(a)))) for a, i in listed]
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        for a, i, p in patterns:
            if r.text and (m := p.search(r.text)):
                around = r.text[max(0, m.start() - pages.RADIUS) : m.end() + pages.RADIUS].strip()
                hit = ("..." * (m.start() > pages.RADIUS) + around + "..." * (m.end() + pages.RADIUS < len(r.text)), a, m.group())
                key = (r.doc_id, i)
                if key not in want or (-len(hit[0]), hit[1:], hit[0]) < (-len(want[key][0]), want[key][1:], want[key][0]):
                    want[key] = hit
    got = {(r.page_id, r.benchmark_id): (r.snippet, r.alias, r.raw_match) for r in resolution.page_mentions(spark, folder).collect()}
    assert got == want and got
