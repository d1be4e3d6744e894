"""Mentions in page text: fragments of HTML, alias scan, and precision and recall against gold lists."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import alias_pattern, exact_text, snippet
from tidemark.operators.shares import ratio
from tidemark.session import written

#: How far each kind of fragment is trusted.
SCORES = {"rendered_visible_text": 1.0, "static_visible_text": 0.95, "table": 0.95, "reader_markdown": 0.94, "image_ocr": 0.92, "metadata": 0.75, "image_text": 0.65, "script_json": 0.58, "script_text": 0.52}
OTHER_SCORE = 0.5
RADIUS = 170


class _Fragments(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str]] = []
        self.text: list[str] = []
        self.skip = self.table = 0
        self.cells: list[str] = []
        self.in_script = self.title = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (c := a.get("content", "").strip()):
            self.out.append(("metadata", a.get("name") or a.get("property") or "meta", c))
        elif tag == "img" and (t := (a.get("alt") or a.get("title") or "").strip()):
            self.out.append(("image_text", "alt", t))
        elif tag == "script":
            self.in_script = "script_json" if "json" in a.get("type", "") else "script_text"
        elif tag == "style":
            self.skip += 1
        elif tag == "title":
            self.title = ""
        elif tag == "table":
            self.table += 1
            self.cells = []

    def handle_endtag(self, tag):
        if tag == "script":
            self.in_script = None
        elif tag == "style":
            self.skip = max(0, self.skip - 1)
        elif tag == "title" and self.title is not None:
            if self.title.strip():
                self.out.append(("metadata", "title", " ".join(self.title.split())))
            self.title = None
        elif tag == "table" and self.table:
            self.table -= 1
            if cells := " | ".join(c for c in self.cells if c):
                self.out.append(("table", "table", cells))

    def handle_data(self, data):
        if self.in_script:
            if data.strip():
                self.out.append((self.in_script, "script", data.strip()))
        elif self.title is not None:
            self.title += data
        elif not self.skip:
            self.text.append(data)
            if self.table:
                self.cells.append(" ".join(data.split()))


def html_fragments(source: str | None) -> list[tuple[str, str, str]]:
    """(kind, label, text) of a page: its metadata, tables, image texts, scripts and visible text. Broken markup is read as far as it goes."""
    if not source or not source.strip():
        return []
    p = _Fragments()
    p.feed(source)
    p.close()
    visible = " ".join("".join(x if x.strip() else " " for x in p.text).split())
    return p.out + ([("static_visible_text", "body", html.unescape(visible))] if visible else [])


def page_fragments(pages: DataFrame, page_id: str, source: str, compared: int | None = None) -> DataFrame:
    """(page_id, fragment, source_kind, label, text) of pages with an HTML column; a fragment repeated on its page counts once. compared: characters by which
    fragments are told apart, if not by all."""
    kind = dict(pages.dtypes)[page_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, s in zip(b["p"], b["s"], strict=True):
                firsts: dict[tuple, tuple] = {}
                for k, lab, t in html_fragments(s):
                    firsts.setdefault((k, lab, t[:compared]), (k, lab, t))
                rows += [(i, n, *v) for n, v in enumerate(firsts.values(), 1)]
            yield pd.DataFrame(rows, columns=["page_id", "fragment", "source_kind", "label", "text"])

    return pages.select(F.col(page_id).alias("p"), F.col(source).alias("s")).mapInPandas(run, f"page_id {kind}, fragment int, source_kind string, label string, text string")


def scan_aliases(fragments: DataFrame, page_id: str, kind: str, text: str, aliases: DataFrame, limit: int = 50_000) -> DataFrame:
    """(page_id, benchmark_id, alias, raw_match, score, snippet): the best hit of each benchmark on each page.

    aliases: (alias, benchmark_id), up to `limit`, counted first, in one pattern that finds the longest alias first; more are scanned for in
    passes, each of which is written before the next one's list is sent. Every alias that occurs is found, also inside a longer one's page. Of several hits the one from the most trusted kind of
    fragment wins, then the longest snippet, then the alias and text that sort first.
    """
    listed = aliases.select("alias", "benchmark_id").where("trim(alias) <> '' and benchmark_id is not null").distinct()
    passes = max(1, -(-listed.count() // limit))
    out, pid = None, dict(fragments.dtypes)[page_id]
    schema = f"page_id {pid}, benchmark_id string, alias string, raw_match string, score double, snippet string"
    src = fragments.select(F.col(page_id).alias("p"), F.col(kind).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    for i in range(passes):
        part = [(r.alias, r.benchmark_id) for r in listed.where(F.pmod(F.xxhash64("alias"), F.lit(passes)) == i).collect()]
        shared = fragments.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            finder = AliasFinder(shared.value)
            for b in batches:
                rows = [(p, *hit) for p, k, t in zip(b["p"], b["k"], b["t"], strict=True) for hit in finder.hits(t, SCORES.get(k, OTHER_SCORE))]
                yield pd.DataFrame(rows, columns=["page_id", "benchmark_id", "alias", "raw_match", "score", "snippet"])

        one = src.mapInPandas(run, schema)
        if passes > 1:
            one = written(one, "hits")
            shared.destroy()
        out = one if out is None else out.unionByName(one)
    rank = F.struct(-F.col("score"), -F.length("snippet"), "alias", "raw_match", "snippet")
    best = out.groupBy("page_id", "benchmark_id").agg(F.min_by(F.struct("alias", "raw_match", "score", "snippet"), rank).alias("b"))
    return best.select("page_id", "benchmark_id", "b.alias", "b.raw_match", "b.score", "b.snippet")


class AliasFinder:
    """Finds aliases in texts. An alias is tried only where all of its words occur in the text, and only at the places of its first word."""

    def __init__(self, aliases: list[tuple[str, str]]):
        self.by_word: dict[str, list[tuple[re.Pattern, str, str, frozenset[str], str]]] = {}
        for alias, target in sorted(aliases, key=lambda x: (-len(x[0]), x[0])):
            alias = exact_text(alias)
            words = [w.lower() for w in re.findall("[A-Za-z0-9]+", alias)]
            first = words[0] if words and alias[0].isascii() and alias[0].isalnum() else ""
            self.by_word.setdefault(first, []).append((re.compile(alias_pattern(alias)), alias, target, frozenset(words), first))

    def hits(self, text: str, score: float) -> list[tuple[str, str, str, float, str]]:
        low = text.lower()
        words = {*re.findall("[a-z0-9]+", low)}
        found: dict[str, tuple] = {}
        for w in (words | {""}) & self.by_word.keys():
            for pattern, alias, target, needed, first in self.by_word[w]:
                if needed <= words and (m := self._first(pattern, text, low, first)):
                    hit = (alias, m.group(), snippet(text, *m.span(), RADIUS))
                    if target not in found or self._rank(hit) < self._rank(found[target]):
                        found[target] = hit
        return [(t, alias, raw, score, around) for t, (alias, raw, around) in found.items()]

    @staticmethod
    def _rank(hit: tuple[str, str, str]) -> tuple:
        """The longest snippet first, then the alias and text that sort first."""
        return -len(hit[2]), hit[0], hit[1], hit[2]

    @staticmethod
    def _first(pattern: re.Pattern, text: str, low: str, first: str) -> re.Match | None:
        if not first or len(low) != len(text):
            return pattern.search(text)
        at = low.find(first)
        while at >= 0:
            if m := pattern.match(text, at):
                return m
            at = low.find(first, at + 1)
        return None


def accuracy(gold: DataFrame, predicted: DataFrame, page: str, item: str) -> DataFrame:
    """(page, gold, predicted, true_positive, recall, precision) per page of either side. With no gold item the recall is 1, and the precision 1 if nothing was
    predicted; with gold but nothing predicted it is 0."""
    g = gold.select(F.col(page).alias("page"), F.col(item).alias("item"), F.lit(1).alias("g")).distinct()
    p = predicted.select(F.col(page).alias("page"), F.col(item).alias("item"), F.lit(1).alias("p")).distinct()
    both = g.join(p, ["page", "item"], "full").groupBy("page").agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("true_positive"))
    empty = F.when(F.col("gold") == 0, 1.0).otherwise(0.0)
    return both.withColumn("recall", F.coalesce(ratio(F.col("true_positive"), F.col("gold")), F.lit(1.0))).withColumn("precision", F.coalesce(ratio(F.col("true_positive"), F.col("predicted")), empty))
