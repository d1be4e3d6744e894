"""Values typed by hand, mapped to the entry of a reference list that is meant.

Names are compared as words: compatibility forms, look-alike letters, accents, digits in place of letters, case and punctuation
are undone; numbers, Roman numerals and version marks become plain numbers, which must agree. Of a typed value several
readings are tried, from the whole to what is left without remarks in brackets, settings, score words and providers.

A reading is looked up in a symmetric-delete dictionary of the entries: the strings that arise from the start of a
name by deleting up to two letters are the dictionary's keys, so names within two edits share a key, whatever the edit.
What is found is ranked by a weighted Damerau-Levenshtein distance, which must stay within a bound that grows with
the length, then by how much was left out of the reading, then by how often the entry is referred to. Words in
another order are tried where the written order finds nothing. What no reading finds is reported as unmatched.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Collection, Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import written

UNMATCHED = "unmatched"
#: Entries that the tasks hold at once, counted first; longer lists are taken in several passes.
MAX_ENTRIES = 50_000
#: Providers that the tasks may hold; where there are more, each value is joined with the providers that its words could name.
MAX_PROVIDERS = 10_000
#: Letters of a name from which deletions are made.
PREFIX = 9

#: Letters that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    "авекмнорстухіјѕԁһӏԛԝ" + "АВЕКМНОРСТУХІЈЅ" + "αβεικνορτυχ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "abekmhopctyxijsdhlqw" + "abekmhopctyxijs" + "abeiknoptyx" + "abezhikmnoptyx",
)
#: Roman numerals up to twelve, without single letters that are also initials, apart from I and V.
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "xi": "11", "xii": "12"}
#: Words that only join.
JOINERS = frozenset({"and", "or", "und", "et", "y", "e"})
#: Words before or after a name that say nothing about which it is.
FILLERS = frozenset(
    "a acc accuracy additional an avg average based bench benchmark benchmarks by cf dataset em eval evals evaluation f1 final for from full in leaderboard mean new of "
    "on our overall performance public ranking rate reported result results run runs score scored scores see setting setup subset suite task tasks test tests the "
    "updated using via with without".split()
)
#: Settings and score remarks.
REMARK = re.compile(
    r"\b(?:(?:\d+|zero|one|few|multi)[- ]?shots?|(?:pass|maj|cons|best|acc|prec|recall|hit|top)\s*@\s*\d+|(?:avg|average|mean|best|median)\.?(?:\s*(?:of|over|@))?\s*\d+(?:\s*(?:runs?|seeds?|trials?|samples?))?"
    r"|\d+\s*(?:runs?|seeds?|trials?|samples?|attempts?)|[nk]\s*=\s*\d+|t(?:emp(?:erature)?)?\s*=\s*[\d.]+|(?:w/|w/o|with|without|no)\s*(?:tools?|cot|thinking|search|code|internet|python)"
    r"|cot|chain of thought|greedy|[\d.]+\s?%|internal (?:run|setting)s?)(?!\w)",
    re.I,
)
_BRACKETS = re.compile(r"\(([^()]*)\)|\[([^\[\]]*)\]|\{([^{}]*)\}")
_VERSION = re.compile(r"\b(?:v|ver|version|part|vol|volume|no|release)\b[\s.]*(?=\d|[ivx]+\b)")
_TOKEN = re.compile(r"[a-z]+|\d+")


def simplify(text: str) -> str:
    """text in plain lower-case Latin letters; punctuation stays."""
    text = unicodedata.normalize("NFKC", text).translate(LOOK_ALIKES)
    text = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in text if not unicodedata.combining(c) and c not in "​‌‍﻿­").replace("&", " and ")


def tokens(text: str) -> tuple[str, ...]:
    """The words of a simplified text. Digits inside words stand for the letters they look like; version marks are dropped before
    their numbers; joining words are left out."""
    text = re.sub(r"\b((?:[a-z]\.){2,}[a-z]?)", lambda m: m.group().replace(".", ""), text)
    text = re.sub(r"(?<=\d)(?:\.0)+(?![\d.])", "", text)
    text = _VERSION.sub(" ", re.sub(r"[_/]", " ", text))
    out = []
    for word in re.findall(r"[^\W_]+", text):
        if word.isdigit():
            out.append(str(int(word)))
        elif m := re.fullmatch(r"v(\d+)", word):
            out.append(str(int(m[1])))
        elif word in ROMAN:
            out.append(ROMAN[word])
        elif word.isalpha():
            if word not in JOINERS:
                out.append(word)
        else:
            if (m := re.fullmatch(r"([a-z]{2,})(\d{1,4})", word)) and not set(m[2]) <= set("01"):
                out += [m[1], str(int(m[2]))]
            else:
                out.append(word.translate(str.maketrans("0134578", "oleastb")) if not word.translate(str.maketrans("", "", "0134578")).isdigit() else word)
    return tuple(out)


def _parts(words: Sequence[str]) -> tuple[str, tuple[str, ...]]:
    """The letters of a name without spaces, and its numbers in order."""
    return "".join(w for w in words if not w.isdigit()), tuple(w for w in words if w.isdigit())


def _trimmed(words: tuple[str, ...], drop: frozenset[str] = FILLERS) -> list[tuple[str, ...]]:
    """words, and what is left when fillers are taken off their ends one after the other."""
    a = next((i for i, w in enumerate(words) if w not in drop), len(words))
    b = next((i for i, w in enumerate(reversed(words)) if w not in drop), len(words))
    return [words[i : len(words) - j] for i in range(a + 1) for j in range(b + 1) if i + j < len(words)]


class Asked(set):
    """Holds nothing, and keeps what it was asked for."""

    def __contains__(self, x: object) -> bool:
        self.add(x)
        return False


def readings(raw: str, providers: Collection[tuple[str, ...]], lengths: Collection[int] | None = None, fillers: frozenset[str] = FILLERS, remark: re.Pattern = REMARK) -> list[tuple[tuple[str, ...], int]]:
    """(words, how much was left out) of the ways to read a typed value, the fullest first. lengths: the numbers of words that providers have; fillers and remark: words and
    settings that say nothing about which entry is meant."""
    lengths = {len(p) for p in providers} if lengths is None else lengths
    text = simplify(raw)
    out: dict[tuple[str, ...], int] = {}

    def add(words: tuple[str, ...], left: int) -> None:
        for w in _trimmed(words, fillers):
            cost = left + (w != words)
            out[w] = min(out.get(w, 99), cost)
            for n in lengths:
                if len(w) > n:
                    rest = [w[n:]] * (w[:n] in providers) + [w[:-n]] * (w[-n:] in providers)
                    for x in {y for r in rest for y in _trimmed(r, fillers)}:
                        out[x] = min(out.get(x, 99), cost + 1)

    bare = remark.sub(" ", text)
    add(tokens(text), 0)
    add(tokens(bare), 1)
    inside = [next(x for x in m if x is not None) for m in _BRACKETS.findall(text) if any(m)] if _BRACKETS.search(text) else []
    if _BRACKETS.search(text):
        outside = _BRACKETS.sub(" ", text)
        add(tokens(outside), 2)
        add(tokens(remark.sub(" ", outside)), 2)
        # brackets with a remark beside brackets that belong to the name
        for m in _BRACKETS.finditer(text):
            one = text[: m.start()] + " " + text[m.end() :]
            add(tokens(one), 2)
            add(tokens(remark.sub(" ", one)), 2)
    for cut in (r"\s[-–—]+\s", r":", r",", r";", r"\s/\s"):
        pieces = re.split(cut, text)
        if len(pieces) > 1:
            add(tokens(remark.sub(" ", pieces[0])), 3)
            if cut == ":":
                add(tokens(remark.sub(" ", pieces[-1])), 3)
    for x in inside:
        add(tokens(remark.sub(" ", x)), 4)
    return sorted(out.items(), key=lambda x: (x[1], -len(x[0]), x[0]))


def distance(a: str, b: str, bound: float) -> float:
    """Weighted Damerau-Levenshtein distance (optimal string alignment): an exchange of neighbours 0.9; a letter doubled or not 0.7; a vowel for
    another 0.9; any other edit 1. Beyond the bound, some value beyond it."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > bound / 0.7:
        return bound + 1
    vowels = "aeiouy"

    def lone(s: str, i: int) -> float:
        return 0.7 if (i and s[i] == s[i - 1]) or (i + 1 < len(s) and s[i] == s[i + 1]) else 1.0

    before, last = None, [0.0]
    for j in range(len(b)):
        last.append(last[-1] + lone(b, j))
    for i in range(len(a)):
        row = [last[0] + lone(a, i)]
        for j in range(len(b)):
            swap = 0.0 if a[i] == b[j] else 0.9 if a[i] in vowels and b[j] in vowels else 1.0
            best = min(last[j] + swap, last[j + 1] + lone(a, i), row[j] + lone(b, j))
            if before is not None and j and a[i] == b[j - 1] and a[i - 1] == b[j] and a[i] != a[i - 1]:
                best = min(best, before[j - 1] + 0.9)
            row.append(best)
        if min(row) > bound and (before is None or min(last) > bound):
            return bound + 1
        before, last = last, row
    return last[-1]


def bound(length: int, words: int) -> float:
    """Edits that a name of so many letters and words may bear."""
    if length < 5:
        return 0.0
    return 1.0 if length < 12 or words < 2 and length < 16 else 2.0


def deletions(s: str, most: int = 2) -> set[str]:
    """The strings that arise from the start of s by deleting up to `most` letters."""
    level, out = {s[:PREFIX]}, {s[:PREFIX]}
    for _ in range(most):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        out |= level
    return out


def _letters(s: str) -> np.ndarray:
    """How often each letter stands in s; rare letters share a place."""
    return np.bincount([ord(c) % 61 for c in s], minlength=61) if s else np.zeros(61, int)


def _best_order(bag: list[str], name: str, limit: float) -> float | None:
    """The least distance within the limit from name to the words of a sorted bag written in some order, or None."""
    best: float | None = None

    def go(rest: list[str], done: str, row: list[float]) -> None:
        nonlocal best
        if not rest:
            cost = distance(done, name, limit)
            if cost <= limit and (best is None or cost < best):
                best = cost
            return
        for i, w in enumerate(rest):
            if i and rest[i - 1] == w:
                continue
            now = row
            for c in w:  # a letter put in or missing counts 0.45, so two of them at most as much as any other edit
                new = [now[0] + 0.45]
                for j, x in enumerate(name):
                    new.append(min(now[j] if c == x else 9e9, now[j + 1] + 0.45, new[j] + 0.45))
                now = new
            if min(now) <= limit and best != 0:
                go(rest[:i] + rest[i + 1 :], done + w, now)

    go(bag, "", [0.45 * j for j in range(len(name) + 1)])
    return best


class Matcher:
    """Looks typed values up in entries (name, target, frequency). A target of None names nothing."""

    def __init__(self, entries: Sequence[tuple[str, str | None, int]], providers: Sequence[str] = (), fillers: frozenset[str] = FILLERS, remark: re.Pattern = REMARK):
        self.silent = fillers, remark
        best: dict[tuple[str, tuple[str, ...]], dict] = {}
        self.words: dict[tuple, int] = {}
        for name, target, n in sorted(entries, key=lambda e: (e[1] is None, -e[2], e[1] or "", e[0])):
            w = tokens(simplify(name))
            if w:
                best.setdefault(_parts(w), {})[target] = n
                self.words[_parts(w)] = max(self.words.get(_parts(w), 0), len(w))
        self.names = best
        self.index: dict[str, list[tuple]] = defaultdict(list)
        for key in best:
            if len(key[0]) >= 5:
                for d in deletions(key[0]):
                    self.index[d].append(key)
        self.providers = frozenset(tokens(simplify(p)) for p in providers if p) - {()}
        self.lengths = {len(p) for p in self.providers}
        self.bags: dict | None = None
        self.memo: dict = {}

    def _nearest(self, words: tuple[str, ...]) -> tuple[float, int, str | None] | None:
        """(distance, -frequency, target) of the best entry for these words in this order."""
        letters, numbers = key = _parts(words)
        if key in self.names:
            targets = self.names[key]
            t = next(iter(targets))
            return 0.0, -targets[t], t
        if len(letters) < 4:
            return None
        seen, found = set(), None
        for d in deletions(letters):
            for k in self.index.get(d, ()):
                if k in seen or k[1] != numbers:
                    continue
                seen.add(k)
                limit = bound(len(k[0]), self.words[k])
                cost = distance(letters, k[0], limit)
                if cost <= limit:
                    t = next(iter(self.names[k]))
                    if found is None or (cost, -self.names[k][t], t or "") < (found[0], found[1], found[2] or ""):
                        found = (cost, -self.names[k][t], t)
        return found

    def _reordered(self, words: tuple[str, ...]) -> tuple[float, int, str | None] | None:
        """_nearest of the best order of the words, without trying all: entries with the same numbers and nearly the same letters are kept, and an order is given up
        as soon as its start fits no start of the entry."""
        bag, numbers = sorted(w for w in words if not w.isdigit()), tuple(sorted(w for w in words if w.isdigit()))
        if self.bags is None:
            self.bags = {}
            for k in self.names:
                self.bags.setdefault(tuple(sorted(k[1])), []).append(k)
            self.bags = {n: (ks, np.array([_letters(k[0]) for k in ks], np.int16)) for n, ks in self.bags.items()}
        found = None
        if numbers in self.bags:
            keys, counts = self.bags[numbers]
            # an edit changes two letters at the most; weights are 0.7 at the least
            for i in np.nonzero(np.abs(counts - _letters("".join(bag))).sum(1) <= 4)[0]:
                k = keys[i]
                cost = _best_order(bag, k[0], bound(len(k[0]), self.words[k]))
                if cost is not None:
                    t = next(iter(self.names[k]))
                    if found is None or (cost, -self.names[k][t], t or "") < (found[0], found[1], found[2] or ""):
                        found = (cost, -self.names[k][t], t)
        return found

    def find(self, raw: str | None, own_provider: str | None = None) -> tuple[str, float] | None:
        """(target, distance) of the entry that is meant, or None."""
        hit = self.rank(raw, own_provider)
        return None if hit is None or hit[5] is None else (hit[5], hit[1])

    def rank(self, raw: str | None, own_provider: str | None = None, near: frozenset[tuple[str, ...]] | None = None) -> tuple[bool, float, int, int, int, str | None] | None:
        """(words in another order, distance, how much was left out, place of an exact reading, -frequency, target) of the best entry: the least of these is
        the best of all entries, also where they are spread over several matchers. near: providers, in place of those of the matcher."""
        if raw is None or not raw.strip():
            return None
        key = (raw, own_provider, near)
        if key not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[key] = self._rank(raw, own_provider, near)
        return self.memo[key]

    def _rank(self, raw: str, own_provider: str | None, near: frozenset[tuple[str, ...]] | None) -> tuple[bool, float, int, int, int, str | None] | None:
        if near is not None:
            tried = readings(raw, near, None, *self.silent)
        elif self.providers:
            tried = readings(raw, self.providers, self.lengths, *self.silent)
        else:
            tried = readings(raw, {tokens(simplify(own_provider))} - {()} if own_provider else (), None, *self.silent)
        ranked = []
        for i, (words, left) in enumerate(tried):
            if (hit := self._nearest(words)) is not None:
                ranked.append((False, hit[0], left, i if hit[0] == 0 else 0, hit[1], hit[2]))
                if hit[0] == 0:
                    break
        if not ranked:
            for words, left in tried:
                if 2 <= len(words) <= 4:
                    for p in permutations(words):
                        if p != words and (hit := self._nearest(p)) is not None:
                            ranked.append((True, hit[0], left, 0, hit[1], hit[2]))
                elif len(words) > 4 and (hit := self._reordered(words)) is not None:
                    ranked.append((True, hit[0], left, 0, hit[1], hit[2]))
        return min(ranked, key=lambda r: (*r[:5], r[5] or "")) if ranked else None


@F.pandas_udf(T.StringType())
def _same_name(names: pd.Series) -> pd.Series:
    """What names that are weighed against each other have in common: their letters and numbers."""
    return names.map(lambda n: "|".join([(p := _parts(tokens(simplify(n))))[0], *p[1]]))


_MATCHERS: OrderedDict[str, Matcher] = OrderedDict()


def _matcher(name: str, shared) -> Matcher:
    """The matcher of broadcast entries, which have a name of their own; built once in a worker process, of which the last two are kept."""
    if name not in _MATCHERS:
        _MATCHERS[name] = Matcher(*shared.value)
        while len(_MATCHERS) > 2:
            _MATCHERS.popitem(last=False)
    return _MATCHERS[name]


def map_to_canonical(values: DataFrame, key: str, raw: str, entries: DataFrame, providers: DataFrame | None = None, own_provider: str | None = None, max_entries: int = MAX_ENTRIES, max_providers: int = MAX_PROVIDERS, fillers: frozenset[str] = FILLERS, remark: re.Pattern = REMARK) -> DataFrame:
    """(key, raw, target, distance): for each row of `values` the target of the entry that is meant, or UNMATCHED.

    entries: (name, target, n); a null target is a name that stands for nothing, n how often the entry is referred to. A name with
    several targets goes to the most frequent, then the least. Rows repeated with one key count once (the least raw value). Null, empty
    and unreadable values are unmatched. Rows are matched where they lie; up to `max_entries` entries, counted first,
    go to the tasks at once, and longer lists are taken in passes, over which hits are ranked as in one; a pass's hits are written before the next part
    is sent, so that the driver holds one part at a time. providers: (provider), names that may
    stand before a value. fillers: words at the ends of a value, and remark: a pattern of settings and scores, that say nothing about which entry is meant; further readings
    leave them out.
    """
    rows = values.select(F.col(key).alias("key"), F.col(raw).alias("raw"), (F.col(own_provider) if own_provider else F.lit(None).cast("string")).alias("own"))
    # matching costs far more time than its rows weigh, so they are spread by number, which adaptive execution leaves as it is; by a hash of
    # the key, as a repartition by the key itself, by which they lie already, is planned away
    spread = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.groupBy("key").agg(F.min("raw").alias("raw"), F.min("own").alias("own")).repartition(spread, F.xxhash64("key"))
    named = providers.select("provider").where("provider is not null").distinct() if providers is not None else None
    names = named.limit(max_providers + 1).collect() if named is not None else []
    known, many = [r.provider for r in names], len(names) > max_providers
    rows = _with_near_providers(rows, named, fillers, remark) if many else rows.withColumn("near", F.lit(None).cast("array<string>"))
    known = [] if many else known
    found = entries.select("name", "target", "n").where("name is not null").distinct()
    passes = max(1, -(-found.count() // max_entries))
    if passes > 1:  # names with the same letters and numbers are weighed against each other in one pass
        found = found.withColumn("part", F.pmod(F.xxhash64(_same_name("name")), F.lit(passes)))
    spark, out = values.sparkSession, None
    schema = f"key {dict(rows.dtypes)['key']}, raw string, reordered boolean, distance double, left_out int, place int, rare bigint, target string"
    for i in range(passes):
        part = [(r.name, r.target, r.n or 0) for r in (found.where(F.col("part") == i) if passes > 1 else found).collect()]
        shared = spark.sparkContext.broadcast((part, known, fillers, remark))

        def run(batches: Iterator[pd.DataFrame], shared=shared, held=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            matcher = _matcher(held, shared)
            for b in batches:
                hits = [matcher.rank(v, o, frozenset(tuple(p.split(" ")) for p in (q if q is not None else ())) if many else None) or (None,) * 6 for v, o, q in zip(b["raw"], b["own"], b["near"], strict=True)]
                yield pd.DataFrame({"key": b["key"], "raw": b["raw"]} | {c: pd.Series([h[j] for h in hits], dtype=object) for j, c in enumerate(("reordered", "distance", "left_out", "place", "rare", "target"))})

        one = rows.mapInPandas(run, schema)
        if passes > 1:
            one = written(one, "hits")
            shared.destroy()
        out = one if out is None else out.unionByName(one)
    if passes > 1:
        rank = F.struct("reordered", "distance", "left_out", "place", "rare", F.coalesce("target", F.lit("")).alias("at"), "target")
        out = out.groupBy("key").agg(F.min("raw").alias("raw"), F.min(F.when(F.col("reordered").isNotNull(), rank)).alias("m")).select("key", "raw", "m.target", "m.distance")
    out = out.withColumn("distance", F.when(F.col("target").isNotNull(), F.col("distance")))
    return out.select(F.col("key").alias(key), F.col("raw").alias(raw), F.coalesce("target", F.lit(UNMATCHED)).alias("target"), "distance")


def _with_near_providers(rows: DataFrame, named: DataFrame, fillers: frozenset[str], remark: re.Pattern) -> DataFrame:
    """rows with `near`, the providers, as words, that may stand before or after a reading; a shuffle join, for providers too many to send about."""
    words = F.pandas_udf(lambda names: names.map(lambda p: " ".join(tokens(simplify(p)))), "string")
    held = named.select(words("provider").alias("asked")).where("asked <> ''").distinct()
    lengths = [r.n for r in held.select(F.size(F.split("asked", " ")).alias("n")).distinct().collect()]  # bounded by the longest provider

    def asked(raw: str | None) -> list[str]:
        out = Asked()
        if raw and raw.strip():
            readings(raw, out, lengths, fillers, remark)
        return [" ".join(x) for x in out]

    sought = rows.select("raw").distinct().select("raw", F.explode(F.pandas_udf(lambda raws: raws.map(asked), "array<string>")("raw")).alias("asked")).join(held, "asked", "left_semi")
    near = sought.groupBy("raw").agg(F.collect_set("asked").alias("near"))
    return rows.join(near, "raw", "left").select("key", "raw", "own", "near")
