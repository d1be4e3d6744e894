"""Several values packed in one field: a quote-aware finite-state tokenizer.

The scanner runs over a text once, from left to right. Its state is whether it stands at the start of a value, the
quote that is open, and the depth of brackets; quotes and brackets that are never closed are ordinary signs. Signs that may
separate are noted with their kind only outside quotes, brackets and protected names. Which kinds separate
is settled for the whole field at the end:

* comma, semicolon, bar, middle dot, bullet, tab and line break (also the full-width and ideographic ones) always do;
* a slash between blanks does where no other sign does;
* the word "and" does between the last two values of a list in prose, that is after the last comma, where commas
  are the only other separators.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What people write in place of an empty list, compared in lower case.
PLACEHOLDERS = ("", "-", "--", "–", "—", "?", ".", "...", "…", "n/a", "n.a.", "na", "nan", "nil", "none", "null", "nothing", "tba", "tbd", "to be announced", "to be determined", "unknown")
#: Opening and closing quotes.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "”": "”", "＂": "＂"}
#: Signs that separate wherever they stand outside quotes and brackets.
SEPARATORS = ",;|\n\r\t，、；｜·•‧・"
#: Protected names that a task may be given as one pattern; beyond it, catalogue names are matched by a join, with the same result.
MAX_PROTECTED = 20_000

_BRACKETS = {"(": ")", "（": "）", "[": "]", "{": "}"}
_STOP = re.compile(r"[\\%s%s%s]|\s[/／](?=\s)|\s(?:and|AND)(?=\s)" % (re.escape(SEPARATORS), re.escape("".join(_BRACKETS)), re.escape("".join(QUOTES))))
_BULLET = re.compile(r"^\s*[-*–—▪●‣►]\s+")
_NUMBER = re.compile(r"^\s*(\d{1,3})[.)]\s+")
_BOUNDARY = r"(?=$|[\s%s()\[\]（）/／\"”»*†])" % re.escape(SEPARATORS)
_AND = re.compile(r"(?:and|AND)(?=\s)")
_SINGLE = re.compile(r"(['`‘])[^'`’]+['`’]" + _BOUNDARY)
#: Pieces after which a value may start.
_BEFORE = frozenset(SEPARATORS + "/／[ ​﻿")
_BLANKS = re.compile(r"[\s​﻿]*")


def protected_pattern(names: Iterable[str | None]) -> re.Pattern | None:
    """A pattern of the names that hold a sign which might separate; the longest matches first, in any case and spacing."""
    risky = {" ".join(n.split()) for n in names if n and _STOP.search(n.strip())}
    if not risky:
        return None
    parts = (r"\s+".join(map(re.escape, n.split(" "))) for n in sorted(risky, key=lambda n: (-len(n), n)))
    return re.compile("(?:" + "|".join(parts) + ")" + _BOUNDARY, re.IGNORECASE)


def _close(text: str, at: int, opener: str) -> int:
    """Where the quote opened at `at` is closed, or -1; a backslash escapes, a doubled quote stands for itself."""
    quote, i, n = QUOTES[opener], at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n:
            i += 2
        elif c == quote:
            if opener == quote and i + 1 < n and text[i + 1] == quote and i > at + 1:
                i += 2
            else:
                return i
        else:
            i += 1
    return -1


def _balanced(text: str, at: int) -> int:
    """Where the bracket opened at `at` is closed, or -1."""
    depth: list[str] = []
    for i in range(at, len(text)):
        c = text[i]
        if c in _BRACKETS:
            depth.append(_BRACKETS[c])
        elif depth and c == depth[-1]:
            depth.pop()
            if not depth:
                return i
    return -1


def _value(raw: str) -> str:
    """A value as written, without enclosing quotes, markup and needless blanks."""
    v = " ".join(raw.replace("​", " ").replace("﻿", " ").split())
    v = _BULLET.sub("", v)
    while len(v) > 1 and v[0] in QUOTES and (end := _close(v, 0, v[0])) > 0 and (end == len(v) - 1 or v[end + 1 :].lstrip()[:1] in ("(", "（")):
        inner = v[1:end]
        if v[0] == QUOTES[v[0]]:
            inner = inner.replace(v[0] * 2, v[0])
        if "\\" in inner:
            inner = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), inner)
            inner = re.sub(r"\\(.)", lambda m: {"n": " ", "t": " ", "r": " "}.get(m[1], m[1]), inner)
        v = " ".join((inner + v[end + 1 :]).split())
    if len(v) > 2 and (m := _SINGLE.fullmatch(v)):
        v = v[1:-1].strip()
    return v


def split_values(text: str | None, protected: re.Pattern | None = None, placeholders: frozenset[str] = frozenset(PLACEHOLDERS)) -> list[str]:
    """The values of one field in their order. Null, blank and placeholder fields give none."""
    if text is None:
        return []
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]" and _balanced(text, 0) == len(text) - 1:
        text = text[1:-1]
    cuts: list[tuple[int, int, str]] = []
    i, n, start = 0, len(text), True
    while i < n:
        if start:
            start = False
            i = _BLANKS.match(text, i).end()
            if protected and (m := protected.match(text, i)):
                i = m.end()
                continue
            if m := _SINGLE.match(text, i):
                i = m.end()
                continue
            if i and (m := _AND.match(text, i)):
                cuts.append((i, m.end(), "and"))
                i, start = m.end(), True
                continue
        m = _STOP.search(text, i)
        if not m:
            break
        i, sign = m.start(), m.group()
        if sign == "\\":
            i += 2
        elif sign in QUOTES:
            end = _close(text, i, sign)
            i = end + 1 if end > 0 else i + 1
        elif sign in _BRACKETS:
            end = _balanced(text, i)
            i = end + 1 if end > 0 else i + 1
        else:
            kind = "/" if sign[-1] in "/／" else "and" if len(sign) == 4 else sign
            cuts.append((i, m.end(), kind))
            i, start = m.end(), True
    strong = {k for _, _, k in cuts} - {"/", "and"}
    if strong:
        last = max(b for _, b, k in cuts if k in strong)
        prose = strong <= {",", "，"}
        kept = [(a, b) for a, b, k in cuts if k in strong or (k == "and" and prose and a >= last - 1)]
    elif any(k == "/" for _, _, k in cuts):
        kept = [(a, b) for a, b, k in cuts if k == "/"]
    else:
        kept = [(a, b) for a, b, _ in cuts]
    raw, at = [], 0
    for a, b in kept:
        raw.append(text[at : max(a, at)])
        at = b
    raw.append(text[at:])
    raw = [r for r in raw if r.strip()]
    numbers = [_NUMBER.match(r) for r in raw]
    if len(raw) > 1 and all(numbers) and [int(m[1]) for m in numbers if m] == list(range(1, len(raw) + 1)):
        raw = [_NUMBER.sub("", r) for r in raw]
    values = (_value(r) for r in raw)
    return [v for v in values if v.lower() not in placeholders]


def split_list_field(df: DataFrame, row_id: str, field: str, catalogue: DataFrame | None = None, name: str = "name", limit: int = MAX_PROTECTED) -> DataFrame:
    """One row per value of `field`: (row_id, item_pos from 1, item_name). Columns besides these two are not read.

    A row with a null id is kept. Rows repeated with one id count once; of differing fields the greatest counts, so that the choice does not depend on
    the order of the rows (keep the newest row before, where rows are corrected). Null, empty and
    placeholder fields give no row; a value named twice gives two. A name of catalogue[name] is never split.
    Of the catalogue only names that hold a separating sign matter: up to `limit` of them, counted first, go to the
    tasks as one pattern. Where there are more, the runs of neighbouring pieces that a field could hold as one name
    are joined with the catalogue, and a batch protects just the names that its own rows turned out to hold. Both ways give the same values.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.col(field).alias("field"))
    known = rows.where(F.col("row_id").isNotNull()).groupBy("row_id").agg(F.max("field").alias("field"))
    rows = known.unionByName(rows.where(F.col("row_id").isNull()))
    rows = rows.where(F.length(F.trim("field")) > 0)
    schema = "row_id %s, item_pos bigint, item_name string" % dict(rows.dtypes)["row_id"]
    names: list[str] | None = []
    if catalogue is not None:
        risky = catalogue.select(F.col(name).alias("n")).where(F.col("n").rlike(r"[,;|\n\r\t，、；｜·•‧・]|\s[/／]\s|(?i)\sand\s")).distinct()
        names = [r.n for r in risky.limit(limit + 1).collect()]
        if len(names) > limit:
            rows, names = _with_own_names(rows, risky), None
    if names is None:
        spread = rows.mapInPandas(_split_own, schema)
    else:
        fixed = protected_pattern(names)

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield _frame(b["row_id"], (split_values(t, fixed) for t in b["field"]))

        spread = rows.mapInPandas(split, schema)
    return spread.withColumnRenamed("row_id", row_id)


def _frame(ids: pd.Series, lists: Iterable[list[str]]) -> pd.DataFrame:
    lists = list(lists)
    n = [len(x) for x in lists]
    return pd.DataFrame({"row_id": ids.repeat(n).reset_index(drop=True), "item_pos": [i for k in n for i in range(1, k + 1)], "item_name": [v for x in lists for v in x]})


def _split_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        names = {n for own in b["own"] if own is not None for n in own}
        protected = protected_pattern(names) if names else None
        yield _frame(b["row_id"], (split_values(t, protected) for t in b["field"]))


def _pieces(text: str) -> list[str]:
    """Words, blanks and signs of a squeezed text."""
    return re.findall(r"\w+|\W", " ".join(text.split()))


def _runs(text: str, widths: Iterable[int]) -> list[str]:
    """Runs of as many neighbouring pieces as some risky name has, wherever a value may start; case is folded."""
    pieces = _pieces(text)
    starts = [i for i in range(len(pieces)) if i == 0 or pieces[i - 1] in _BEFORE]
    runs = {"".join(pieces[i : i + w]) for w in widths for i in starts if i + w <= len(pieces)}
    return list({run.casefold() for run in runs if _STOP.search(run)})


def _name_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        pieces = [_pieces(n) for n in b["n"]]
        yield pd.DataFrame({"n": b["n"], "run": ["".join(p).casefold() for p in pieces], "w": [len(p) for p in pieces]})


def _with_own_names(rows: DataFrame, risky: DataFrame) -> DataFrame:
    """rows with `own`, the catalogue names that the field may hold; a shuffle join, for catalogues too large to send about. Rows are keyed by the field itself,
    so null ids need no other key. The numbers of pieces that risky names have are measured first."""
    named = risky.mapInPandas(_name_runs, "n string, run string, w int")
    widths = sorted(r.w for r in named.select("w").distinct().collect())  # bounded by the longest name

    def run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            runs = [_runs(t, widths) for t in b["field"]]
            yield pd.DataFrame({"field": b["field"].repeat([len(r) for r in runs]), "run": [x for r in runs for x in r]})

    sought = rows.select("field").distinct().mapInPandas(run_rows, "field string, run string").join(named.select("n", "run"), "run")
    own = sought.groupBy("field").agg(F.collect_set("n").alias("own"))
    return rows.join(own, "field", "left")
