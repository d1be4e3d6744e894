"""Evaluation texts that leak into training text.

The word sequences of the test items are held in one generalised suffix automaton. The words of a document run through
it, and the longest suffix that occurs in some item is tracked. Where it reaches the seed length of an item, the items and places of that run are
looked up in the automaton; each fixes a diagonal (place in the document less place in the item). Around the diagonals
of an item all alignments are searched for the widest span of the item with at most one word in eight altered (replaced,
missing or put in). A span of at least half the item's words is a leak.

The search is exact. A span of n words with one in eight altered has a run of seed_for(n) unaltered words, so no item of which a document holds enough is
overlooked; each item has the seed of its own length, so a short item makes no work for the others. Alterations move an
alignment by as many diagonals as words are put in or missing, so bands of that width about the seeds hold every one, and within a band the widest span is
found by dynamic programming over all starts at once.
"""

from __future__ import annotations

import uuid
from array import array
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import _WORD, folded, placed_words, plain, words
from tidemark.session import written

#: One word in so many may be altered.
ALTERED = 8
#: Share of an item's words that must stand together.
COVERAGE = 0.5
#: Words of items that go to the tasks at once; more are taken in several passes.
ITEM_WORDS = 2_000_000
#: Cells (starts times diagonals) of the span search that are held at once.
CELLS = 1 << 20


def most_altered(n: int, altered: int = ALTERED) -> int:
    """Words that a span of n words of an item may have altered; those put in count among its words too."""
    return n // (altered - 1) if altered > 1 else n


def _altered_runs(n: int, altered: int) -> Iterator[tuple[int, int]]:
    """(unaltered words, runs into which they may fall) of spans of n words, by the number of words put in."""
    for put_in in range(most_altered(n, altered) + 1):
        other = (n + put_in) // altered - put_in
        if other >= 0:
            yield n - other, other + put_in + 1


def seed_for(n: int, altered: int = ALTERED) -> int:
    """The run of unaltered words that every span of at least n words must have."""
    return max(1, min(-(-left // runs) for j in range(max(n, 1), max(n, 1) + 8 * altered) for left, runs in _altered_runs(j, altered)))


class Automaton:
    """A generalised suffix automaton over sequences of word numbers, with the places where its states end.

    Nearly all states have one way on, which is kept in arrays; only the others have a dictionary. Places lie in the order of a walk
    over the suffix links, so those of a state are one slice.
    """

    def __init__(self, sequences: list[list[int]]):
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.len = array("i", [-1]), array("i", [0])
        ends = array("i")
        for seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w)
                ends.append(last)
        self._order(np.array(ends, np.int64), [len(s) for s in sequences])

    def _go(self, v: int, w: int) -> int:
        if self.word[v] == w:
            return self.to[v]
        ways = self.more.get(v)
        return -1 if ways is None else ways.get(w, -1)

    def _set(self, v: int, w: int, q: int) -> None:
        if self.word[v] in (-1, w):
            self.word[v], self.to[v] = w, q
        else:
            self.more.setdefault(v, {})[w] = q

    def _new(self, length: int) -> int:
        for a, x in ((self.word, -1), (self.to, -1), (self.link, 0), (self.len, length)):
            a.append(x)
        return len(self.len) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.len[p] + 1)
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self._go(p, w) == q:
            self._set(p, w, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self._go(last, w)
        if q >= 0:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.len[last] + 1), last
        while p >= 0 and (q := self._go(p, w)) < 0:
            self._set(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return new

    def _order(self, ends: np.ndarray, lengths: list[int]) -> None:
        link = np.array(self.link, np.int64)
        n = len(link)
        size = np.ones(n, np.int64)
        by_length = np.argsort(np.array(self.len), kind="stable")
        for v in by_length[:0:-1].tolist():  # a link is shorter than its state
            size[link[v]] += size[v]
        first = np.zeros(n, np.int64)
        free = np.ones(n, np.int64)
        for v in by_length[1:].tolist():
            p = link[v]
            first[v] = first[p] + free[p]
            free[p] += size[v]
        sequence = np.repeat(np.arange(len(lengths)), lengths)
        place = np.concatenate([np.arange(k) for k in lengths]) if lengths else np.zeros(0, np.int64)
        order = np.argsort(first[ends], kind="stable")
        self._sequence, self._place = sequence[order], place[order]
        at = first[ends][order]
        self._from, self._upto = np.searchsorted(at, first), np.searchsorted(at, first + size)

    def places(self, state: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and last places of every occurrence of the state's words."""
        part = slice(self._from[state], self._upto[state])
        return self._sequence[part], self._place[part]

    def runs(self, seq: list[int], lengths: tuple[int, ...]) -> Iterator[tuple[int, int, int]]:
        """(place in seq, length, state): for each of the lengths, sorted, that the longest known suffix reaches, the state that holds just the suffix of this length."""
        state = length = 0
        link, upto, least = self.link, self.len, lengths[0]
        for i, w in enumerate(seq):
            q = self._go(state, w)
            while q < 0 and state:
                state = link[state]
                length = upto[state]
                q = self._go(state, w)
            if q >= 0:
                state, length = q, length + 1
            if length >= least:
                at = state
                for n in reversed(lengths):
                    if length >= n:
                        while upto[link[at]] >= n:
                            at = link[at]
                        yield i, n, at

    def seeds(self, seq: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(place in seq, sequence, place in the sequence) of every run of `least` words, by their last places."""
        for i, _, at in self.runs(seq, (least,)):
            for s, j in zip(*self.places(at), strict=True):
                yield i, int(s), int(j)


def longest_span(same: np.ndarray, altered: int = ALTERED) -> tuple[int, int]:
    """(start, end) of the longest window of which at most one word in `altered` is altered."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - altered))])
    low = np.minimum.accumulate(total)
    best, out, i = 0, (0, 0), 0
    high = np.maximum.accumulate(total[::-1])[::-1]
    # two pointers over prefix minima and suffix maxima: the widest i < j with total[j] >= total[i]
    j, n = 0, len(total)
    while i < n and j < n:
        if high[j] >= low[i]:
            if j - i > best:
                best, out = j - i, (i, j)
            j += 1
        else:
            i += 1
    return out


class Scanner:
    """Finds the items that a text holds."""

    def __init__(self, items: list[tuple[int, str]], coverage: float = COVERAGE, altered: int = ALTERED):
        self.ids, seqs = [], []
        self.vocabulary: dict[str, int] = {}
        for item, text in items:
            seq = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            if seq:
                self.ids.append(item)
                seqs.append(seq)
        self.items = [np.array(s, np.int32) for s in seqs]
        self.least = [max(1, int(np.ceil(len(s) * coverage))) for s in seqs]
        self.altered = altered
        seeds = {n: seed_for(n, altered) for n in set(self.least)}
        # seeds that a span of at least so many words has at the least
        need = {m: max(1, min(left - (seeds[m] - 1) * runs for n in range(m, m + altered) for left, runs in _altered_runs(n, altered))) for m in seeds}
        self.seed, self.seeds = np.array([seeds[n] for n in self.least], np.int64), [need[n] for n in self.least]
        self.lengths = tuple(sorted(set(seeds.values())))
        self.automaton = Automaton(seqs)
        self.known: dict[str, int] = {}
        self._held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def numbers(self, text: str) -> np.ndarray:
        """The words of a text as numbers, -1 for those that no item has."""
        known, found = self.known, _WORD.findall(plain(text))
        out = list(map(known.get, found))
        if None in out:
            if len(known) > 500_000:
                known.clear()
            for i, w in enumerate(found):
                if out[i] is None:
                    out[i] = known[w] = self.vocabulary.get(folded(w), -1)
        return np.array(out, np.int32)

    def leaks(self, text: str) -> list[tuple[int, float]]:
        """(item id, share of its words in the longest span) of the items that leaked."""
        return [(self.ids[s], share) for s, share, _ in self._search(self.numbers(text))]

    def spans(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item id, share, first character, last character + 1) of the longest span of each item that leaked."""
        placed = placed_words(text)
        doc = np.array([self.vocabulary.get(w, -1) for w, _, _ in placed], np.int32)
        found = [(s, share, self._where(doc, s, *band)) for s, share, band in self._search(doc)]
        return [(self.ids[s], share, placed[a][1], placed[b - 1][2]) for s, share, (a, b) in found]

    def all_spans(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, first character, last character + 1) of every span that leaked: those of an item are looked for again, without the words of the found ones, until
        there is none."""
        placed = placed_words(text)
        doc = np.array([self.vocabulary.get(w, -1) for w, _, _ in placed], np.int32)
        out = []
        while found := [(s, self._where(doc, s, *band)) for s, _, band in self._search(doc)]:
            for s, (a, b) in found:
                out.append((self.ids[s], placed[a][1], placed[b - 1][2]))
            for _, (a, b) in found:
                doc[a:b] = -1
        return out

    def _hits(self, state: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Items of seed length n, and places in them, where the state's words end."""
        if len(self.lengths) == 1:
            return self.automaton.places(state)
        if (held := self._held.get((state, n))) is None:
            if len(self._held) > 100_000:
                self._held.clear()
            s, j = self.automaton.places(state)
            mine = self.seed[s] == n
            held = self._held[state, n] = s[mine], j[mine]
        return held

    def _search(self, doc: np.ndarray) -> list[tuple[int, float, tuple[int, int, int, int]]]:
        """(item, share, (first diagonal, diagonals, start, end of the longest span)) of the items that leaked."""
        least = self.lengths[0] if self.lengths else 1
        inside = np.concatenate([[False], doc >= 0, [False]])
        edges = np.nonzero(inside[1:] != inside[:-1])[0]
        who, diagonals = [], []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                for i, n, state in self.automaton.runs(doc[a:b].tolist(), self.lengths):
                    s, j = self._hits(state, n)
                    who.append(s)
                    diagonals.append(a + i - j)
        if not who:
            return []
        s, d = np.concatenate(who), np.concatenate(diagonals)
        if not len(s):
            return []
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        cuts = np.nonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))[0]
        present = np.zeros(len(self.vocabulary), bool)
        present[doc[doc >= 0]] = True
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            item = int(s[a])
            m, least = len(self.items[item]), self.least[item]
            if b - a >= self.seeds[item] and present[self.items[item]].sum() >= self._unaltered(least) and (hit := self._widest(doc, item, d[a:b])) is not None:
                out.append((item, (hit[3] - hit[2]) / m, hit))
        return out

    def _unaltered(self, n: int) -> int:
        """Unaltered words that a span of at least n words has at the least."""
        return n - n // self.altered

    def _widest(self, doc: np.ndarray, s: int, seeds: np.ndarray) -> tuple[int, int, int, int] | None:
        """(first diagonal, diagonals, start, end) of the widest span of an item, if it is wide enough. seeds: diagonals of its seeds, sorted."""
        item, m, least = self.items[s], len(self.items[s]), self.least[s]
        room = most_altered(m, self.altered)
        best, at = least - 1, 0
        out = None
        while at < len(seeds):
            low = int(seeds[at])
            upto = int(np.searchsorted(seeds, low + 2 * room, "right"))  # the least seeds of an alignment that this band holds
            last = int(seeds[upto - 1])
            if np.searchsorted(seeds, last + room, "right") - at >= self.seeds[s]:
                first, k = low - room, last + room - (low - room) + 1
                agree = self._agree(doc, item, first, k)
                anywhere = agree.any(1)
                # no alignment has more words that agree, or spans more
                if anywhere.sum() >= self._unaltered(least) and np.subtract(*longest_span(anywhere, self.altered)[::-1]) > best:
                    used = np.nonzero(agree.any(0))[0]  # outer diagonals without a word that agrees only move an alignment away
                    first, k, agree = first + int(used[0]), int(used[-1] - used[0]) + 1, agree[:, used[0] : used[-1] + 1]
                    ahead = longest_span(agree[:, agree.sum(0).argmax()], self.altered)
                    if ahead[1] - ahead[0] == m:
                        return first + int(agree.sum(0).argmax()), 1, 0, m
                    hit = self._band(agree, best + 1)
                    if hit is not None:
                        best, out = hit[1] - hit[0], (first, k, *hit)
                        if best == m:
                            return out
            at = upto
        return out

    @staticmethod
    def _agree(doc: np.ndarray, item: np.ndarray, first: int, k: int) -> np.ndarray:
        """Where the words of an item (rows) agree with the document along k diagonals (columns)."""
        m = len(item)
        a, b = max(0, first), min(len(doc), first + m + k - 1)
        padded = np.full(m + k - 1, -1, np.int32)
        if a < b:
            padded[a - first : b - first] = doc[a:b]
        return np.ndarray((m, k), np.int32, padded, strides=(4, 4)) == item[:, None]

    def _step(self, state: np.ndarray, agree: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """Best scores by diagonal after one more word of the item: it agrees, is replaced or is missing, and then words may be put in."""
        loss = self.altered - 1
        new = state + np.where(agree, 1, -loss)
        np.maximum(new[:, :-1], state[:, 1:] - loss, out=new[:, :-1])
        new += slope
        np.maximum.accumulate(new, axis=1, out=new)
        new -= slope
        return new

    def _band(self, agree: np.ndarray, least: int) -> tuple[int, int] | None:
        """(start, end) of the widest span of at least `least` words with an alignment in the band whose score, 1 for a word that agrees and 1 - altered for one that is
        altered, is not below 0. All starts are carried on together, so many at once as CELLS holds."""
        m, k = agree.shape
        slope = ((self.altered - 1) * np.arange(k)).astype(np.int32)
        best, out = least - 1, None
        block = max(1, CELLS // k)
        for begin in range(0, m - least + 1, block):
            starts = min(block, m - best - begin)
            if starts < 1:
                break
            state = np.zeros((starts, k), np.int32)
            for j in range(begin, m):
                live = min(starts, j - begin + 1)
                state[:live] = self._step(state[:live], agree[j], slope)
                reach = j + 1 - best - begin  # starts before it would be wider than the best
                if reach > 0:
                    ok = np.nonzero(state[: min(live, reach)].max(1) >= 0)[0]
                    if len(ok):
                        best, out = j + 1 - begin - int(ok[0]), (begin + int(ok[0]), j + 1)
        return out

    def _where(self, doc: np.ndarray, s: int, first: int, k: int, start: int, end: int) -> tuple[int, int]:
        """The first and the last word + 1 of the document that agree in the best alignment of a span."""
        agree = self._agree(doc, self.items[s], first, k)[start:end]
        slope = ((self.altered - 1) * np.arange(k)).astype(np.int32)
        states = [np.zeros((1, k), np.int32)]
        for row in agree:
            states.append(self._step(states[-1], row, slope))
        loss, now, used = self.altered - 1, int(states[-1][0].argmax()), []
        for j in range(end - start, 0, -1):
            before, score = states[j - 1][0], states[j][0, now]
            # words put in before the next word: from the lower diagonal that scores best
            for d in range(now, -1, -1):
                here = score + loss * (now - d)
                if here == before[d] + (1 if agree[j - 1, d] else -loss):
                    if agree[j - 1, d]:
                        used.append(first + start + j - 1 + d)
                    now = d
                    break
                if d + 1 < k and here == before[d + 1] - loss:
                    now = d + 1
                    break
        return min(used), max(used) + 1


_SCANNERS: OrderedDict[tuple, Scanner] = OrderedDict()


def _scanner(name: str, shared, coverage: float, altered: int) -> Scanner:
    """The scanner of broadcast items, which have a name of their own; built once in a worker process, of which the last two are kept."""
    key = (name, coverage, altered)
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(shared.value, coverage, altered)
        while len(_SCANNERS) > 2:
            _SCANNERS.popitem(last=False)
    return _SCANNERS[key]


def _over_items(items: DataFrame, item_id: str, item_text: str, item_words: int, scan: Callable[..., DataFrame]) -> DataFrame:
    """scan(name, broadcast items) for all items at once, or, where they have more than item_words words, measured first, for one part after the other; each part's rows
    are written before the next one is sent, so that the driver holds one part at a time."""
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where(F.length(F.trim("t")) > 0).distinct()
    total = rows.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    passes = max(1, -(-total // item_words))
    context, out = items.sparkSession.sparkContext, None
    for p in range(passes):
        shared = context.broadcast([(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == p).sort("i", "t").collect()])  # bounded: item_words words
        one = scan(uuid.uuid4().hex, shared)
        if passes > 1:
            one = written(one, "leaks")
            shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, coverage: float = COVERAGE, altered: int = ALTERED, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, share): the items of which a document holds at least `coverage` of the words standing together in order, with
    at most one word in `altered` altered; share is that of the longest such span.

    Words are compared without case, accents, punctuation and markup. Null and empty texts hold nothing; null ids are kept.
    A document delivered twice under one id gives its rows twice. The documents are read once and not shuffled. The items go
    to the tasks, at most item_words words at once, measured first; more are taken in several passes.
    """
    schema = f"doc_id {dict(documents.dtypes)[doc_id]}, item_id {dict(items.dtypes)[item_id]}, share double"
    texts = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.length("t") > 0)

    def scan(name: str, shared) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scanner = _scanner(name, shared, coverage, altered)
            for b in batches:
                found = [(d, i, s) for d, t in zip(b["d"], b["t"], strict=True) for i, s in scanner.leaks(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "share"])

        return texts.mapInPandas(run, schema)

    return _over_items(items, item_id, item_text, item_words, scan)


def leaked_spans(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, coverage: float = COVERAGE, altered: int = ALTERED, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, text, spans): the documents that hold items, with all leaked spans as (item_id, first_char, end_char), characters counted from 0 in the text as
    it stands; an item that stands in a document several times has several. Cases as in leaked_items."""
    kind, item_kind = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {kind}, text string, spans array<struct<item_id:{item_kind},first_char:bigint,end_char:bigint>>"
    texts = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.length("t") > 0)
    parts = 0

    def scan(name: str, shared) -> DataFrame:
        nonlocal parts
        parts += 1

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scanner = _scanner(name, shared, coverage, altered)
            for b in batches:
                out = [(d, t, [{"item_id": i, "first_char": a, "end_char": e} for i, a, e in scanner.all_spans(t)]) for d, t in zip(b["d"], b["t"], strict=True) if scanner.leaks(t)]
                yield pd.DataFrame([x for x in out if x[2]], columns=["doc_id", "text", "spans"])

        return texts.mapInPandas(run, schema)

    found = _over_items(items, item_id, item_text, item_words, scan)
    if parts == 1:
        return found
    # a document that several parts found has a row of each; copies of a row have as many as there are copies, which the number among equal rows tells apart
    numbered = found.select("doc_id", "text", F.posexplode("spans").alias("n", "span")).groupBy("doc_id", "text", "span", "n").agg(F.count("*").alias("copies"))
    merged = numbered.groupBy("doc_id", "text").agg(F.collect_set("span").alias("spans"), F.max("copies").alias("copies"))
    return merged.select("doc_id", "text", "spans", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_c")).drop("_c")


def without_leaks(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, drop_share: float = 0.8, coverage: float = COVERAGE, altered: int = ALTERED, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, items, removed_chars, dropped, text) of the documents that hold items: the text without the leaked spans, or null and dropped where
    these make up `drop_share` of its characters or more. Other documents give no row.

    An item that stands in a document several times is removed each time. Spans are found in the text as it stands and cut together, whatever the number of
    passes over the items.
    """
    spans = leaked_spans(documents, items, doc_id, text, item_id, item_text, coverage, altered, item_words)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t, found in zip(b["doc_id"], b["text"], b["spans"], strict=True):
                kept, at = [], 0
                for a, e in sorted((x["first_char"], x["end_char"]) for x in found):
                    kept.append(t[at : max(at, a)])
                    at = max(at, e)
                left = "".join(kept) + t[at:]
                gone = len(t) - len(left)
                dropped = gone >= drop_share * len(t)
                out.append((d, len({x["item_id"] for x in found}), gone, dropped, None if dropped else left))
            yield pd.DataFrame(out, columns=["doc_id", "items", "removed_chars", "dropped", "text"])

    return spans.mapInPandas(clean, f"doc_id {dict(documents.dtypes)[doc_id]}, items bigint, removed_chars bigint, dropped boolean, text string")
