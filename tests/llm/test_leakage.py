import random

import numpy as np
import pytest

from tidemark.llm.leakage import Automaton, Scanner, leaked_items, longest_span, seed_for
from tidemark.llm.words import words

RNG = random.Random(11)
VOCAB = [f"w{i}x" for i in range(400)]
ITEMS = [(i, " ".join(RNG.choices(VOCAB, k=n))) for i, n in enumerate([60, 80, 100, 120, 64, 90])]


def _altered(ws, k, kind, rng):
    ws = list(ws)
    for at in sorted(rng.sample(range(1, len(ws) - 1), k), reverse=True):
        if kind == "replaced":
            ws[at] = "zzz"
        elif kind == "missing":
            del ws[at]
        else:
            ws.insert(at, "zzz")
    return ws


def test_seed_for():
    assert seed_for(29) == 6 and seed_for(1) == 1
    for n in range(1, 80):
        s = seed_for(n)
        for m in range(n, n + 40):
            assert -(-(m - m // 8) // (m // 8 + 1)) >= s


def test_automaton():
    seqs = [[RNG.randrange(4) for _ in range(30)] for _ in range(5)]
    a = Automaton(seqs)
    doc = [RNG.randrange(4) for _ in range(200)]
    for least in (1, 3, 5):
        want = {(i, s, j) for i in range(len(doc)) for s, q in enumerate(seqs) for j in range(len(q)) if i + 1 >= least and j + 1 >= least and doc[i - least + 1 : i + 1] == q[j - least + 1 : j + 1]}
        assert set(a.seeds(doc, least)) == want


def test_longest_span():
    for _ in range(300):
        same = np.array([RNG.random() < 0.85 for _ in range(RNG.randrange(1, 40))])
        a, b = longest_span(same)
        best = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if (~same[i:j]).sum() * 8 <= j - i), default=0)
        assert b - a == best


@pytest.mark.parametrize("kind", ["replaced", "missing", "put in"])
def test_found_and_not_found(kind):
    s = Scanner(ITEMS)
    for i, text in ITEMS:
        ws = text.split()
        for share, want in ((0.5, True), (0.75, True), (1.0, True), (0.4, False)):
            n = int(np.ceil(len(ws) * share))
            if not want:
                n -= 1
            start = RNG.randrange(len(ws) - n + 1)
            part = ws[start : start + n]
            k = max(0, (n // 8) - 3) if want else 0
            if kind != "replaced" and n < len(ws) * 0.6:
                k = 0
            doc = ["other"] * 50 + _altered(part, k, kind, RNG) + ["words"] * 50
            got = dict(s.leaks(" ".join(doc)))
            assert (i in got) is want, (kind, i, share, k)


def test_normal_forms():
    item = "Später fällt der Krug, und die Glaserin schließt das Tor für drei Tage. " * 2
    s = Scanner([(1, item)])
    ws = item.split()
    for doc in (
        item.upper(), item.replace("ä", "a").replace("ü", "u"), item.encode().decode("latin-1"), "> " + "\n> ".join(" ".join(ws[i : i + 4]) for i in range(0, len(ws), 4)),
        "<p>" + item.replace("Krug", "<b>Krug</b>") + "</p>", item.replace(" ", " ** "), item.replace("Glaserin", "Gla-\nserin"), item.replace(" ", "\xa0"),
    ):
        assert [i for i, _ in s.leaks(doc)] == [1], doc
    assert words("L'été — Straße ＡＢ") == ["l", "ete", "strasse", "ab"]


def test_table(spark):
    docs = [(1, None), (2, ""), (3, ITEMS[0][1]), (3, ITEMS[0][1]), (4, "x " * 40_000 + ITEMS[1][1] + " y" * 40_000), (None, ITEMS[2][1]), (5, "nothing of the kind")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "d bigint, t string, item_id string")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS + [(77, None), (78, " ")]], "i bigint, t string, doc_id string")
    for at_once in (10_000, 150):  # in one pass, and in several
        got = sorted((r.doc_id, r.item_id) for r in leaked_items(df.where("d is not null"), items, "d", "t", "i", "t", item_words=at_once).collect())
        assert got == [(3, 0), (3, 0), (4, 1)]
    assert [r.item_id for r in leaked_items(df.where("d is null"), items, "d", "t", "i", "t").collect()] == [2]
    assert leaked_items(df, items.limit(0), "d", "t", "i", "t").count() == 0
    assert leaked_items(df.limit(0), items, "d", "t", "i", "t").count() == 0


def test_spans_and_removal(spark):
    s = Scanner(ITEMS)
    rng = random.Random(3)
    for i, text in ITEMS:
        for doc_item in (text, text.upper(), " ".join(_altered(text.split(), 4, "replaced", rng)), " ".join(_altered(text.split(), 4, "put in", rng)), "> " + text.replace(" ", "\n> ", 9)):
            doc = "Before <b>it</b> stands this. " + doc_item + " After it stands that."
            ((item, share, a, b),) = s.spans(doc)
            assert item == i and dict(s.leaks(doc))[i] == share
            assert abs(a - 30) <= 12 and abs(b - 30 - len(doc_item)) <= 12
    twice = "Intro words here. " + ITEMS[0][1] + " middle part stays. " + ITEMS[0][1] + " the end stays too " * 40
    df = spark.createDataFrame([(1, twice), (2, ITEMS[1][1]), (3, "harmless"), (4, None)], "d bigint, t string")
    items = spark.createDataFrame(ITEMS, "i bigint, t string")
    from tidemark.llm.leakage import without_leaks

    got = {r.doc_id: r for r in without_leaks(df, items, "d", "t", "i", "t").collect()}
    assert set(got) == {1, 2} and got[2].dropped and got[2].text is None
    assert got[1].text.startswith("Intro words here.") and "middle part stays." in got[1].text and not s.leaks(got[1].text)
    assert sorted(map(tuple, without_leaks(df, items, "d", "t", "i", "t", item_words=100).collect())) == sorted(map(tuple, got.values()))  # several passes, one cut
    copies = df.unionByName(df).unionByName(spark.createDataFrame([(None, twice), (1, ITEMS[1][1] + " " + ITEMS[2][1])], "d bigint, t string"))
    once = sorted(map(repr, without_leaks(copies, items, "d", "t", "i", "t").collect()))
    assert len(once) == 6 and once == sorted(map(repr, without_leaks(copies, items, "d", "t", "i", "t", item_words=100).collect()))


def test_even_alterations():
    """Spans of exactly the allowed alterations, evenly spread, are found too."""
    for i, text in ITEMS:
        ws = text.split()
        n = len(ws) // 2 + len(ws) % 2
        for start in (0, len(ws) - n):
            part = ws[start : start + n]
            for j in range(7, n, 8):
                part[j - 1] = "zzz"
            assert i in dict(Scanner(ITEMS).leaks("q " * 9 + " ".join(part) + " q" * 9))


@pytest.mark.parametrize("m", [127, 200])
def test_many_words_at_once_near_an_end(m):
    """As many words as half of the item may bear, put in or missing in one place with fewer than a seed of unaltered words behind."""
    item = [f"u{i}y" for i in range(m)]
    n = m // 2 + m % 2
    s = Scanner([(1, " ".join(item))])
    for k in range(4, n // 8 + 1):
        for doc in (item[: n - 5] + ["zzz"] * k + item[n - 5 : n], item[:5] + ["zzz"] * k + item[5:n], item[: n - 5 - k] + item[n - 5 : n]):
            assert dict(s.leaks(" ".join(["q"] * 9 + doc + ["q"] * 9))).keys() == {1}, (k, len(doc))


def _widest_by_force(item, doc, altered=8):
    """Width of the widest span of the item with an alignment to the document that bears the alterations; all starts, all places, no bands."""
    loss, best = altered - 1, 0
    for a in range(len(item)):
        row = [0] * (len(doc) + 1)  # best score of item[a:j] ending before a place of the document
        for j in range(a, len(item)):
            new = [row[0] - loss]
            for q in range(1, len(doc) + 1):
                new.append(max(row[q - 1] + (1 if item[j] == doc[q - 1] else -loss), row[q] - loss, new[q - 1] - loss))
            row = new
            if max(row) >= 0:
                best = max(best, j + 1 - a)
    return best


def test_against_brute_force():
    rng = random.Random(5)
    held = 0
    for _ in range(250):
        few = [f"t{i}" for i in range(rng.choice((3, 12, 60)))]
        items = [(i, " ".join(rng.choices(few, k=rng.randrange(1, 34)))) for i in range(4)]
        doc = rng.choices(few + ["q", "r"], k=rng.randrange(0, 30))
        for _ in range(rng.randrange(3)):
            ws = rng.choice(items)[1].split()
            n = rng.randrange(1, len(ws) + 1)
            at = rng.randrange(len(ws) - n + 1)
            part = ws[at : at + n]
            for _ in range(rng.randrange(0, n // 7 + 2)):
                k = rng.randrange(len(part)) if part else 0
                part[k : k + rng.choice((0, 1, 1))] = rng.choice(([], ["z"], ["z", "y"]))
            k = rng.randrange(len(doc) + 1)
            doc[k:k] = part
        s = Scanner(items)
        want = {}
        for i, text in items:
            item = text.split()
            if (w := _widest_by_force(item, doc)) * 2 >= len(item):
                want[i] = w / len(item)
        assert dict(s.leaks(" ".join(doc))) == want
        held += len(want)
    assert held > 150


@pytest.mark.parametrize("size", [20, 41, 57, 90, 160, 233, 300])
def test_every_way_of_altering(size):
    """Half of an item with as many alterations as it may bear: replaced, missing, put in or mixed; at its start, its end, in one place or evenly."""
    rng = random.Random(size)
    others = [(i, " ".join(rng.choices(VOCAB, k=rng.randrange(5, 120)))) for i in range(20)]
    item = [f"u{i}y" for i in range(size)]
    s = Scanner([(99, " ".join(item)), *others])
    n = -(-size // 2)
    for where in ("start", "end", "middle", "even", "random"):
        for kind in ("replaced", "missing", "put in", "mixed"):
            k = n // 8
            at = rng.randrange(size - n + 1)
            part = item[at : at + n]
            spots = {"start": range(1, k + 1), "end": range(n - 1 - k, n - 1), "middle": range(n // 2, n // 2 + k), "even": range(7, 8 * k, 8), "random": rng.sample(range(1, n - 1), k)}[where]
            for x in sorted(spots, reverse=True):
                how = rng.choice(("replaced", "missing", "put in")) if kind == "mixed" else kind
                part[x : x + (how != "put in")] = [] if how == "missing" else ["zzz"]
            assert 99 in dict(s.leaks(" ".join(["q"] * 9 + part + ["q"] * 9))), (where, kind, k)


def test_words_put_in_near_the_start():
    rng = random.Random(8)
    for _ in range(40):
        item = [f"u{i}y" for i in range(160)]
        part = item[40:120]
        for x in sorted(rng.sample(range(1, 12), 10), reverse=True):
            part.insert(x, "zzz")
        assert dict(Scanner([(1, " ".join(item))]).leaks(" ".join(part))).keys() == {1}


def test_every_span():
    """Each copy is found, at its place, and what is left holds no item."""
    s, rng = Scanner(ITEMS), random.Random(9)
    parts = ["Lead words stand here."]
    for k in range(7):
        parts += [" ".join(_altered(ITEMS[k % 3][1].split(), 5, "replaced", rng)), "filler of no kind " * 6]
    text = "\n\n".join(parts)
    spans = s.all_spans(text)
    assert sorted(i for i, _, _ in spans) == [0, 0, 0, 1, 1, 2, 2]
    for a, e in sorted(((a, e) for _, a, e in spans), reverse=True):
        text = text[:a] + text[e:]
    assert not s.leaks(text) and "Lead words stand here." in text


def test_short_item_makes_no_short_seeds():
    s = Scanner([*ITEMS, (99, "five words are all there")])
    assert s.lengths[0] < 6 <= s.lengths[-1] and {int(x) for x, (i, _) in zip(s.seed, [*ITEMS, (99, "")], strict=True) if i != 99} == set(Scanner(ITEMS).lengths)
    assert dict(s.leaks("say: five words are all there, and no more")) == {99: 1.0}
