"""Languages of documents and of their stretches, by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector is the product of its letters' vectors, each permuted by its
place (bind and permute); a text's vector is the sum over its n-grams (bundle). A language's prototype is the bundle of its
training texts, without what all languages share. A text is compared with the prototypes by cosine.

As bundling is a sum, the product of a text's vector with a prototype is the sum of its n-grams' products with it. These
are worked out once for all n-grams in the hyperspace; a document then costs one table look-up per letter, over the
whole text, and sentences are sums over their part. The length of a text's vector is taken as that of a sum of
independent vectors, sqrt(D * sum of squared counts).

Sentences are labelled together: a change of language costs, so that a name or a foreign word does not make one, and a
stretch needs one full sentence of words. The languages are those that the labels of the data name. A text in none of them is
`und`: it takes part as a language whose product with any letter is a fixed share of what the languages have with their own texts.
Confidences are calibrated on training texts that the prototypes of other training texts label.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import _MOJIBAKE, _repair

#: Dimension of the hyperspace.
DIMENSION = 4096
#: Letters of an n-gram.
GRAM = 4
#: Labelled documents from which the prototypes are made, at most; those with the least hash of their id.
TRAIN_DOCUMENTS = 1500
#: Characters of a document that may serve for training.
TRAIN_CHARS = (200, 20_000)
#: Training documents that a language must have.
TRAIN_LEAST = 5
#: Mean advantage in log odds a letter that a stretch needs against the language around it, summed.
SWITCH = 14.0
#: Words of a full sentence.
SENTENCE_WORDS = 5
#: What a text in no known language is called, and its product with a letter, as a share of the least that a language has with its own texts on average.
UNKNOWN, UNKNOWN_SHARE = "und", 0.25

#: How labels spell the languages.
SPELLINGS = {
    "en": ("en", "eng", "english", "anglais", "englisch", "inglés", "ingles", "inglês", "inglese"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "francês", "francese"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "alemão", "tedesco"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian", "espagnol", "spanisch", "espanhol", "spagnolo"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugais", "portugiesisch", "portugués", "portoghese"),
    "it": ("it", "ita", "italian", "italiano", "italien", "italienisch"),
}
#: Codes and other short labels that name no language; any other label of two or three letters names one.
NO_LANGUAGE = ("mis", "mul", "n/a", "na", "nan", "nil", "tba", "tbd", "und", "xx", "xxx", "zxx")

_OTHER = 13  # codes that the letters of other scripts share by a hash
_A = 27 + _OTHER  # the blank, 26 letters, and the others
_BLANK = 0


def _letters() -> np.ndarray:
    """Code of each of the first 0x250 characters: 0 for none, 1 to 26 for Latin letters whatever their accent, more for others."""
    table = np.zeros(0x250, np.uint8)
    for i in range(0x250):
        c = unicodedata.normalize("NFKD", chr(i).lower())[:1]
        if c == "ß":
            c = "s"
        if chr(i).isalpha():
            table[i] = ord(c) - 96 if "a" <= c <= "z" else 27 + i % _OTHER
    return table


_CODE = _letters()


def _codes(points: np.ndarray) -> np.ndarray:
    """Codes of characters; signs of general and CJK punctuation are blanks."""
    code = _CODE[np.minimum(points, 0x24F)]
    far = points >= 0x250
    if far.any():
        sign = ((points >= 0x2000) & (points <= 0x2BFF)) | ((points >= 0x3000) & (points <= 0x303F)) | ((points >= 0xFF00) & (points <= 0xFF20))
        hashed = 27 + ((points.astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(7)) % np.uint64(_OTHER)
        code = np.where(far, np.where(sign, _BLANK, hashed), code).astype(np.uint8)
    return code


class Encoded(NamedTuple):
    """Texts one after the other as n-gram numbers, and the sentence and document of each n-gram."""

    grams: np.ndarray
    starts: np.ndarray  # of sentences, in grams
    ends: np.ndarray
    doc: np.ndarray  # of sentences
    words: np.ndarray  # of sentences
    chars: np.ndarray  # (sentences, 2): first and last character + 1 in the document as it stands


def _mended(text: str) -> tuple[str, np.ndarray | None]:
    """A text with broken encoding mended and, where it was, the place in the text as it stands of each of its characters and of its end."""
    if text.isascii() or not ("Ã" in text or "Â" in text):
        return text, None
    out, places, at = [], [], 0
    for m in _MOJIBAKE.finditer(text):
        new = _repair(m)
        if new != m.group():
            out += [text[at : m.start()], new]
            places += [np.arange(at, m.start()), np.full(len(new), m.start())]
            at = m.end()
    return "".join([*out, text[at:]]), np.concatenate([*places, np.arange(at, len(text) + 1)])


def _encode(texts: list[str]) -> Encoded | None:
    mended = [_mended(t) for t in texts]
    points = np.frombuffer("\n".join([*(t for t, _ in mended), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 for t, _ in mended], np.int64)
    if not len(points):
        return None
    base = np.concatenate([[0], np.cumsum(lengths)])
    # marks on letters and signs of no width are passed over
    seen = np.nonzero(~((points == 0xAD) | ((points >= 0x300) & (points <= 0x36F)) | ((points >= 0x200B) & (points <= 0x200F)) | (points == 0xFEFF)))[0]
    points = points[seen]
    code = _codes(points)
    space = points <= 32
    stop = (points == 46) | (points == 33) | (points == 63) | (points == 0x2026)
    after = np.concatenate([space[1:], [True]])
    closing = np.concatenate([np.isin(points[1:], (34, 39, 41, 0xBB, 0x201D)), [False]])
    end = (stop & (after | (closing & np.concatenate([after[1:], [True]])))) | (points == 10) | (points == 124) | (points == 0x3002) | (points == 0xFF01) | (points == 0xFF1F)
    keep = (code != _BLANK) | np.concatenate([[True], code[:-1] != _BLANK])
    at = np.nonzero(keep)[0]
    packed = code[at].astype(np.int64)
    unit = np.cumsum(np.concatenate([[0], end[:-1]]))  # sentence of each character
    n = int(unit[-1]) + 1
    grams = np.zeros(max(0, len(packed) - GRAM + 1), np.int64)
    for k in range(GRAM):
        grams = grams * _A + packed[k : k + len(grams)]
    of = unit[at[: len(grams)]]
    same = of == unit[at[GRAM - 1 : GRAM - 1 + len(grams)]]
    grams, of = grams[same], of[same]
    count = np.bincount(of, minlength=n)
    stops = np.cumsum(count)
    first = np.nonzero(np.concatenate([[True], end[:-1]]))[0]
    last = np.concatenate([first[1:], [len(points)]])
    begin = (code != _BLANK) & np.concatenate([[True], code[:-1] == _BLANK])
    begin |= ((points >= 0x3040) & (points <= 0x30FF)) | ((points >= 0x3400) & (points <= 0x9FFF))  # scripts without blanks: each sign counts
    words = np.bincount(unit[begin], minlength=n)
    first, last = seen[first], seen[last - 1] + 1
    doc = np.searchsorted(base, first, "right") - 1
    chars = np.stack([first - base[doc], np.minimum(last, base[doc + 1] - 1) - base[doc]], 1)
    for i, (_, places) in enumerate(mended):
        if places is not None:
            chars[doc == i] = places[chars[doc == i]]
    return Encoded(grams, stops - count, stops, doc, words, chars)


@dataclass
class Profiles:
    """The languages and, for the n-grams of the training texts, their products with each prototype."""

    languages: list[str]
    grams: np.ndarray  # sorted
    products: np.ndarray  # n-grams x languages
    scale: float  # from sums of products to log odds, of sentences side by side
    sure: float  # from log odds to those of confidences
    floor: float  # product of a letter with an unknown language
    _table: np.ndarray | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    @property
    def table(self) -> np.ndarray:
        """The products of all n-grams of the hyperspace; 0 for those that no training text has."""
        if self._table is None:
            self._table = np.zeros((_A**GRAM, len(self.languages)), np.float32)
            self._table[self.grams] = self.products
        return self._table


def _hyper(grams: np.ndarray, dimension: int, seed: int) -> np.ndarray:
    """Vectors of n-grams: letters' random vectors, permuted by place and multiplied."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (_A, dimension))
    out = np.ones((len(grams), dimension), np.int8)
    for k in range(GRAM):
        digit = grams // _A ** (GRAM - 1 - k) % _A
        out *= np.roll(letters, k, axis=1)[digit]
    return out


def _products(grams: np.ndarray, counts: np.ndarray, dimension: int, seed: int) -> np.ndarray:
    """The product of each n-gram's vector with the prototypes that the counts (n-grams x languages) bundle. Vectors are made a part at a time."""
    weight = np.sqrt(counts / np.maximum(counts.sum(0), 1)).astype(np.float32)  # square roots keep frequent n-grams from drowning the others
    protos = np.zeros((dimension, counts.shape[1]), np.float32)
    for a in range(0, len(grams), 4096):
        protos += _hyper(grams[a : a + 4096], dimension, seed).T.astype(np.float32) @ weight[a : a + 4096]
    protos -= protos.mean(1, keepdims=True) if counts.shape[1] > 1 else 0
    protos /= np.maximum(np.linalg.norm(protos, axis=0), 1e-9)
    return np.concatenate([_hyper(grams[a : a + 4096], dimension, seed).astype(np.float32) @ protos for a in range(0, len(grams), 4096)]) / np.sqrt(dimension)


def train(texts: list[str], labels: list[str], dimension: int = DIMENSION, seed: int = 20, rounds: int = 3, least: int = TRAIN_LEAST) -> Profiles | None:
    """Prototypes from labelled texts, of which some labels may be wrong: sentences that the prototypes of a round give to another
    language than their label are left out in the next. A language with fewer than `least` texts is no language, nor is a label most of whose sentences
    the others' prototypes claim."""
    languages = sorted(x for x in set(labels) if labels.count(x) >= least) or sorted(set(labels))
    kept = [i for i, x in enumerate(labels) if x in languages]
    texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
    enc = _encode(texts)
    if enc is None or not languages or not len(enc.grams):
        return None
    grams, inverse = np.unique(enc.grams, return_inverse=True)
    length = enc.ends - enc.starts
    sentence = np.repeat(np.arange(len(length)), length)
    label = np.array([languages.index(x) for x in labels])[enc.doc]

    def learned(ok: np.ndarray) -> np.ndarray:
        counts = np.zeros((len(grams), len(languages)))
        mine = ok[sentence]
        np.add.at(counts, (inverse[mine], label[sentence[mine]]), 1)
        return _products(grams, counts, dimension, seed)

    def summed(table: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(np.vstack([table[inverse], np.zeros((1, table.shape[1]))]), np.minimum(enc.starts, len(inverse)), axis=0)
        sums[enc.starts == enc.ends] = 0
        return sums

    trusted = length > 0
    for _ in range(rounds):
        table = learned(trusted)
        sums = summed(table)
        trusted = (sums.argmax(1) == label) & (length > 0)
    held = np.bincount(label[trusted], length[trusted], len(languages)) / np.maximum(np.bincount(label, length, len(languages)), 1)
    if len(languages) > 1 and (held < 0.5).any() and (held >= 0.5).any():  # labels that name none
        good = {x for x, h in zip(languages, held, strict=True) if h >= 0.5}
        some = [i for i, x in enumerate(labels) if x in good]
        return train([texts[i] for i in some], [labels[i] for i in some], dimension, seed, rounds, least)
    own = sums[np.arange(len(label)), label]
    letters = np.bincount(label[trusted], length[trusted], len(languages))
    floor = UNKNOWN_SHARE * float((np.bincount(label[trusted], own[trusted], len(languages)) / np.maximum(letters, 1))[letters > 0].min()) if trusted.any() else 0.0
    # log odds: a scale by which the mean margin a letter of true over best other is one half
    scale, sure = 1.0, 1.0
    if len(languages) > 1 and trusted.any():
        other = np.where(np.arange(len(languages)) == label[:, None], -np.inf, sums).max(1)
        scale = 0.5 / max(1e-6, float((own - other)[trusted].sum() / length[trusted].sum()))
        sure = _calibrated(enc, label, trusted, learned, summed, scale, floor)
    return Profiles(languages, grams, table.astype(np.float32), scale, sure, floor)


def _calibrated(enc: Encoded, label: np.ndarray, trusted: np.ndarray, learned, summed, scale: float, floor: float) -> float:
    """What log odds are multiplied by to be those of confidences: the value under which the sentences of one half of the texts, labelled by the prototypes of the other
    half, are most likely. Texts that as a whole go to another language than their label don't count; a small share of the sentences is taken to be labelled wrongly."""
    half = enc.doc % 2 == 0
    sums = np.where(half[:, None], summed(learned(trusted & ~half)), summed(learned(trusted & half))) * scale
    docs = int(enc.doc[-1]) + 1
    whole = np.stack([np.bincount(enc.doc, sums[:, k], docs) for k in range(sums.shape[1])], 1)
    mine = (whole.argmax(1)[enc.doc] == label) & (enc.words >= SENTENCE_WORDS)
    if not mine.any():
        return 1.0
    sums = np.concatenate([sums, ((enc.ends - enc.starts) * floor * scale)[:, None]], 1)
    rows, truth = sums[mine] - sums[mine].max(1, keepdims=True), label[mine]

    def likelihood(factor: float) -> float:
        odds = np.exp(np.clip(rows * factor, -700, 0))
        return float(np.log(0.99 * odds[np.arange(len(truth)), truth] / odds.sum(1) + 0.01 / rows.shape[1]).sum())

    return max((float(f) for f in np.geomspace(0.02, 2.0, 47)), key=likelihood)


def _viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each sentence in a row, where a change costs `switch`."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - switch) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def stretches(texts: list[str], profiles: Profiles, switch: float = SWITCH, least: int = SENTENCE_WORDS) -> list[tuple[int, int, int, int, str, float, int, float]]:
    """(text, number, first character, last character + 1, language, confidence, words, cosine) of the stretches of each text; the cosine of a stretch in no known
    language is that with the nearest one."""
    enc = _encode(texts)
    if enc is None or not len(enc.grams):
        return []
    k = len(profiles.languages)
    n = len(enc.starts)
    sums = np.zeros((n, k + 1), np.float32)
    real = np.nonzero(enc.ends > enc.starts)[0]
    sums[real, :k] = np.add.reduceat(profiles.table[enc.grams], enc.starts[real], axis=0)
    sums[:, k] = (enc.ends - enc.starts) * np.float32(profiles.floor)
    names = [*profiles.languages, UNKNOWN]
    prose = enc.words >= least
    out = []
    bounds = np.searchsorted(enc.doc, np.arange(len(texts) + 1))
    logs = sums * profiles.scale
    for t in range(len(texts)):
        a, b = bounds[t], bounds[t + 1]
        mine = np.nonzero(prose[a:b])[0] + a
        if not len(mine):
            continue
        rows = logs[mine]
        path = rows.argmax(1)
        if (path != path[0]).any():
            path = _viterbi(rows, switch)
        cuts = np.concatenate([[0], np.nonzero(np.diff(path))[0] + 1, [len(path)]])
        for number, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 1):
            total, lang = rows[i:j].sum(0), path[i]
            odds = np.exp(np.clip((total - total[lang]) * profiles.sure, -700, 50))
            grams = np.concatenate([enc.grams[enc.starts[s] : enc.ends[s]] for s in mine[i:j]])
            length = np.sqrt(float((np.unique(grams, return_counts=True)[1].astype(float) ** 2).sum())) or 1.0
            first, last = enc.chars[mine[i], 0], enc.chars[mine[j - 1], 1]
            cosine = float(sums[mine[i:j], :k].sum(0)[lang if lang < k else slice(None)].max() / length)
            out.append((t, number, int(first), int(last), names[lang], float(1 / odds.sum()), int(enc.words[mine[i:j]].sum()), cosine))
    return out


def label_language(c: Column) -> Column:
    """The language that a label names, in any spelling, with or without a country; null if none. A code that is not listed stands for itself."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"(?U)[-_ (].*$", "")
    out = F.when(bare.rlike("^[a-z]{2,3}$") & ~bare.isin(*NO_LANGUAGE), bare)
    for lang, names in SPELLINGS.items():
        out = F.when(bare.isin(*names), F.lit(lang)).otherwise(out)
    return out


def label_languages(c: Column) -> Column:
    """The distinct languages that a label names, sorted; several may be joined by comma, semicolon, slash, plus, bar or "and"."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?i)[,;/|+&]|\s+and\s+"), label_language)
    return F.sort_array(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())))


def fit_profiles(documents: DataFrame, doc_id: str, text: str, lang: str, documents_used: int = TRAIN_DOCUMENTS, dimension: int = DIMENSION) -> Profiles | None:
    """Prototypes from a bounded sample of `documents_used` labelled documents of TRAIN_CHARS characters, drawn by a hash of their id so that each
    language has about the same number. None where no text is labelled. The labels are counted first, then the texts are read once."""
    rows = documents.select(F.col(doc_id).alias("d"), label_language(F.col(lang)).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull())
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # at most one row a language
    if not sizes:
        return None
    often = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    drawn = F.pmod(F.xxhash64("d"), F.lit(2**52)).cast("double") * often[F.col("l")]
    # about four times the sample passes this bound, whatever the size of the table, so that tasks send few texts to the driver
    few = F.col("at") < 4.0 * documents_used / len(sizes) * 2**52
    chosen = rows.withColumn("at", drawn).where(few).where(F.length("t").between(*TRAIN_CHARS)).sort("at", "d").limit(documents_used)
    got = chosen.select("d", "l", "t").collect()  # bounded: documents_used texts of TRAIN_CHARS[1] characters at most
    got.sort(key=lambda r: (r.l, str(r.d)))
    return train([r.t for r in got], [r.l for r in got], dimension) if got else None


def language_stretches(documents: DataFrame, doc_id: str, text: str, profiles: Profiles | None, switch: float = SWITCH, least: int = SENTENCE_WORDS) -> DataFrame:
    """(doc_id, stretch, first_char, end_char, lang, confidence, words, cosine): the stretches in one language of every document, over whole texts.

    Null, empty and unprosaic texts (tables, records, no sentence of `least` words) give no row. Characters count from 0 in the text as
    it stands. Stretches in no language of the profiles are `und`. The documents are read once and not shuffled; a document given twice gives its rows twice.
    """
    schema = f"doc_id {dict(documents.dtypes)[doc_id]}, stretch int, first_char bigint, end_char bigint, lang string, confidence double, words bigint, cosine double"
    texts = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.length("t") > 0)
    spark = documents.sparkSession
    if profiles is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, all_texts, i = b["d"], b["t"].tolist(), 0
            while i < len(all_texts):
                j, size = i, 0
                while j < len(all_texts) and (j == i or size + len(all_texts[j]) < 200_000):
                    size += len(all_texts[j])
                    j += 1
                rows = stretches(all_texts[i:j], shared.value, switch, least)
                yield pd.DataFrame([(ids.iloc[i + r[0]], *r[1:]) for r in rows], columns=["doc_id", "stretch", "first_char", "end_char", "lang", "confidence", "words", "cosine"])
                i = j

    return texts.mapInPandas(run, schema)


def mislabelled(documents: DataFrame, doc_id: str, text: str, lang: str, found: DataFrame) -> DataFrame:
    """(doc_id, lang): one row per language of each document whose label does not name exactly its languages. found:
    language_stretches of the documents. Stretches in no known language and documents without any other are no case."""
    real = found.where(F.col("lang") != UNKNOWN).groupBy("doc_id").agg(F.sort_array(F.collect_set("lang")).alias("real"))
    said = documents.select(F.col(doc_id).alias("doc_id"), label_languages(F.col(lang)).alias("said"))
    wrong = real.join(said, "doc_id").where(F.col("real") != F.col("said"))
    return wrong.select("doc_id", F.explode("real").alias("lang")).distinct()
