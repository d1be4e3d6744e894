import random

import numpy as np
import pytest

from tidemark.llm import langid

SENT = {
    "en": ["the old bridge near the harbour was closed because of the strong wind", "nobody in the village had seen such a large ship before that evening", "we should read the whole report again before the meeting starts tomorrow", "she told her brother that the garden would need more water this summer"],
    "fr": ["le vieux pont près du port a été fermé à cause du vent très fort", "personne dans le village n'avait vu un navire aussi grand avant ce soir", "nous devons relire tout le rapport avant que la réunion ne commence demain", "elle a dit à son frère que le jardin aurait besoin de plus d'eau cet été"],
    "de": ["die alte Brücke am Hafen wurde wegen des starken Windes gesperrt", "niemand im Dorf hatte vor diesem Abend ein so großes Schiff gesehen", "wir sollten den ganzen Bericht noch einmal lesen bevor die Sitzung beginnt", "sie sagte ihrem Bruder dass der Garten in diesem Sommer mehr Wasser braucht"],
    "es": ["el viejo puente cerca del puerto fue cerrado a causa del fuerte viento", "nadie en el pueblo había visto un barco tan grande antes de aquella tarde", "debemos leer otra vez todo el informe antes de que empiece la reunión mañana", "ella le dijo a su hermano que el jardín necesitaría más agua este verano"],
}


def _text(lang, n, rng):
    return " ".join(rng.choice(SENT[lang]).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def profiles():
    rng = random.Random(1)
    texts = [_text(x, 6, rng) for x in SENT for _ in range(8)]
    labels = [x for x in SENT for _ in range(8)]
    labels[0], labels[9] = "de", "en"  # two wrong labels
    return langid.train(texts, labels, 2048)


def _langs(text, profiles):
    return [(r[4], r[2], r[3]) for r in langid.stretches([text], profiles)]


def test_single_and_mixed(profiles):
    rng = random.Random(2)
    for x in SENT:
        assert [r[0] for r in _langs(_text(x, 1, rng), profiles)] == [x]
        assert [r[0] for r in _langs(_text(x, 3, rng).upper(), profiles)] == [x]
        assert [r[0] for r in _langs(_text(x, 3, rng).encode().decode("latin-1"), profiles)] == [x]
    mixed = _text("en", 2, rng) + " " + _text("fr", 1, rng) + "\n\n" + _text("de", 2, rng)
    got = _langs(mixed, profiles)
    assert [g[0] for g in got] == ["en", "fr", "de"]
    assert mixed[got[1][1] : got[1][2]].strip().lower().startswith(tuple(s[:10].lower() for s in SENT["fr"]))


def test_no_language_from_words_and_tables(profiles):
    en = _text("en", 3, random.Random(4))
    assert {g[0] for g in _langs(en + " (Netzwerksicherheit) " + en, profiles)} == {"en"}
    assert {g[0] for g in _langs(en.replace("bridge", "Brücke am Hafen"), profiles)} == {"en"}
    for t in ("", " ", "| Glon | 12.8 | 69.8 |\n| Quax Tools | 24.3 | 51.1 |", '{"id": 5703, "score": 0.247}', "12 34 56."):
        assert _langs(t, profiles) == []


def test_held_out(profiles):
    rng = random.Random(6)
    texts = [(x, _text(x, 2, rng)) for x in SENT for _ in range(20)]
    right = sum({g[0] for g in _langs(t, profiles)} == {x} for x, t in texts)
    assert right / len(texts) >= 0.95


def test_labels(spark):
    said = ["en", "EN-gb", " English ", "fr_CA", "Deutsch", "deu", "es-MX", "xx", "mul", "", None, "en, fr", "de/en"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    got = [r[0] for r in df.select(langid.label_languages(df.s)).collect()]
    assert got == [["en"], ["en"], ["en"], ["fr"], ["de"], ["de"], ["es"], [], [], [], [], ["en", "fr"], ["de", "en"]]


def test_table(spark):
    rng = random.Random(7)
    rows = [(i, _text(x, 6, rng), x, "q") for i, x in enumerate([*SENT] * 6)]
    rows += [(100, _text("fr", 5, rng), "en", "q"), (101, _text("en", 3, rng) + "\n" + _text("de", 3, rng), "en", "q"), (102, _text("es", 2, rng), None, "q"), (103, None, "en", "q"), (104, "", "en", "q"), (105, "| a | 1 |", "fr", "q"), (106, _text("de", 4000, rng), "German", "q")]
    df = spark.createDataFrame(rows, "doc bigint, t string, l string, lang string")
    fit = langid.fit_profiles(df, "doc", "t", "l", dimension=1024)
    found = langid.language_stretches(df, "doc", "t", fit)
    got = {tuple(r) for r in langid.mislabelled(df, "doc", "t", "l", found).collect()}
    assert got == {(100, "fr"), (101, "en"), (101, "de"), (102, "es")}
    assert langid.fit_profiles(df.limit(0), "doc", "t", "l") is None
    assert langid.language_stretches(df, "doc", "t", None).count() == 0
    assert langid.language_stretches(df.limit(0), "doc", "t", fit).count() == 0
    assert all(0 < r.confidence <= 1 for r in found.collect())


def test_unknown_languages(profiles):
    """Texts in languages that were not trained, also of other scripts, are `und`, alone and beside a known one."""
    foreign = {
        "ru": "Жила-была маленькая девочка, которая жила с бабушкой в домике у леса. Каждый день она ходила в деревню за хлебом и молоком для них обеих.",
        "fi": "Olipa kerran pieni tyttö, joka asui isoäitinsä kanssa mökissä metsän reunassa. Hän kävi joka päivä kylässä ostamassa leipää ja maitoa heille molemmille.",
        "tr": "Bir zamanlar ormanın kenarında büyükannesiyle birlikte yaşayan küçük bir kız vardı. Her gün köye gidip ikisi için ekmek ve süt alırdı.",
    }
    for t in foreign.values():
        assert {g[0] for g in _langs(t, profiles)} == {langid.UNKNOWN}
    en = _text("en", 4, random.Random(1))
    assert [g[0] for g in _langs(en + "\n" + foreign["ru"] * 3, profiles)] == ["en", langid.UNKNOWN]
    assert {g[0] for g in _langs("これは小さな女の子の物語です。彼女は毎日村へ行きました。", profiles)} == {langid.UNKNOWN}


def test_languages_of_the_data(spark):
    """A language that no list names is learned from its labels; codes for no language, labels with hardly a text and labels given at random make none."""
    sv = ["den gamla bron vid hamnen stängdes på grund av den starka vinden", "ingen i byn hade sett ett så stort skepp före den kvällen", "vi borde läsa hela rapporten en gång till innan mötet börjar i morgon", "hon sade till sin bror att trädgården skulle behöva mer vatten i sommar"]
    rng = random.Random(3)
    rows = [(_text(x, 6, rng), x) for x in SENT for _ in range(12)] + [(" ".join(rng.choice(sv).capitalize() + "." for _ in range(6)), "sv-SE") for _ in range(12)]
    rows += [(_text(x, 6, rng), odd) for odd in ("xx", "und", "qq") for x in SENT for _ in range(2)] + [(_text("en", 6, rng), "nl")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc bigint, t string, l string")
    fit = langid.fit_profiles(df, "doc", "t", "l", dimension=1024)
    assert fit.languages == ["de", "en", "es", "fr", "sv"]
    assert {r[4] for r in langid.stretches([" ".join(sv[:2]).capitalize() + "."], fit)} == {"sv"}
    wrong = {tuple(r) for r in langid.mislabelled(df, "doc", "t", "l", langid.language_stretches(df, "doc", "t", fit)).collect()}
    assert {d for d, _ in wrong} == set(range(60, 60 + 25))


def test_places_in_the_text_as_it_stands(profiles):
    """Characters count in the stored text, also after broken encoding, soft hyphens and loose accents."""
    rng = random.Random(5)
    fr = _text("fr", 3, rng).encode().decode("latin-1")
    en = _text("en", 3, rng).replace("bridge", "bri\xaddge").replace("village", "villa\u0301ge")
    text = "  " + fr + "\n" + en + "\n" + _text("de", 2, rng)
    (x, a, b), (y, c, d), (z, e, f) = _langs(text, profiles)
    assert (x, y, z) == ("fr", "en", "de")
    assert text[:a].strip() == "" and text[a:b].strip() == fr.strip() and text[c:d].strip() == en.strip() and f == len(text)


def test_confidence_is_what_it_says():
    """On short held-out stretches, stretches with a confidence of p are right in about p of all cases."""
    rng = random.Random(11)
    alphabet = "abcdefghij"
    words = {x: ["".join(rng.choices(alphabet[i : i + 7], k=rng.randrange(3, 7))) for _ in range(60)] for i, x in enumerate(("aa", "bb", "cc"))}
    made = lambda x, n: " ".join(rng.choice(words[x] if rng.random() < 0.6 else words[rng.choice(list(words))]) for _ in range(n)).capitalize() + "."
    fit = langid.train([" ".join(made(x, 7) for _ in range(12)) for x in words for _ in range(40)], [x for x in words for _ in range(40)], 2048)
    got = []
    for _ in range(3000):
        x = rng.choice(list(words))
        got += [(r[5], r[4] == x) for r in langid.stretches([made(x, 5)], fit)]
    p, right = np.array([g[0] for g in got]), np.array([g[1] for g in got])
    assert 0.6 < right.mean() < 0.999 and abs(p.mean() - right.mean()) < 0.05
    order = np.argsort(p)
    for part in np.array_split(order, 10):
        assert abs(p[part].mean() - right[part].mean()) < 0.15, (p[part].mean(), right[part].mean())
