import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrain.llm import language as L

SENTENCES = {
    "en": ["The lamp feels sturdy and my sister wants one too.", "Delivery took five days and everything was packed with care.", "We will see how it behaves during the winter.", "I have used this for weeks and it still works."],
    "de": ["Die Lampe ist stabil und meine Schwester möchte auch eine.", "Die Lieferung kam nach fünf Tagen und war gut verpackt.", "Mal sehen, wie sie sich im Winter verhält.", "Ich benutze das Gerät seit Wochen und bin zufrieden."],
    "fr": ["La lampe est solide et ma sœur en veut une aussi.", "Le colis est arrivé en cinq jours et tout était bien emballé.", "On verra comment elle se comporte pendant l'hiver.", "J'utilise cet appareil depuis des semaines et il marche."],
    "ru": ["Лампа очень крепкая, сестра тоже хочет такую.", "Посылка пришла через пять дней, всё было упаковано.", "Посмотрим, как она поведёт себя зимой.", "Пользуюсь уже несколько недель, и всё работает."],
    "ja": ["このランプはとても丈夫で、妹も欲しがっています。", "荷物は五日で届き、とても丁寧に包まれていました。", "冬の間にどうなるか、様子を見てみます。", "何週間も使っていますが、今も問題なく動いています。"],
}
SCHEMA = "doc_id long, text string, lang string, label string, segment int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, "clash", 1) for i, t, l in rows], SCHEMA)


@pytest.fixture(scope="module")
def profiles(spark):
    rng, rows = random.Random(1), []
    for l, ss in SENTENCES.items():
        for _ in range(12):
            label = l if rng.random() > 0.15 else rng.choice(list(SENTENCES))
            rows.append((len(rows), " ".join(rng.sample(ss, 3)), label.upper()))
    return L.fit(docs(spark, rows))


def test_found(spark, profiles):
    s = SENTENCES
    rows = [
        (1, s["en"][0], "en-US"), (2, s["en"][0], None), (3, s["de"][1], "fr"), (4, f"{s['en'][0]} {s['fr'][1]}", "English"), (5, f"{s['de'][0]} Cool gadget!", " de "), (6, "Too short", None),
        (7, None, "en"), (8, "", None), (9, s["ja"][1], "ja_JP"), (10, s["ja"][1] + s["ja"][2], "und"), (11, "Posmotrim, kak ona povedyot sebya zimoy.", "??"), (12, s["ru"][0] + "\n" + s["de"][2] + " / " + s["en"][2], "ru"),
        (13, "12345 67890 !!! ??? 11 22 33 44 55 66 77", None), (14, (s["en"][1] + " ") * 3000 + s["fr"][0], "en"), (15, "<p>" + s["fr"][3] + "</p> #musthave", "French"),
    ]
    got = {(r.doc_id, r.lang) for r in L.mislabelled(docs(spark, rows), profiles).collect()}
    assert got == {(2, "en"), (3, "de"), (4, "en"), (4, "fr"), (10, "ja"), (11, "ru"), (12, "ru"), (12, "de"), (12, "en"), (14, "en"), (14, "fr")}


def test_confidence_and_repeated_rows(spark, profiles):
    d = L.document_languages(docs(spark, [(1, SENTENCES["de"][0], None)] * 2), profiles).collect()
    assert len(d) == 1 and 0 < d[0].confidence <= 1 and d[0].lang == "de"


def test_held_out(profiles):
    held = {"en": "My brother wants to order the kettle as well.", "de": "Nach einem Monat ist der Griff leider abgebrochen.", "fr": "Je suis très contente de cette machine à café.", "ru": "Через месяц она сломалась, и никто не отвечает."}
    for l, s in held.items():
        assert profiles.languages[int(profiles.distances([s])[0][0].argmin())] == l


def plain_distance(p, sentence):
    n = Counter()
    for w in L._WORD.findall(sentence.lower()):
        m = f"_{w}_"
        for k in range(1, 6):
            n.update(m[i : i + k] for i in range(len(m) - k + 1))
    n.pop("_", None)
    far = np.zeros(len(p.owner))
    for own, (g, _) in enumerate(n.most_common()):
        r = p.rank[p.index.get(g, len(p.index))]
        far += np.where(r >= p.size, p.size, abs(r - min(own, p.size)))
    far = far / max(len(n), 1) / p.size if n else np.ones(len(p.owner))
    return [min(f for f, o in zip(far, p.owner) if o == j) for j in range(len(p.languages))]


@pytest.mark.parametrize("at_once", [1, 200, 1 << 20])
def test_distances_equal_the_plain_count(profiles, at_once):
    ss = [x for v in SENTENCES.values() for x in v] + ["", "12 !!", "a", "a a a b", "Ein _Wort_ mit Marken", "straße İstanbul", " ".join(SENTENCES["en"]) * 40, SENTENCES["de"][0]]
    got, whole = profiles.distances(ss, at_once)
    assert np.allclose(got, [plain_distance(profiles, x) for x in ss]) and list(whole) == [L.is_whole(x) for x in ss]


def test_sentences_in_the_jvm(spark):
    texts = ["One here. Two there!\u00a0Three? \u3000 Four", "a / b | c \u2022 d", "\u4e00\u3002\u4e8c\uff01\u4e09", "endHere.Next one", "<b " + "x" * 500 + ">bold</b> #tag @me https://a.b/c?d=e (12) (ab)", "", "  \n\r\n ", '"Quoted." \'yes\'', "caf\u00e9.\u00c9t\u00e9 ici", "Dr. <a <b> c"]
    got = [r.s for r in spark.createDataFrame(enumerate(texts), "i int, t string").select("i", L.sentence_column(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [L.sentences(t) for t in texts]


def test_empty(spark, profiles):
    assert L.mislabelled(docs(spark, []), profiles).count() == 0
    assert L.mislabelled(docs(spark, [(1, SENTENCES["en"][0], None)])).count() == 0  # nothing to fit on: no language


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("EN", " de ", "pt_BR", "fr-CA", "Dutch", "jpn", "unknown", "??", "", None, "xx", "und")], "l string")
    assert [r[0] for r in df.select(L.label_meaning(df.l)).collect()] == ["en", "de", "pt", "fr", "nl", "ja", None, None, None, None, None, None]


def test_fit_reads_whole_texts_of_the_sampled_documents(spark, monkeypatch):
    seen, real = [], L.Profiles.fit.__func__
    monkeypatch.setattr(L.Profiles, "fit", classmethod(lambda cls, by, size: (seen.append({k: list(v) for k, v in by.items()}), real(cls, by, size))[1]))
    body = "The quick brown fox jumps over the lazy dog and goes home again. "
    rows = [(i, "en", body * 70 + f"At the very end stands sentence number {i} of this document here.") for i in range(300)]
    L.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"), rounds=1)
    assert sum("At the very end" in s for s in seen[-1]["en"]) == 300
