import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillscope.llm import language as lg

PARTS = {
    "en": (["the old bridge", "a small letter", "every garden", "this clock"], ["was never finished", "is hidden behind the wall", "has not been seen since the flood", "would follow them"], ["in the early spring", "when the lights went out", "for most of the year"]),
    "de": (["die alte Brücke", "der kleine Brief", "das Fenster", "jeder Garten"], ["ist noch nicht fertig", "war gestern sehr schön", "wird niemals verkauft", "beschreibt den Nachbarn"], ["neben dem Ofen", "auf der zweiten Seite", "nach der Sitzung"]),
    "es": (["el puente viejo", "la carta pequeña", "el jardín", "cada reloj"], ["no está terminado", "era difícil de explicar", "nunca olvida la lluvia", "mira al vecino"], ["al principio de la primavera", "detrás de la biblioteca", "después de la reunión"]),
    "fr": (["le vieux pont", "la petite lettre", "le jardin", "chaque horloge"], ["n'est pas fini", "était vraiment beau", "ne quitte jamais la maison", "décrit le voisin"], ["au début du printemps", "derrière la bibliothèque", "pendant la nuit"]),
    "it": (["il vecchio ponte", "la piccola lettera", "il giardino", "ogni orologio"], ["non è finito", "era difficile da spiegare", "dimentica sempre la pioggia", "descrive il vicino"], ["all'inizio della primavera", "dietro la biblioteca", "durante la notte"]),
    "nl": (["de oude brug", "de kleine brief", "het raam", "elke tuin"], ["is nog niet klaar", "was gisteren heel mooi", "wordt nooit verkocht", "beschrijft de buurman"], ["naast de oven", "op de tweede bladzijde", "na de vergadering"]),
    "pt": (["a ponte velha", "a carta pequena", "o jardim", "cada relógio"], ["não está pronto", "era difícil de explicar", "nunca esquece a chuva", "descreve o vizinho"], ["no começo da primavera", "atrás da biblioteca", "durante a noite"]),
    "ru": (["старый мост", "маленькое письмо", "каждый сад", "этот голос"], ["ещё не готов", "было трудно объяснить", "никогда не забывает дождь", "описывает соседа"], ["ранней весной", "рядом с печью", "после собрания"]),
}


def sentence(rnd, lang):
    s = " ".join(rnd.choice(p) for p in PARTS[lang])
    return s[0].upper() + s[1:] + rnd.choice(".!?…")


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(6)
    texts = [(" ".join(sentence(rnd, x) for _ in range(4)), x) for x in lg.LANGUAGES for _ in range(60)]
    labels = [x if rnd.random() > 0.15 else rnd.choice(lg.LANGUAGES) for _, x in texts]
    return lg.LanguageModel.fit([t for t, _ in texts], labels)


def test_held_out_accuracy(model):
    rnd = random.Random(7)
    truth = [rnd.choice(lg.LANGUAGES) for _ in range(400)]
    got = model.infer([" ".join(sentence(rnd, x) for _ in range(2)) for x in truth])
    assert np.mean([g["langs"] == [x] for g, x in zip(got, truth)]) > 0.98


def test_mixed_texts_and_segments(model):
    rnd = random.Random(8)
    good = 0
    for _ in range(100):
        a, b = rnd.sample(lg.LANGUAGES, 2)
        first, second = " ".join(sentence(rnd, a) for _ in range(3)), " ".join(sentence(rnd, b) for _ in range(2))
        got = model.infer([first + "\n\n" + second])[0]
        good += sorted(got["langs"]) == sorted([a, b]) and [s["lang"] for s in got["segments"]] == [a, b] and abs(got["segments"][1]["start"] - len(first) - 2) <= 1
    assert good >= 95


def test_names_links_and_quotes_are_no_language(model):
    text = "Die alte Brücke ist noch nicht fertig neben dem Ofen. Der kleine Brief war gestern sehr schön “quiet orchard”. #the #garden @was https://the.old/bridge was Shumagorath"
    assert model.infer([text])[0]["langs"] == ["de"]


def test_loops_weigh_once(model):
    text = "The old bridge was never finished in the early spring. " + "vakobef descrive " * 60
    assert model.infer([text])[0]["langs"] == ["en"]


def test_odd_texts(spark, model):
    texts = [None, "", "   ", "12345 !!", "🎻" * 50, "İİİ " * 20, "a" * 200_000, "the old bridge was never finished in the early spring " * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, t string, langs string")
    got = {r["i"]: r for r in lg.infer_languages(df, {"i": F.col("i")}, F.col("t"), model).collect()}
    assert len(got) == len(texts) and all(got[i]["langs"] == [] and got[i]["confidence"] == 0 for i in range(5)) and got[7]["langs"] == ["en"]
    assert lg.infer_languages(df.limit(0), {"i": F.col("i")}, F.col("t"), model).count() == 0


def test_labels(spark):
    cases = {"en": "en", " EN": "en", "en-GB": "en", "pt_BR": "pt", "English": "en", "deu": "de", "und": None, "": None, "N/A": None, None: None, "unknown": None}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert [r[0] for r in df.select(lg.normal_label(F.col("l"))).collect()] == list(cases.values())


def test_fit_from_a_table(spark):
    rnd = random.Random(9)
    rows = [(" ".join(sentence(rnd, x) for _ in range(4)), x) for x in lg.LANGUAGES for _ in range(40)] + [(None, "en"), ("x", None)]
    model = lg.fit_model(spark.createDataFrame(rows, "t string, l string"), F.col("t"), F.col("l"), train_rows=20)
    assert model.infer([sentence(rnd, "nl") + " " + sentence(rnd, "nl")])[0]["langs"] == ["nl"]
    with pytest.raises(ValueError):
        lg.fit_model(spark.createDataFrame([], "t string, l string"), F.col("t"), F.col("l"))
