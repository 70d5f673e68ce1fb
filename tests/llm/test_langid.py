import math
import random

import numpy as np

from llm_helpers import PROSE, odd_rows, plain
from tramline.llm import langid
from tramline.llm.catalog import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    told = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op9_language_id"](spark, folder).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(told) and len(held) > 200
    assert sum(r["lang_pred"] == told[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_held_out_labels_are_not_used(spark, documents):
    rows = [(i, PROSE[i % 40:] if i % 2 else "Der alte Mann ging langsam durch die Stadt und sah die Häuser"[i % 20:],
             "en" if i % 2 else "de", "a") for i in range(200)]
    folder = documents(rows)
    before = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, folder).collect()}
    other = documents([(i, t, "xx" if before[i]["held_out"] else g, s) for i, t, g, s in rows], "other")
    after = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, other).collect()}
    assert before == after and {r["lang_pred"] for r in after.values()} == {"de", "en"}


def test_distant_text_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    names, scores, out = model.judge(["Это совсем другой язык и другая азбука", "1234", None, "the and thing of the"])
    assert list(out) == [True, True, True, False] and names[1:3] == ["und", "und"] and scores[1] == 0


UNLEARNED = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
          "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i "
          "sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, "
          "en behoren zich jegens elkander in een geest van broederschap te gedragen.",
}


def test_unlearned_languages_and_random_letters_are_rejected(spark):
    """In a script that was learned too; own documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(3)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower = "abcdefghijklmnopqrstuvwxyz"
    junk = [*UNLEARNED.values(), *[draw(lower + "     ", n) for n in (200, 1000, 5000)],
            *[draw(lower + lower.upper() + "0123456789+/", n) for n in (300, 3000)]]
    assert model.judge(junk)[2].all()
    own = [r["text"] for r in docs.filter(langid.held_out()).filter("lang is not null").select("text").collect()]
    assert model.judge(own)[2].mean() <= 0.01


def test_nearest_centroid_against_plain_cosines(spark):
    """Every centroid's cosine from plain counts of n-grams; equal cosines go to the first."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    texts = [r["text"] for r in docs.filter("text is not null").select("text").collect()][:60]
    names, scores, out = model.judge(texts)
    for text, name, score, gone in zip(texts, names, scores, out):
        grams = langid.counts(text)
        vector = [math.log1p(int(n)) * float(w) for n, w in zip(grams, model.idf)]
        size = math.sqrt(sum(v * v for v in vector))
        if not size:
            assert name == "und" and gone
            continue
        cosines = [sum(v * float(c) for v, c in zip(vector, row) if v) / size for row in model.centroids]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        assert abs(cosines[best] - score) < 1e-5
        assert cosines[best] - max(c for c, g in zip(cosines, model.languages) if g == name) < 1e-5
    twice = langid.Model(model.idf, ["aa", "bb"], np.stack([model.centroids[0]] * 2), np.zeros((2, langid.LENGTHS)))
    assert twice.judge(texts[:5])[0] == ["aa"] * 5


def test_odd_rows(spark, odd, empty, documents):
    rows = plain(QUERIES["op9_language_id"](spark, odd))
    assert len(rows) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by_id[i]["lang_pred"] for i in (1, 2, 3, 13)] == ["und"] * 4
    assert plain(QUERIES["op9_language_id"](spark, empty)) == []
    bare = documents([(1, PROSE, None, "a")], "bare")
    assert [r["lang_pred"] for r in plain(QUERIES["op9_language_id"](spark, bare))] == ["und"]
