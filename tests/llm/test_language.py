from __future__ import annotations

import random
import zlib

import numpy as np

from tidelens.llm import language
from tidelens.llm.language import keep_known, predict, temperature, train, vector

WORDS = {"en": "the of and to in that is was for with this".split(), "de": "der die und den von mit über nicht eine für sich".split(), "es": "el la de que y en los del por señor año".split()}


def corpus(n=240):
    random.seed(1)
    rows = []
    for i in range(n):
        lang = random.choice(sorted(WORDS))
        rows.append((i, " ".join(random.choice(WORDS[lang]) for _ in range(random.randint(5, 80))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus() + [(1000, None, "en"), (1001, "", None), (1002, "123 !? 日"[:6], None), (1003, "el año de la señor", None), (None, "the of and to in that", "de"), (1004, "the and " * 30000, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in predict(docs).collect()}
    assert len(got) == len(rows)
    for d, t, lang in rows:
        r = got[d]
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if d is not None and d < 1000:
            assert r.lang_pred == lang
    assert [got[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1003].lang_pred == "es" and got[None].lang_pred == "en" and got[1004].lang_pred == "en"
    kept = keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {1000, 1001, 1002}


def test_lang_of_held_out_rows_is_no_input(spark):
    rows = corpus(120)
    hidden = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 4 == 2 else lang) for d, t, lang in rows]
    a, b = (sorted(tuple(r) for r in predict(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()) for x in (rows, hidden))
    assert a == b


def test_training_finds_sparse_weights():
    idf = np.ones(language.FEATURES)
    rows = [vector(t.encode(), idf) for _, t, _ in corpus()]
    labels = np.array([sorted(WORDS).index(x) for _, _, x in corpus()])
    w = train(rows, labels, 3)
    assert (np.array([(x @ w[at]).argmax() for at, x in rows]) == labels).mean() > 0.99
    assert 0 < (w != 0).mean() < 0.2


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(20000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = (rng.random(20000)[:, None] > p.cumsum(1)).sum(1)
    assert abs(temperature(logits * 3, labels) - 3) < 0.15
    assert temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in predict(docs).collect()] == [("und", 0.0)] * 2
    assert predict(docs.limit(0)).count() == 0 and keep_known(docs.limit(0)).count() == 0


def test_without_a_model_only_texts_without_letters_go(spark):
    docs = spark.createDataFrame([(1, "some words", None, 0.1), (2, None, None, 0.1), (3, "12 !", None, 0.1)], "doc_id long, text string, lang string, score double")
    kept = keep_known(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_many_copies_of_one_row(spark):
    row = (4, "the of and to in that is was", "en")  # not held out
    assert zlib.crc32(b"4") % 4 != 2
    others = [(10 + d, t, x) for d, t, x in corpus(400) if x == "de"] + [(1000 + d, t, x) for d, t, x in corpus(300) if x == "en"]
    for more in ([], others):
        rows = [row] * 10_000 + more
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
        got = {(r.doc_id, r.lang_pred) for r in predict(docs).collect()}
        assert got == {(d, x) for d, _, x in rows}


def test_a_rare_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 200)
    monkeypatch.setattr(language, "LEAST", 10)
    rows = [r for r in corpus(6000) if r[2] != "es"] + [(10_000 + i, t, x) for i, (_, t, x) in enumerate(corpus(60)) if x == "es"]
    got = {r.doc_id: r.lang_pred for r in predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[d] == x for d, _, x in rows) > 0.99 * len(rows) and all(got[d] == "es" for d, _, x in rows if x == "es")


def test_long_texts_are_counted_whole(monkeypatch):
    text = (" ".join(WORDS["es"]) + " İß ").encode() * 9
    whole = language.counts(text)
    monkeypatch.setattr(language, "STEP", 7)
    assert (language.counts(text) == whole).all()
