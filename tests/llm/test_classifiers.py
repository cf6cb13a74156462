"""Operators 1, 3 and 10: accuracy on held-out rows, and defined results on edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import language, quality, toxicity
from lattica.llm.queries import op1_quality, op3_toxicity, op10_language

SF = "/root/testdata/sf0.01"


def held_out_accuracy(spark, query, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = query(spark, SF).where("held_out").join(labels, "doc_id").select("predicted", column).toPandas()
    return (rows["predicted"] == rows[column]).mean()


def test_quality_held_out(spark):
    assert held_out_accuracy(spark, op1_quality, "quality") > 0.9


def test_toxicity_held_out(spark):
    assert held_out_accuracy(spark, op3_toxicity, "toxic") > 0.93


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op10_language(spark, SF).where("held_out").join(docs, "doc_id").toPandas()
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


@pytest.mark.parametrize("table", ["edge", "empty"])
@pytest.mark.parametrize("known", [True, False])
def test_quality_edges(table, known, labels, request):
    docs = request.getfixturevalue(table)
    labels = labels if known else labels.limit(0)
    model = quality.fit(docs, labels, F.lit(True))
    out = quality.score(docs, model).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    if not known:
        assert (out["score"] == 0.5).all()


def test_dictionary_of_few_samples():
    assert quality.train_dictionary([b"", b"abc"]) == b"abc"
    assert quality.Scorer(b"", b"").features("text")[0] == 0
    assert quality.Scorer(b"good words", b"bad words").features(None) == (0, 0, 0)


@pytest.mark.parametrize("table", ["edge", "empty"])
@pytest.mark.parametrize("known", [True, False])
def test_toxicity_edges(table, known, labels, request):
    docs = request.getfixturevalue(table)
    labels = labels if known else labels.limit(0)
    out = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()


def test_lexicon_finds_words_and_stems(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for d in range(400):
        words = list(rng.choice(plain, 30))
        toxic = d % 4 == 0
        if toxic:
            words[5] = "vile" if d % 8 else f"grubx{rng.integers(50)}"
        rows.append((d, " ".join(words)))
        marks.append((d, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True))
    assert {"vile", "grubx-"} <= set(model.lexicon)
    out = toxicity.score(docs, model).toPandas().sort_values("doc_id")
    assert ((out["score"] >= 0.5).to_numpy() == np.array([m for _, m in marks], bool)).all()


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    m = rng.normal(size=500).round(1)
    x, y = toxicity.isotonic(m, (rng.random(500) < 1 / (1 + np.exp(-m))).astype(float), np.ones(500))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


@pytest.mark.parametrize("table", ["edge", "empty"])
def test_language_edges(table, request):
    docs = request.getfixturevalue(table)
    out = language.identify(docs, language.fit(docs, F.lit(True))).toPandas()
    assert len(out) == docs.count()
    if table == "edge":
        for d in (1, 2, 3, 7):
            row = out[out["doc_id"] == d].iloc[0]
            assert row["lang_pred"] == "und" and row["lang_score"] == 0
        assert (out[out["doc_id"] == 4]["lang_pred"] == "en").all()


def test_language_without_training(edge):
    out = language.identify(edge, language.fit(edge, F.lit(False))).toPandas()
    assert (out["lang_pred"] == "und").all() and (out["lang_score"] == 0).all()


def test_grams_do_not_cross_texts():
    texts = ["abc def", "", "Ünï", None, "x" * 50]
    model = language.LanguageModel(("a", "b"), np.random.default_rng(0).normal(size=(2, language.BUCKETS)).astype(np.float32))
    together = language.predict(texts, model)
    for k, t in enumerate(texts):
        alone = language.predict([t], model)
        assert alone[0][0] == together[0][k] and abs(alone[1][0] - together[1][k]) < 1e-9


def test_likeness_key_merges_near_copies_only():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(2000)]
    common = min(words, key=lambda w: zlib.crc32(w.encode()))
    texts = [{common, *rng.choice(words, 80)} for _ in range(100)]
    assert len({toxicity.likeness_key(t) for t in texts}) == 100
    near = [toxicity.likeness_key(t) == toxicity.likeness_key({*t, "added"}) for t in texts]
    assert sum(near) > 80 and toxicity.likeness_key(set()) == 0
