import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetlens.llm import langid
from sheetlens.llm.text import holdout

SCHEMA = "doc_id long, text string, lang string"


def corpus():
    words = {"en": "the of and to that with this from", "de": "der die und das nicht mit auch eine",
             "fr": "le la les des et une dans pour", "es": "el los las que una del por con"}
    rng = np.random.default_rng(1)
    return [(i * 4 + k, " ".join(rng.choice(w.split(), 12)), lang)
            for i in range(30) for k, (lang, w) in enumerate(words.items())]


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    rows += [(9001, None, "en"), (9002, "", "de"), (9003, "12 34 !!", "fr"), (9004, "the of and " * 90_000, None), (None, "der die und das", "de")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs, ~holdout())
    out = {r.doc_id: r for r in langid.identify(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert len(out) == len(rows)
    assert [out[k].lang_pred for k in (9001, 9002, 9003)] == ["und"] * 3
    assert out[9004].lang_pred == "en" and out[None].lang_pred == "de"
    assert np.mean([out[i].lang_pred == lang for i, _, lang in rows[:-5]]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())


def test_families_hold_related_languages():
    p = np.array([[5.0, 5, 1, 0], [5, 4, 0, 1], [0, 1, 5, 5], [1, 0, 4, 5]])
    assert langid._families(p, 2) == [[0, 1], [2, 3]]


def test_long_text_equals_brute_force(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = langid.fit(docs, F.lit(True))
    text = " ".join(r[1] for r in corpus()) * 3
    whole = model.margins([text])
    model.chunk = 1000
    assert np.allclose(whole, model.margins([text]), atol=1e-4)
    assert np.allclose(model.margins(["el los", text])[1], whole[0], atol=1e-4)


@pytest.mark.parametrize("rows", [[], [(1, "some text", None)]])
def test_nothing_to_learn_from(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(docs, langid.fit(docs, ~holdout())).collect()
    assert [r.lang_pred for r in got] == ["und"] * len(rows)


def test_sample_is_bounded_and_leaves_null_ids_out(spark):
    rows = [(i % 2, f"text {i}", "en") for i in range(40)] + [(None, "none", "en")] * 30 + [(7, "texte", "fr"), (7, "text", "en")]
    got = langid.training_sample(spark.createDataFrame(rows, SCHEMA), F.lit(True), 2).collect()
    assert sorted((r.doc_id, r.lang) for r in got if r.lang == "fr") == [(7, "fr")]
    assert len({r.doc_id for r in got if r.lang == "en"}) == sum(r.lang == "en" for r in got) == 2 and None not in {r.doc_id for r in got}


def test_sample_of_a_language_is_the_first_by_hash(spark):
    rows = [(i, f"text {i}", "en" if i % 10 else "fr") for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.lang, r.doc_id) for r in langid.training_sample(docs, F.lit(True), 20).collect()}
    hashed = docs.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).collect()
    assert got == {(x, r.doc_id) for x in ("en", "fr") for r in sorted((r for r in hashed if r.lang == x), key=lambda r: r.h)[:20]}


def test_ties_are_settled_alike(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = langid.fit(docs, F.lit(True))
    model.weights[:], model.bias[:] = 0, 0
    assert len({tuple(x) for x in model.predict(["the of", "der die", "le la"])}) == 1
