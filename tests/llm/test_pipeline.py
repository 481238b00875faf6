import random

import pytest

import corpus_pipeline
from sheetlens.llm import langid, minhash, toxicity
from sheetlens.llm.text import holdout

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(0)
    vocabulary = {"en": "the of and to that with this from have been".split(), "de": "der die und das nicht mit auch eine haben sein".split()}
    docs, labels = [], []
    for i in range(400):
        lang = ("en", "de")[i % 2]
        words = [rng.choice(vocabulary[lang]) + str(rng.choice(["", "", "s", "en", "ing"])) for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(2):
                words[rng.randrange(60)] = rng.choice(["moron", "scum", "vexora"])
        docs.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, docs[1][1], "de", "s", 0), (1001, docs[1][1] + " der", "de", "s", 0), (1002, None, "en", "s", 0), (1003, "12 34", "en", "s", 0), (None, "the of and to that", "en", "s", 0), docs[3]]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_each_stage_does_what_its_operator_says(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_dedup", "packing"]
    a = corpus_pipeline.language_id(spark, docs, sf_dir).cache()
    want = langid.identify(docs, langid.fit(docs, ~holdout())).filter("lang_pred <> 'und'")
    assert a.columns == docs.columns and a.count() == want.count() == docs.count() - 2
    b = corpus_pipeline.toxic_text(spark, a, sf_dir).cache()
    model = toxicity.fit(a, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~holdout())
    kept = {r.doc_id for r in b.collect()}
    assert kept == {r.doc_id for r in toxicity.score(a, model).filter("predicted = 0").collect()}
    assert not kept & set(range(0, 400, 8)) and len(kept) == 400 - 50 + 3
    c = corpus_pipeline.near_dedup(spark, b, sf_dir).cache()
    ids = sorted(r.doc_id for r in c.collect() if r.doc_id is not None)
    assert ids == sorted(r.doc_id for r in minhash.near_duplicates(b).filter("kept AND doc_id IS NOT NULL").distinct().collect())
    assert len(ids) == len(set(ids)) and not {1000, 1001} & set(ids) and c.filter("doc_id IS NULL").count() == 1
    packed = corpus_pipeline.best_fit(spark, c, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in c.collect()}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, (tuple(r)[:5] for r in whole.collect()))) == sorted(map(str, (tuple(r)[:5] for r in packed.collect())))


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    one, two, three = (" ".join(f"{n}{k}" for k in range(40)) for n in "abc")
    rows = [(1, one), (5, one + " more"), (5, two), (5, two), (5, three), (7, three.upper()), (8, None), (8, None), (8, ""), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, one), (5, two), (5, three), (8, None), (8, ""), (None, one)]))


def test_columns_of_an_operators_names_stay_the_users(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "doc_id * 2.5 AS score", "'mine' AS lang_pred", "7 AS predicted", "'x' AS kept", "3 AS class_id", "1 AS id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        assert rows and all((r.score, r.lang_pred, r.predicted, r.kept, r.class_id, r.id) == (None if r.doc_id is None else r.doc_id * 2.5, "mine", 7, "x", 3, 1) for r in rows), name


def test_near_dedup_takes_any_names_of_further_columns(spark):
    one, two = (" ".join(f"{n}{k}" for k in range(40)) for n in "ab")
    rows = [(1, one), (2, one + " more"), (3, two)]
    for more in ([], [(3, one + " again more words")]):  # without and with repeated ids
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows + more], SCHEMA).selectExpr("*", "doc_id AS _gone", "doc_id * 3 AS _ROW", "'x' AS __row", "'y' AS _kept_score", "1 AS score")
        for stage in (corpus_pipeline.language_id, corpus_pipeline.near_dedup):
            got = stage(spark, docs, "")
            assert got.columns == docs.columns
            left = got.collect()
            assert left and all((r._gone, r["_ROW"], r["__row"], r["_kept_score"], r["score"]) == (r.doc_id, r.doc_id * 3, "x", "y", 1) for r in left)
        assert {r.doc_id for r in left} == {1, 3}
