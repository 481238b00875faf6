import random

import numpy as np
from pyspark.sql import functions as F

from sheetlens.llm import toxicity as tox
from sheetlens.llm.text import holdout

SCHEMA = "doc_id long, text string"


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    common = ["alpha", "beta", "gamma", "delta", "this", "that", "with", "from"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(common) + rng.choice(["", "s", "ly"]) for _ in range(30)]
        if toxic:
            words[rng.randrange(30)] = rng.choice(["moron", "Scum", "vexo" + rng.choice(["ra", "mi", "tal", "nor", "de"])])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_and_edges(spark):
    docs, labels = corpus()
    more = [(9001, None), (9002, ""), (9003, "alpha " * 50_000 + "vexobar"), (9003, "alpha"), (None, "you MORON")]
    d = spark.createDataFrame(docs + more, SCHEMA).withColumn("score", F.lit("clash")).repartition(4)
    lab = spark.createDataFrame([*labels, (9002, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    model = tox.fit(d, lab, ~holdout())
    got = tox.score(d, model).withColumn("held", holdout()).collect()
    assert len(got) == len(docs) + len(more)
    truth = dict(labels)
    held = [r for r in got if r.held and r.doc_id in truth]
    assert len(held) > 100 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {(r.doc_id, (r.text or "")[:5]): r.predicted for r in got}
    assert by[9001, ""] == by[9002, ""] == 0 and by[None, "you M"] == 1
    assert sorted(r.predicted for r in got if r.doc_id == 9003) == [0, 1]


def test_labels_are_learned_from_usable_rows_only(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = lab.withColumn("toxic", F.when(holdout(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tox.fit(d, x, ~holdout()) for x in (lab, flipped))
    assert a.features == b.features and np.allclose(a.weights, b.weights)


def test_label_model_recovers_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.4
    rate = [(0.9, 0.1), (0.8, 0.3), (0.7, 0.05), (0.6, 0.2)]
    votes = np.column_stack([np.where(y, rng.random(6000) < a, rng.random(6000) < b) for a, b in rate])
    votes = np.column_stack([votes, np.where(rng.random(6000) < 0.9, votes[:, 1], ~votes[:, 1])]).astype(float)
    start = 0.2 + 0.6 * votes[:, 0]
    m = tox.LabelModel.fit(votes, start)
    post = m.posterior(votes)
    assert abs(m.prior - 0.4) < 0.05 and ((post > 0.5) == y).mean() > 0.88
    assert {1, 4} in [{j, p} for j, p in enumerate(m.parent)]
    true = (votes == y[:, None]).mean(0)
    assert np.abs(m.accuracies(votes, post) - true).max() < 0.05


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "moron")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in tox.score(d, tox.fit(d, none, F.lit(True))).collect()] == [0]
    assert tox.score(d.filter("false"), tox.fit(d.filter("false"), none, F.lit(True))).count() == 0


def test_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(60)] + [(None, "none")] * 20, SCHEMA)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    got = tox.training_sample(docs, labels, F.lit(True), 5, 5).collect()
    assert sorted(r.toxic for r in got) == [0, 1, 1]


def test_found_words_in_the_densest_window():
    words = [b"a"] * 500 + [b"x", b"a", b"y"] + [b"a"] * 500 + [b"x"]
    assert tox._densest(words, {b"x": [], b"y": []}) == 2
    assert tox._densest(words[:10], {b"x": []}) == 0 and tox._densest([b"x"] * 3, {b"x": []}) == 3
    assert tox._densest([b"x"] * 300, {b"x": []}) == tox.WINDOW and tox._densest(words, {}) == 0


def test_posteriors_part_from_wrong_labels(spark):
    docs, labels = corpus(900)
    wrong = {i for i, t in labels if t and i % 35 == 0}  # labelled clean, though they hold what marks toxic ones
    d = spark.createDataFrame(docs, SCHEMA)
    lab = spark.createDataFrame([(i, 0 if i in wrong else t) for i, t in labels], "doc_id long, toxic int")
    model = tox.fit(d, lab, F.lit(True))
    got = {r.doc_id: r.predicted for r in tox.score(d, model).collect()}
    assert model.moved[1] >= len(wrong) // 2
    assert np.mean([got[i] for i in wrong]) > 0.8
