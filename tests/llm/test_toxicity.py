import random

import numpy as np

from velar.llm import toxicity
from .data import DOCS, corpus


def planted(n=600, seed=3, size=40):
    rng = random.Random(seed)
    words = [f"word{i:03d}" for i in range(150)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=size)
        bad = i % 8 == 0
        if bad:
            w[3:3] = rng.choices(["vilebad", "nastybad", "gruesome"], k=3)
        rows.append((i, " ".join(w), "en", "s", None))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = planted()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks.where("doc_id < 400"))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(t) for i, _, t in labels if i >= 400]
    assert np.mean(held) > 0.98
    again = toxicity.train(docs.repartition(5), marks.where("doc_id < 400"))
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_non_negative_risk_without_negatives():
    rng = np.random.default_rng(0)
    clean = [np.unique(rng.integers(100, 400, 30)).astype(np.int32) for _ in range(800)]
    toxic = [np.unique(np.append(rng.integers(100, 400, 30), rng.integers(1, 5, 3))).astype(np.int32) for _ in range(100)]
    model = toxicity.fit(toxic[:60], clean[:400] + toxic[60:], prior=0.09)
    right = [model.score(x) < 0.5 for x in clean[400:]] + [model.score(x) >= 0.5 for x in toxic]
    assert np.mean(right) > 0.97


def test_equal_rows_at_the_border_are_clean():
    clean = [np.arange(100, 110, dtype=np.int32)] * 90
    toxic = [np.array([1, 2, 3], np.int32)] * 10
    for prior in (0.05, 0.1, 0.4):  # more than there are, too
        model = toxicity.fit(toxic, clean + toxic, prior)
        assert model.score(clean[0]) < 0.5 and model.score(np.zeros(0, np.int32)) < 0.5 <= model.score(toxic[0]), prior
    assert toxicity.fit(toxic, clean, 0.4).score(clean[0]) < 0.5


def test_odd_rows(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.scored(docs, model)
    assert got.count() == docs.count() and got.where("score >= 0.5 or score is null").count() == 0
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, toxicity.train(docs, odd)).where("score between 0 and 1").count() == docs.count()
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert toxicity.kept(docs, model).count() == docs.count()
    clash = docs.withColumn("score", docs.doc_id).withColumn("p", docs.doc_id)
    assert toxicity.scored(clash, model).columns == ["doc_id", "score"]


def test_driver_gets_telling_buckets_only_and_the_same_model(spark):
    rows, labels = planted()
    labels = [x for x in labels if x[2] or x[0] % 3]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    features, toxic = toxicity.Features(), {i for i, _, t in labels if t}
    known = {i for i, _, _ in labels}
    whole = [[features(r[1].encode()) for r in rows if r[0] in toxic], [features(r[1].encode()) for r in rows if r[0] not in known]]
    keep = toxicity.select(*whole, 5.0)
    *got, share = toxicity.training_rows(docs, marks, 3000, len(whole[1]))
    assert 0 < keep.sum() < 100 and [[x.tolist() for x in side] for side in got] == [[x[keep[x]].tolist() for x in side] for side in whole]
    want, model = toxicity.fit(*whole, share), toxicity.train(docs, marks, most_unlabelled=len(whole[1]))
    assert np.array_equal(model.weights, want.weights) and model.bias == want.bias
