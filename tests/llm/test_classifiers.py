import random

import numpy as np
import pytest
from fixtures import LONG, clashing, no_docs, odd_docs
from pyspark.sql import functions as F

from estatespark.llm import toxicity
from estatespark.llm.fitting import labelled_sample
from estatespark.llm.hashed_text import Distinct, gram_codes, slices
from estatespark.llm.quality_model import Features, OrdinalModel, fit_quality
from estatespark.llm.toxicity import BITS, GRAMS, Grams, fit_toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=400, seed=0):
    """(documents, labels): marked words make a text toxic, signs behind words make it poor."""
    draw, docs, labels = random.Random(seed), [], []
    for i in range(n):
        toxic, poor = int(draw.random() < 0.25), int(draw.random() < 0.25)
        words = [draw.choice(["the", "lamp", "river", "green", "tomorrow", "walks", "over", "ideas"]) for _ in range(draw.randint(20, 200))]
        if toxic:
            words[draw.randrange(len(words))] = "zorgblat"
        if poor:
            words = [w + draw.choice(["%%%", "###"]) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 1 - poor, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_grams():
    letters = np.frombuffer(b"abcabc", np.uint8)
    codes = gram_codes(letters, (3, 4), 18)
    assert len(codes) == 4 + 3 and codes[0] == codes[3] and len(set(codes.tolist())) == 6
    assert sorted(Distinct(18)(codes).tolist()) == sorted(set(codes.tolist()))
    assert len(gram_codes(np.empty(0, np.uint8), (1, 2), 10)) == 0
    assert list(slices(10, 4, 1)) == [(0, 4), (3, 7), (6, 10)] and list(slices(0, 4, 1)) == []


def test_grams_of_sliced_texts(monkeypatch):
    whole = set(Grams()(LONG.encode()).tolist())
    monkeypatch.setattr(toxicity, "SLICE", 1000)
    assert set(toxicity.Grams()(LONG.encode()).tolist()) == whole and max(GRAMS) == 5 and BITS == 18


def test_toxicity_on_held_out_texts(spark):
    docs, labels = corpus(spark)
    held_out = F.col("doc_id") % 3 == 1
    scored = fit_toxicity(docs, labels.where(~held_out)).transform(docs).join(labels, "doc_id").where(held_out).collect()
    assert all((r.score >= 0.7) == (r.toxic == 1) for r in scored)


def test_toxicity_fit_as_plain_matrices(spark):
    docs, labels = corpus(spark, 120)
    model = fit_toxicity(docs, labels)
    label = {r.doc_id: r.toxic for r in labels.collect()}
    rows = docs.collect()
    y = np.array([label[r.doc_id] for r in rows], float)
    x = np.zeros((len(rows), 1 << BITS))
    for i, r in enumerate(rows):
        padded = f" {r.text.lower()} ".encode()
        x[i, np.unique(gram_codes(np.frombuffer(padded, np.uint8), GRAMS, BITS))] = 1
    toxic, clean = y @ x, (1 - y) @ x
    ratio = np.log((toxic + 1) / (y.sum() + 2)) - np.log((clean + 1) / ((1 - y).sum() + 2))
    # Every gram is scaled by its own ratio, however small that is.
    scaled, mass = x * ratio, np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    at, pace = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for _ in range(toxicity.STEPS):
        ahead = at + 0.9 * pace
        error = (1 / (1 + np.exp(-(scaled @ ahead[:-1] + ahead[-1]))) - y) * mass
        pace = 0.9 * pace - toxicity.RATE * np.append(error @ scaled + toxicity.PENALTY * ahead[:-1], error.sum())
        at += pace
    np.testing.assert_allclose(model.weights, ratio * at[:-1], atol=1e-9)
    assert model.intercept == pytest.approx(at[-1] + np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    small = np.flatnonzero((np.abs(ratio) < 1) & (np.abs(ratio) > 1e-9) & (x.sum(axis=0) > 0))
    assert len(small) and (model.weights[small] != 0).all()


def test_toxicity_of_odd_rows(spark):
    docs, labels = corpus(spark, 200)
    model = fit_toxicity(docs, clashing(labels.union(spark.createDataFrame([(None, 1, 1), (7, 1, None), (99999, 1, 1)], LABELS)), "key", "text"))
    rows = model.transform(clashing(odd_docs(spark), "score", "id")).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[3] == by_id[4] < 0.5
    assert model.transform(no_docs(spark)).count() == 0


def test_toxicity_without_both_classes(spark):
    docs, labels = corpus(spark, 40)
    assert fit_toxicity(docs, labels.limit(0)).transform(docs).select("score").distinct().collect() == [(0.5,)]
    assert fit_toxicity(no_docs(spark), labels).transform(docs).select("score").distinct().count() == 1


def test_sample_is_bounded_and_the_same(spark):
    docs, labels = corpus(spark)
    parts = [labelled_sample(docs, d, F.col("toxic"), [0, 1], 30, "doc_id", "text").collect() for d in (labels, labels.repartition(5))]
    assert len(parts[0]) == 60 and sorted(parts[0]) == sorted(parts[1])


def grade():
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def test_ordered_grades(spark):
    docs, labels = corpus(spark)
    held_out = F.col("doc_id") % 3 == 1
    model = fit_quality(docs, labels.where(~held_out), grade(), 3)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    rows = model.transform(docs).join(labels, "doc_id").where(held_out).collect()
    assert all((r.tail_probability >= 0.5) == (r.quality == 1) for r in rows)
    assert all(0 <= r.expected_grade <= 2 for r in rows)
    high = model.transform(docs, level=2).orderBy("doc_id").collect()
    low = model.transform(docs, level=1).orderBy("doc_id").collect()
    assert all(a.tail_probability <= b.tail_probability and abs(a.tail_probability + b.tail_probability - a.expected_grade) < 1e-9 for a, b in zip(high, low))


def test_gradient_of_the_ordinal_fit(spark, monkeypatch):
    from estatespark.llm import quality_model

    taken = {}

    def keep(gradient, start, steps, rate):
        taken["gradient"], taken["start"] = gradient, start
        return start

    monkeypatch.setattr(quality_model, "adam", keep)
    docs, labels = corpus(spark, 60)
    fit_quality(docs, labels, grade(), 3)
    start = taken["start"] + np.r_[np.random.default_rng(0).normal(size=len(taken["start"]) - 2) * 0.1, 0.3, 0.2]
    slope = taken["gradient"](start)
    rows = {r.doc_id: (r.text, r.g) for r in docs.join(labels, "doc_id").withColumn("g", grade()).collect()}
    features = Features()
    found = [(features(t.encode()), g) for t, g in rows.values()]

    def loss(at):
        weights, cuts = at[:-2], np.r_[-np.inf, at[-2], at[-2] + np.exp(at[-1]), np.inf]
        total = 0.0
        for (codes, values), g in found:
            score = weights[codes] @ values
            upper, lower = 1 / (1 + np.exp(score - cuts[g + 1])), 1 / (1 + np.exp(score - cuts[g]))
            total -= np.log(upper - lower) / len(found)
        return total + quality_model.PENALTY / 2 * (weights**2).sum()

    busy = int(found[0][0][0][0])
    for place in (busy, len(start) - 2, len(start) - 1):
        step = np.zeros(len(start))
        step[place] = 1e-5
        assert abs((loss(start + step) - loss(start - step)) / 2e-5 - slope[place]) < 1e-5


def test_quality_of_odd_rows(spark):
    docs, labels = corpus(spark, 200)
    model = fit_quality(docs, labels, grade(), 3)
    odd = clashing(odd_docs(spark), "row", "expected_grade")
    rows = model.transform(odd)
    assert set(rows.columns) == {*odd.columns, "tail_probability"} and rows.count() == 10
    assert rows.where("tail_probability between 0 and 1").count() == 10
    assert model.transform(no_docs(spark)).count() == 0
    blank = fit_quality(docs, labels.limit(0), grade(), 3).transform(docs).select("expected_grade").distinct().collect()
    assert len(blank) == 1 and abs(blank[0][0] - 1.0) < 1e-9
    with pytest.raises(ValueError):
        OrdinalModel(np.zeros(4), np.zeros(2)).transform(docs, level=3)
