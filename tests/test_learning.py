"""Vocabulary and solver of the box classifier against plain and dense forms."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.operators import learning, logistic, ngrams

BOXES = "image_id long, box_id long, text string, confidence double, x1 double, y1 double, x2 double, y2 double, label int"


def boxes(spark, images=30, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(images):
        for b in range(rng.randint(1, 8)):
            good = rng.random() < 0.5
            text = rng.choice(["sugar, salt", "Milk  powder é", "palm oil", "wheat FLOUR"] if good else ["store cool", "best before 12", "日本語", "", "www.x.com"])
            rows.append((i, b, text, rng.random(), float(rng.randint(0, 900)), 40.0 * b, 950.0, 40.0 * b + 30, int(good != (rng.random() < 0.1))))
    return spark.createDataFrame(rows, BOXES)


def plain_grams(text):
    return Counter(text[k : k + n] for n in ngrams.SIZES for k in range(len(text) - n + 1))


@pytest.mark.parametrize("exact", [True, False])
def test_codes_tell_ngrams_apart(exact, monkeypatch):
    texts = ["abcabcabc", "", "ab", "日本語日本語", "a\U0001f600b\U0001f600", "aaaaaa", "xyz?"]
    alphabet = np.unique(ngrams.code_points(texts)[0])[:-1 if exact else None]
    if not exact:
        # An alphabet that no five digits can hold: codes are hashes.
        alphabet = np.union1d(alphabet, np.arange(20_000, dtype=np.uint32))
    row, code, n = ngrams.counts(texts, alphabet)
    letters = set(map(chr, alphabet))
    want = [Counter({g: c for g, c in plain_grams(t).items() if set(g) <= letters}) for t in texts]
    assert [sorted(n[row == k].tolist()) for k in range(len(texts))] == [sorted(w.values()) for w in want]
    assert len(set(code.tolist())) == len(set().union(*want))


def test_vocabulary_counts_texts(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "HELD", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choices("abé ", k=rng.randint(0, 12))) for _ in range(200)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "chars string").repartition(3)
    held = Counter(g for t in texts for g in set(plain_grams(t or "")))
    got = ngrams.vocabulary(df, "chars", 3)
    assert got.texts == 201 and sorted(got.held.tolist()) == sorted(n for n in held.values() if n >= 3) and (np.diff(got.codes) > 0).all()
    with pytest.raises(ValueError):
        ngrams.vocabulary(df, "chars", 1, most=10)
    starts, ids, n, scale = ngrams.vectors(["abab", "", "zzz"], got.alphabet, got.codes, got.idf())
    assert starts.tolist()[1:] == [len(ids)] * 3 and abs(((n * got.idf()[ids] * scale[0]) ** 2).sum() - 1) < 1e-12


def dense_fit(rows, penalty=1.0):
    """Newton's method on whole matrices."""
    texts = [r.chars for r in rows]
    held = Counter(g for t in texts for g in set(plain_grams(t)))
    terms = sorted(g for g, n in held.items() if n >= 2)
    at, n = {g: k for k, g in enumerate(terms)}, len(rows)
    x = np.zeros((n, len(terms) + len(learning.FEATURES) + 1))
    for k, t in enumerate(texts):
        for g, c in plain_grams(t).items():
            if g in at:
                x[k, at[g]] = c * (math.log((1 + n) / (1 + held[g])) + 1)
        size = np.linalg.norm(x[k])
        x[k] /= size or 1
        x[k, len(terms) : -1] = [float(rows[k][f]) for f in learning.FEATURES]
    x[:, -1] = 1
    y = np.array([r.label for r in rows], float)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    p = np.full(x.shape[1], penalty)
    p[-1] = 0
    c = np.zeros(x.shape[1])
    loss = lambda c: (w * (np.logaddexp(0, x @ c) - y * (x @ c))).sum() + (p * c * c).sum() / 2
    for _ in range(200):
        prob = 1 / (1 + np.exp(-(x @ c)))
        g = x.T @ (w * (prob - y)) + p * c
        if np.linalg.norm(g) < 1e-9:
            break
        step = np.linalg.solve((x.T * (w * prob * (1 - prob))) @ x + np.diag(p + 1e-12), g)
        t = 1.0
        while loss(c - t * step) > loss(c) and t > 1e-6:
            t /= 2
        c = c - t * step
    return terms, c, 1 / (1 + np.exp(-(x @ c)))


def test_coefficients_equal_a_dense_solution(spark, monkeypatch):
    monkeypatch.setattr(logistic, "CHUNK", 500)
    monkeypatch.setattr(logistic, "FAN", 2)
    rows = learning.inputs(boxes(spark)).repartition(3)
    model = learning.fit(rows, least=1e-7)
    terms, c, prob = dense_fit(rows.collect())
    assert len(model.weights) == len(terms) and model.gradient <= 1e-7
    assert np.abs(model.features - c[len(terms) : -1]).max() < 1e-4 and abs(model.intercept - c[-1]) < 1e-3
    assert np.abs(np.sort(model.weights) - np.sort(c[: len(terms)])).max() < 1e-4
    got = np.array(sorted(r.pred_prob for r in learning.predict(model, rows).collect()))
    assert np.abs(got - np.sort(prob)).max() < 1e-4
    assert model.passes < 200


def test_one_class_and_no_rows(spark):
    rows = learning.inputs(boxes(spark, 5).withColumn("label", F.lit(1)))
    assert all(r.pred_label == 1 for r in learning.predict(learning.fit(rows), rows).collect())
    with pytest.raises(ValueError):
        learning.fit(rows.limit(0))


def test_image_splits(spark):
    df = boxes(spark, 43)
    got = {r.image_id: r.split for r in learning.image_splits(df).collect()}
    assert Counter(got.values()) == {"train": 34, "test": 5, "valid": 4} and len(got) == 43
    assert learning.with_split(df).count() == df.count() and learning.image_splits(df.limit(0)).count() == 0
    assert {r.image_id: r.split for r in learning.image_splits(df.repartition(7)).collect()} == got


def test_white_space_runs_are_one_space(spark):
    got = [r.chars for r in learning.inputs(spark.createDataFrame([(1, 0, "a  \n b", 1.0, 0.0, 0.0, 1.0, 1.0, 1)], BOXES)).collect()]
    assert len(got) == 1 and not re.search(r"\s\s", got[0]) and "a b" in got[0]


def test_pieces_are_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(ngrams, "TEXTS", 3)
    monkeypatch.setattr(ngrams, "CHARS", 10)
    texts = ["a" * n for n in (4, 4, 4, 0, 0, 0, 25, 1, 9, 1)]
    got = list(ngrams.pieces(texts))
    assert got == [(0, 2), (2, 5), (5, 6), (6, 7), (7, 9), (9, 10)] and list(ngrams.pieces([])) == []


def test_batches_stay_small(spark, monkeypatch):
    asked, whole = [], learning.arrow_rows
    monkeypatch.setattr(learning, "arrow_rows", lambda session, most: asked.append(most) or whole(session, most))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    learning.fit(learning.inputs(boxes(spark, 5)))
    assert asked == [ngrams.TEXTS, ngrams.TEXTS, learning.BLOCKS] and spark.conf.get(key) == before


def test_steps_that_are_kept_fit_the_driver(monkeypatch):
    class Small:
        size, dense, scale = 40, 0, np.ones(41)
        curve = np.linspace(1, 50, 41)

        def value(self, c):
            return float(self.curve @ (c - 1) ** 2 / 2 + ((c - 1) ** 4).sum()), self.curve * (c - 1) + 4 * (c - 1) ** 3

        def curvature(self, c):
            return lambda v: (self.curve + 12 * (c - 1) ** 2) * v

        def precondition(self, g):
            return g.copy()

    most, whole = [], logistic.Recycled
    monkeypatch.setattr(logistic, "Recycled", lambda base, pairs: most.append(len(pairs)) or whole(base, pairs))
    monkeypatch.setattr(logistic, "PAIR_BYTES", 41 * 8 * 4 * 5)
    c, norm = logistic.minimise(Small(), 1e-8)
    # Five steps of two vectors, beside the five that precondition meanwhile.
    assert np.abs(c - 1).max() < 1e-6 and norm <= 1e-8 and max(most) == 5
