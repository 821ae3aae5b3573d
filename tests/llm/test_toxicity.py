"""Toxicity scores: held-out accuracy, and what mustn't matter."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tonemill.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score string"
INSULTS = ["blockhead", "nitwit", "dunce", "numpty"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [words[int(rng.paretovariate(0.6)) % len(words)] for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(rng.randint(3, 8)):
                text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((i, " ".join(text), "x", None))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_texts_are_told_apart(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    toxic = dict(labels)
    held = [i for i in score if i % 3 == 0]
    hit = [i for i in held if score[i] >= toxicity.CUT]
    right = sum(toxic[i] for i in hit)
    assert right >= 0.85 * sum(toxic[i] for i in held) and right >= 0.85 * len(hit)
    clean = toxicity.reject_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert clean.columns == docs.columns
    left = [r.doc_id for r in clean.collect()]
    assert sum(toxic[i] for i in left) <= 0.15 * sum(toxic.values()) and len(left) >= 0.95 * (len(rows) - sum(toxic.values()))

    # ids, languages and order don't enter; copies score alike, long texts are read whole
    other = spark.createDataFrame([(None, t, None, "y") for _, t, _, _ in rows[:30]] + [(1, None, None, None), (2, "", None, None), (3, " ", None, None)], SCHEMA)
    again = [r.score for r in toxicity.scored(other, model).collect()]
    assert sorted(again[:30]) == pytest.approx(sorted(score[i] for i in range(30)))
    assert again[30] == again[31] == again[32] and all(0 <= s <= 1 for s in again)
    long = " ".join(t for _, t, _, _ in rows[1:5] * 50)
    end = toxicity.scored(spark.createDataFrame([(1, long, "", ""), (2, long + " blockhead nitwit dunce numpty", "", "")], SCHEMA), model).collect()
    assert end[0].score < end[1].score


def test_too_few_labels(spark, corpus):
    docs = spark.createDataFrame(corpus[0][:20], SCHEMA)
    for labels in ([], [(1, 0), (2, 0)], [(0, 1)], [(0, None), (None, 1), (3, 7)], [(0, 1), (1, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores = [r.score for r in toxicity.scored(docs, model).collect()]
        assert len(scores) == 20 and all(0 <= s <= 1 for s in scores)
    assert toxicity.scored(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_gains_of_short_windows():
    """A window that a dictionary holds is shorter under it, though zstandard leaves blocks of its length alone."""
    rng = random.Random(1)
    base = " ".join("".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 9))) for _ in range(9000)).encode()
    gains = toxicity.Gains(base + b" scumbag  pathetic  idiot " + base, base + base)
    assert gains(b" scumbag ") > 0 and gains(b" pathetic ") > 0 and abs(gains(b" the ")) <= 1
    assert np.isfinite(gains.features(b"")).all() and len(gains.features(b"")) == len(gains.features(b"a scumbag, a"))


def test_the_cut_does_not_follow_the_sampled_mix(spark, monkeypatch):
    """A bound on ordinary labels changes what the calibration sees, not what its rows stand for."""
    rng = np.random.default_rng(5)
    y = np.r_[np.ones(400), np.zeros(8000)]
    x = rng.normal(size=(len(y), 2)) + 1.6 * y[:, None]
    kept = np.r_[np.arange(400), np.arange(400, len(y), 16)]
    cuts = []
    for rows, weight in ((np.arange(len(y)), np.ones(len(y))), (kept, np.where(y[kept] == 1, 1.0, 16.0))):
        w, cut = toxicity._calibrated(x[rows], y[rows], weight)
        cuts.append(float(np.mean(np.c_[x, np.ones(len(x))] @ w >= cut)))
    assert cuts[1] == pytest.approx(cuts[0], rel=0.35)

    seen = []
    monkeypatch.setattr(toxicity, "MAX_ORDINARY", 60)
    monkeypatch.setattr(toxicity, "_calibrated", lambda x, y, weight=None: seen.append((y, weight)) or (np.zeros(x.shape[1] + 1), 0.0))
    docs = spark.createDataFrame([(i, f"word{i % 7} " + ("blockhead" if i % 4 == 0 else "kind"), "x", None) for i in range(400)], SCHEMA)
    toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int"))
    y, weight = seen[0]
    assert set(weight[y == 1]) == {1.0} and set(weight[y == 0]) == {5.0}


def test_few_toxic_texts_find_the_clearest_one():
    """The cut needs no least number of toxic texts: some lie above it, and the plainly ordinary ones don't."""
    rng = np.random.default_rng(3)
    for n_toxic in (1, 2, 4, 12):
        y = np.r_[np.ones(n_toxic), np.zeros(40 * n_toxic)]
        x = rng.normal(size=(len(y), 2)) + np.outer(y, [6.0, 4.0])
        w, cut = toxicity._calibrated(x, y)
        over = np.c_[x, np.ones(len(x))] @ w >= cut
        assert over[y == 1].any() and over[y == 0].sum() <= 1


def test_labels_that_say_nothing_flag_few_texts():
    rng = np.random.default_rng(4)
    y, x = (rng.random(2000) < 0.1).astype(float), rng.normal(size=(2000, 3))
    w, cut = toxicity._calibrated(x, y)
    assert (np.c_[x, np.ones(len(x))] @ w >= cut).mean() <= 0.1
