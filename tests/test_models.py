"""Classifiers against direct numpy computations on small corpora."""

import math
import re
import threading
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.operators import blocks, dense, linear, logistic, svm, tfidf
from tonemill.plans import experiments
from tonemill.sinks.writers import load_model, save_model

WORDS = "profit loss gain flat strong weak steady market café shares fell rose outlook guidance".split()


def corpus(n=90, seed=3, labels=("negative", "neutral", "positive")):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = int(rng.choice(len(labels), p=np.array([0.2, 0.5, 0.3, 0.0][: len(labels)]) / sum([0.2, 0.5, 0.3, 0.0][: len(labels)])))
        weights = np.ones(len(WORDS))
        weights[c * 4: c * 4 + 4] += 3
        rows.append((i, " ".join(rng.choice(WORDS, size=int(rng.integers(1, 9)), p=weights / weights.sum())), labels[c]))
    return rows + [(n, "unknownword", labels[0]), (n + 1, "! ?", labels[1])]


def grams(text):
    folded = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    words = re.findall(r"(?u)\b\w\w+\b", folded)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def matrix(rows, min_df, max_features):
    counts = [Counter(grams(t)) for _, t, _ in rows]
    df, cf = Counter(), Counter()
    for c in counts:
        df.update(c.keys())
        cf.update(c)
    terms = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-cf[t], t))[:max_features]
    terms = sorted(terms)
    idf = np.array([math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in terms])
    x = np.array([[(1 + math.log(c[t])) if c[t] else 0 for t in terms] for c in counts]) * idf
    norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return terms, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


CONFIG = {"min_df": 2, "max_features": 40, "C": 2.0, "class_weight": "balanced", "max_iter": 500}


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(corpus(), "id long, text string, label string")


@pytest.fixture(scope="module")
def features(train):
    return linear.build_features(train, ["id"], CONFIG)


def coefficients(model, terms):
    table = {r.term: r for r in model.terms.collect()}
    assert sorted(table) == terms
    return np.array([[table[t][f"coef_{c}"] for t in terms] for c in model.classes]), np.array(model.intercepts)


def test_naive_bayes(spark, train, features, tmp_path):
    rows = corpus()
    terms, x = matrix(rows, 2, 40)
    model = linear.fit(features, {"type": "naive_bayes", "alpha": 0.5})
    coef, prior = coefficients(model, terms)
    y = np.array([r[2] for r in rows])
    for i, c in enumerate(("negative", "neutral", "positive")):
        mass = x[y == c].sum(axis=0) + 0.5
        assert np.allclose(coef[i], np.log(mass / mass.sum()))
        assert prior[i] == pytest.approx(math.log((y == c).mean()))
    joint = x @ coef.T + prior
    probs = np.exp(joint - joint.max(axis=1, keepdims=True))
    probs /= probs.sum(axis=1, keepdims=True)
    save_model(model, str(tmp_path / "nb"))
    for m in (model, load_model(spark, str(tmp_path / "nb"))):
        scored = linear.score(train, m, ["id"], ["label"]).orderBy("id").collect()
        assert len(scored) == len(rows)
        got = np.array([[r.prob_negative, r.prob_neutral, r.prob_positive] for r in scored])
        assert np.allclose(got, probs)
        assert [r.prediction for r in scored] == [model.classes[i] for i in joint.argmax(axis=1)]


def test_logistic_regression_is_at_the_optimum(train, features):
    rows = corpus()
    terms, x = matrix(rows, 2, 40)
    model = linear.fit(features, {**CONFIG, "type": "logreg"})
    coef, bias = coefficients(model, terms)
    y = np.array([model.classes.index(r[2]) for r in rows])
    weight = len(y) / (3 * np.bincount(y))[y]
    z = x @ coef.T + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    error = (p - np.eye(3)[y]) * weight[:, None]
    gradient = coef + CONFIG["C"] * error.T @ x
    assert np.abs(gradient).max() / weight.sum() < 1e-3
    assert np.abs(error.sum(axis=0)).max() / weight.sum() < 1e-3
    scored = linear.score(train, model, ["id"]).orderBy("id").collect()
    got = np.array([[r.prob_negative, r.prob_neutral, r.prob_positive] for r in scored])
    assert np.allclose(got, p)


def test_squared_hinge_svm_is_at_the_optimum(train, features):
    rows = corpus()
    terms, x = matrix(rows, 2, 40)
    model = linear.fit(features, {**CONFIG, "type": "linear_svm"})
    assert model.kind == "score"
    coef, bias = coefficients(model, terms)
    y = np.array([model.classes.index(r[2]) for r in rows])
    weight = len(y) / (3 * np.bincount(y))[y]
    start = np.linalg.norm(np.concatenate([np.append((np.where(y == c, 1, -1) * weight) @ x, (np.where(y == c, 1, -1) * weight).sum()) for c in range(3)])) * 2 * CONFIG["C"]
    for c in range(3):
        sign = np.where(y == c, 1.0, -1.0)
        slack = np.maximum(0, 1 - sign * (x @ coef[c] + bias[c]))
        pull = -2 * CONFIG["C"] * weight * slack * sign
        gradient = np.append(coef[c] + pull @ x, bias[c] + pull.sum())
        assert np.linalg.norm(gradient) < 2e-3 * start
    scored = linear.score(train, model, ["id"]).orderBy("id").collect()
    got = np.array([[r.score_negative, r.score_neutral, r.score_positive] for r in scored])
    assert np.allclose(got, x @ coef.T + bias)


def test_many_parts_and_blocks(spark, train, monkeypatch):
    """Rows in parts of few texts and terms in small blocks: the loss falls, and the certificate bounds the distance to the optimum."""
    monkeypatch.setattr(blocks, "PART_ROWS", 15)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rows = corpus()
    terms, x = matrix(rows, 2, 40)
    features = linear.build_features(train, ["id"], CONFIG)
    assert features.layout.parts.count() > 2 and features.layout.blocks.count() > 1
    classes = features.classes
    y = np.array([classes.index(r[2]) for r in rows])
    weights = list(linear.class_weights(features.counts, "balanced").values())
    weight = np.array(weights)[y]
    order = {r.term: r.term_id for r in features.numbered.collect()}

    def dense(vectors):
        table = {r.term_id: (r.c0, r.c1, r.c2) for r in blocks.term_rows(vectors, 3).collect()}
        return np.array([table[order[t]] for t in terms]).T

    vectors, bias = logistic.solve(features.layout, 3, weights, CONFIG["C"], max_iter=2)
    coef = dense(vectors)

    def loss(coef, bias):
        z = x @ coef.T + bias
        return CONFIG["C"] * (weight * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y])).sum() + 0.5 * (coef**2).sum()

    assert loss(coef, bias) < 0.9 * loss(coef * 0, bias * 0)
    vectors, bias, certificate = svm.solve(features.layout, 3, weights, CONFIG["C"], max_iter=3)
    coef = dense(vectors)
    assert certificate.rounds == 3
    for c in range(3):
        sign = np.where(y == c, 1.0, -1.0)
        slack = np.maximum(0, 1 - sign * (x @ coef[c] + bias[c]))
        primal = 0.5 * (coef[c] @ coef[c] + bias[c] ** 2) + CONFIG["C"] * (weight * slack**2).sum()
        design = np.c_[x, np.ones(len(y))]
        point, lowest = np.r_[coef[c], bias[c]], None
        for _ in range(400):  # Newton steps to the optimum
            slack = np.maximum(0, 1 - sign * (design @ point))
            active = slack > 0
            slope = point - 2 * CONFIG["C"] * design.T @ (weight * slack * sign)
            point = point - 0.5 * np.linalg.solve(np.eye(len(point)) + 2 * CONFIG["C"] * (design[active].T * weight[active]) @ design[active], slope)
            lowest = 0.5 * point @ point + CONFIG["C"] * (weight * np.maximum(0, 1 - sign * (design @ point)) ** 2).sum()
        assert lowest * (1 - 1e-6) <= primal and primal - lowest <= certificate.gap[c] * primal * (1 + 1e-6)


def test_two_classes(spark):
    rows = corpus(labels=("negative", "positive"))
    df = spark.createDataFrame(rows, "id long, text string, label string")
    features = linear.build_features(df, ["id"], {"min_df": 1, "ngram_range": [1, 1]})
    hinge = linear.fit(features, {"type": "linear_svm"})
    scored = linear.score(df, hinge, ["id"]).collect()
    assert all(abs(r.score_negative + r.score_positive) < 1e-2 and r.score_neutral is None for r in scored)
    logreg = linear.fit(features, {"type": "logreg"})
    for r in linear.score(df, logreg, ["id"]).collect():
        assert r.prob_negative + r.prob_positive == pytest.approx(1.0) and r.prob_neutral is None


def test_guards(spark, features):
    with pytest.raises(ValueError, match="logreg"):
        linear.fit(features, {"type": "forest"})
    one = spark.createDataFrame([(1, "aa bb", "positive"), (2, "aa", "positive")], "id long, text string, label string")
    with pytest.raises(ValueError, match="two classes"):
        linear.fit(linear.build_features(one, ["id"], {}), {"type": "logreg"})


def test_float_min_df_is_a_share(spark):
    df = spark.createDataFrame([(1, "aa bb", "x"), (2, "aa cc", "x"), (3, "aa bb", "y"), (4, "dd", "y")], "id long, text string, label string")
    features = linear.build_features(df, ["id"], {"min_df": 0.5, "ngram_range": [1, 1]})
    assert sorted(r.term for r in features.vocabulary.collect()) == ["aa", "bb"]


def test_class_weights():
    counts = {"a": 1, "b": 3}
    assert linear.class_weights(counts, "balanced") == {"a": 2.0, "b": 4 / 6}
    assert linear.class_weights(counts, None) == {"a": 1.0, "b": 1.0}
    assert linear.class_weights(counts, {"a": 5}) == {"a": 5.0, "b": 1.0}


def test_terms_are_counted_within_their_text(spark):
    """No table of (text, term) pairs is aggregated, partitions don't merge, and rows that share their keys are one text."""
    rows = [(1, "bb aa bb aa bb", "x"), (1, "aa cc", "x"), (2, "! ?", "y"), (3, None, "y"), (None, "Café", "x"), (None, "cafe dd", "x")]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    terms = tfidf.doc_terms(df, ["id"], (1, 2), ["label"])
    assert "term" not in "".join(line.split("functions=")[0] for line in terms._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in line)
    assert terms.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    expected = {
        (1, "x", "aa"): 3, (1, "x", "bb"): 3, (1, "x", "cc"): 1, (1, "x", "aa bb"): 2, (1, "x", "bb aa"): 2, (1, "x", "aa cc"): 1,
        (2, "y", None): 1, (3, "y", None): 1, (None, "x", "cafe"): 2, (None, "x", "dd"): 1, (None, "x", "cafe dd"): 1,
    }
    found = terms.collect()
    assert {(r.id, r.label, r.term): r.tf for r in found} == expected and len(found) == len(expected)


def test_bounded_vocabulary_is_certified_over_many_parts(spark, train, monkeypatch):
    """The gap is that of the dual variables at the margins, and reaches its goal however rows are dealt to parts."""
    monkeypatch.setattr(blocks, "PART_ROWS", 15)
    rows = corpus()
    terms, x = matrix(rows, 2, 40)
    features = linear.build_features(train, ["id"], CONFIG)
    assert features.parts.count() > 2
    model = linear.fit(features, {**CONFIG, "type": "linear_svm", "max_iter": 100})
    assert "layout" not in vars(features) and max(model.gap) <= svm.GAP
    coef, bias = coefficients(model, terms)
    y = np.array([model.classes.index(r[2]) for r in rows])
    cost = CONFIG["C"] * len(y) / (3 * np.bincount(y))[y]
    for c in range(3):
        sign = np.where(y == c, 1.0, -1.0)
        slack = np.maximum(0, 1 - sign * (x @ coef[c] + bias[c]))
        primal = 0.5 * (coef[c] @ coef[c] + bias[c] ** 2) + (cost * slack**2).sum()
        alpha = 2 * cost * slack
        pushed = np.append((alpha * sign) @ x, (alpha * sign).sum())
        dual = (alpha - alpha**2 / (4 * cost)).sum() - 0.5 * pushed @ pushed
        assert (primal - dual) / primal == pytest.approx(model.gap[c], abs=1e-9)
    logreg = linear.fit(features, {**CONFIG, "type": "logreg", "max_iter": 100})
    assert all(r.gradient <= logistic.TOLERANCE * 2 for r in linear.optimality(features, logreg, CONFIG).collect())


def test_few_rows_still_use_the_cores(spark):
    """Rows of one part's size at most are dealt to several parts, whose sums are those of all rows, empty ones included."""
    n = 4 * dense.LEAST_ROWS
    rows = [(i % 3, ([i % 7, 7 + i % 5], [1.0 + i % 2, 0.5]) if i % 11 else ([], [])) for i in range(n)]
    df = spark.createDataFrame(rows, "target int, features struct<indices: array<int>, values: array<double>>")
    parts = dense.packed(df, n)
    assert n <= blocks.PART_ROWS and parts.count() == min(4, spark.sparkContext.defaultParallelism)
    x = np.zeros((n, 12))
    for i, (_, (indices, values)) in enumerate(rows):
        x[i, indices] = values
    y, at = np.array([r[0] for r in rows]), np.random.default_rng(1).normal(size=(2, 13))
    found = dense._summed(parts.rdd, at, lambda target, scores: (scores.sum(axis=1), scores * (target == 1)), 2)
    scores = x @ at[:, :-1].T + at[:, -1]
    pulls = scores * (y == 1)[:, None]
    assert np.allclose(found, np.c_[pulls.T @ x**2, pulls.sum(axis=0), scores.sum(axis=0)])


def test_grid_fits_classifiers_at_once(spark, train, monkeypatch):
    """Both corpora's solvers run at the same time; each cell gets its own model."""
    met, fit = threading.Barrier(4, timeout=60), linear.fit

    def meeting(features, config):
        if config["type"] != "naive_bayes":
            met.wait()
        return fit(features, config)

    monkeypatch.setattr(linear, "fit", meeting)
    evals = train.withColumn("eval_name", F.lit("all"))
    corpora = {"all": (train, evals), "most": (train.where("id < 60"), evals)}
    specs = [{"type": "logreg"}, {"type": "linear_svm"}, {"type": "naive_bayes"}]
    rows = experiments.grid_predictions(corpora, specs, {**CONFIG, "max_iter": 5}, ["eval_name", "id"], ["id"]).groupBy("run_name", "model_type").count().collect()
    assert {(r.run_name, r.model_type): r["count"] for r in rows} == {(f"{c}_{s['type']}", s["type"]): train.count() for c in corpora for s in specs}


def test_parts_hold_little_more_than_their_terms(spark):
    """An entry whose value is one takes two bytes, and what scales rows or terms isn't repeated by entry."""
    n, size = 3000, 300
    rng = np.random.default_rng(5)
    picked = [np.sort(rng.choice(size, 40, replace=False)) for _ in range(n)]
    values = [np.where(rng.random(40) < 0.2, 1 + math.log(2 + i % 3), 1.0) for i in range(n)]
    scales = rng.random(n)
    rows = [(i % 3, (p.tolist(), v.tolist()), float(s)) for i, (p, v, s) in enumerate(zip(picked, values, scales))]
    df = spark.createDataFrame(rows, "target int, features struct<indices: array<int>, values: array<double>>, scale double").repartition(3)
    parts = dense.packed(df, n, F.col("scale"))
    held = sum(sum(len(r[c]) for c in dense.ARRAYS) for r in parts.collect())
    assert held < 4 * 40 * n  # 12 bytes an entry before
    x = np.zeros((n, size))
    for i in range(n):
        x[i, picked[i]] = values[i] * scales[i]
    at = rng.normal(size=(3, size + 1))
    found = dense._summed(dense.dealt(parts), at, lambda target, scores: ((scores**2).sum(axis=1), scores * (target == 2)), 1)
    scores = x @ at[:, :-1].T + at[:, -1]
    pulls = scores * (np.arange(n) % 3 == 2)[:, None]
    assert np.allclose(found, np.c_[pulls.T @ x, pulls.sum(axis=0), (scores**2).sum(axis=0)])


def test_passes_get_as_many_parts_each(spark, monkeypatch):
    """Parts are dealt evenly to tasks, however files of them are read, and classifiers of one corpus share them."""
    monkeypatch.setattr(blocks, "PART_ROWS", 15)
    cores = spark.sparkContext.defaultParallelism
    n = 15 * (dense.CORE_TASKS * cores + 1)
    rows = [(i % 3, ([i % 7], [1.0])) for i in range(n)]
    df = spark.createDataFrame(rows, "target int, features struct<indices: array<int>, values: array<double>>")
    dealt = dense.dealt(dense.packed(df, n).cache())
    assert dealt.glom().map(len).collect() == [2] * (dense.CORE_TASKS * cores)
    train = spark.createDataFrame(corpus(), "id long, text string, label string")
    features = linear.build_features(train, ["id"], CONFIG)
    with features.dealt() as first, features.dealt() as second:
        assert first is second and first.is_cached
    assert not first.is_cached


def test_known_terms_of_odd_texts(spark):
    """Ids, frequencies and squares by text: unknown terms go, texts without known ones stay, keys may repeat or be null."""
    rows = [(1, "aa bb aa", "x"), (1, "cc aa", "y"), (2, "! ?", "y"), (3, None, "x"), (None, "zz", "x"), (None, "bb cc", "x")]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    numbered = spark.createDataFrame([(1, "bb", 3.0), (0, "aa", 2.0), (2, "cc", 1.5)], "term_id int, term string, idf double")
    counted = tfidf.counted_texts(df, ["id"], (1, 1), ["label"])
    found = {(r.id, r.label): (dict(zip(r.indices, r["values"])), r.squares) for r in tfidf.known_terms(counted, numbered, ["id", "label"]).collect()}
    twice = 1 + math.log(2)
    assert found == {
        (1, "x"): ({0: pytest.approx(twice), 1: 1.0}, pytest.approx(4 * twice**2 + 9)), (1, "y"): ({0: 1.0, 2: 1.0}, 6.25),
        (2, "y"): ({}, 0.0), (3, "x"): ({}, 0.0), (None, "x"): ({1: 1.0, 2: 1.0}, 11.25),
    }


@pytest.mark.parametrize("kind", ["logreg", "linear_svm"])
def test_optimality_exchanges_sums_and_no_entries(spark, train, kind, monkeypatch):
    """Under a bounded vocabulary the gradient's shares are those of the joins, without a row of the exchange for each (text, term)."""
    config = {**CONFIG, "type": kind, "max_iter": 4}
    features = linear.build_features(train, ["id"], config)
    model = linear.fit(features, config)
    monkeypatch.setattr(tfidf, "tfidf_weights", None)
    found = linear.optimality(features, model, config).collect()
    monkeypatch.undo()
    monkeypatch.setattr(linear, "_sums_in_batches", linear._sums_in_joins)
    joined = linear.optimality(features, model, config).collect()
    assert [r[:4] for r in found] == [r[:4] for r in joined] and found[0].terms == 40
    assert [r.gradient for r in found] == pytest.approx([r.gradient for r in joined], rel=1e-9) and min(r.gradient for r in found) > 1e-4


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2), (2, 3), (1, 4)])
def test_stored_counts_are_those_of_the_row(spark, ngrams, monkeypatch):
    """Words numbered in Arrow give the counts of the expression, for short, empty, null and accented texts, repeated and null keys."""
    monkeypatch.setattr(tfidf, "COUNTED_AT_ONCE", 2)
    texts = ["bb aa bb aa bb", "aa cc", "! ?", None, "Café", "cafe dd ee dd ee dd", "", "aa\u0000bb naïve ßß 東京 東京 aa", "x yy", "zz " * 50]
    rows = [(i // 2 if i % 5 else None, t, "xy"[i % 3 == 0]) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "id long, text string, label string")

    def counted(table):
        return sorted((str(r.id), r.label, sorted((c.term, c.tf) for c in r.counts)) for r in table.collect())

    expected = counted(tfidf.counted_texts(df, ["id"], ngrams, ["label"]))
    stored = tfidf.stored_counts(df, ["id"], ngrams, ["label"])
    assert counted(stored) == expected and any(c for _, _, c in expected)
    assert dict(stored.dtypes) == dict(tfidf.counted_texts(df, ["id"], ngrams, ["label"]).dtypes)
    assert sorted(map(str, tfidf.exploded(stored).collect())) == sorted(map(str, tfidf.doc_terms(df, ["id"], ngrams, ["label"]).collect()))
