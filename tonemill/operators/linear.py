"""Linear text classifiers: multinomial naive Bayes, logistic regression, linear SVM.

All three end up as the same kind of model, a term table with one coefficient
per class plus intercepts, so scoring is one join and one aggregation whatever
the estimator was.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.functions.arrays import argmax, decode, softmax
from tonemill.operators import blocks, dense, logistic, svm, tfidf
from tonemill.runtime import work_table

# Buckets in which the terms of a vocabulary are numbered side by side.
ID_BUCKETS = 256
# Classifiers fitted at once: each pass of a solver is a short job that leaves cores free, and the driver holds each one's steps.
FITTED_AT_ONCE = 4


@dataclass(frozen=True)
class TermModel:
    """``terms`` is (term, idf, coef_<class>...); ``classes`` are sorted; ``kind`` is ``prob`` or ``score``.

    ``gap`` is the duality gap of each class as a share of its objective, where the solver certifies one.
    """

    model_type: str
    kind: str
    classes: tuple[str, ...]
    intercepts: tuple[float, ...]
    terms: DataFrame
    ngrams: tuple[int, int]
    max_features: int | None
    gap: tuple[float, ...] | None = None


def class_counts(docs: DataFrame, label: str = "label") -> dict[str, int]:
    """Rows per class present in training, in class order."""
    rows = docs.groupBy(label).agg(F.count("*").alias("n")).collect()
    return {r[label]: r["n"] for r in sorted(rows, key=lambda r: r[label])}


def class_weights(counts: Mapping[str, int], class_weight: str | Mapping[str, float] | None) -> dict[str, float]:
    """``balanced`` gives n / (classes x class size); a mapping is taken as is; default 1."""
    if class_weight is None:
        return {c: 1.0 for c in counts}
    if class_weight == "balanced":
        total = sum(counts.values())
        return {c: total / (len(counts) * n) for c, n in counts.items()}
    return {c: float(class_weight.get(c, 1.0)) for c in counts}


@dataclass
class Features:
    """Term counts by text, vocabulary and class sizes of one training corpus, shared by all classifiers."""

    texts: DataFrame
    vocabulary: DataFrame
    counts: dict[str, int]
    keys: list[str]
    ngrams: tuple[int, int]
    max_features: int | None
    _users: int = 0
    _lock: Any = field(default_factory=threading.Lock)

    @cached_property
    def terms(self) -> DataFrame:
        """(keys..., label, term, tf)."""
        return tfidf.exploded(self.texts)

    @property
    def classes(self) -> list[str]:
        return list(self.counts)

    @cached_property
    def numbered(self) -> DataFrame:
        """Vocabulary with ids 0..V-1: in term order within hash buckets, which follow each other."""
        bucketed = self.vocabulary.select("term", "idf", F.pmod(F.xxhash64("term"), F.lit(ID_BUCKETS)).alias("_bucket"))
        before = F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
        offsets = bucketed.groupBy("_bucket").count().select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
        place = F.row_number().over(Window.partitionBy("_bucket").orderBy("term")) - 1
        numbered = bucketed.withColumn("_place", place).join(offsets, "_bucket")
        numbered = work_table(numbered.select((F.col("_before") + F.col("_place")).cast("int").alias("term_id"), "term", "idf"), "numbered")
        if numbered.isEmpty():
            raise ValueError("The vocabulary is empty.")
        return numbered

    @cached_property
    def factors(self) -> np.ndarray:
        """The idf of a bounded vocabulary by term id, and one for the intercept."""
        table = self.numbered.select("term_id", "idf").toArrow()
        found = np.ones(table.num_rows + 1)
        found[table["term_id"].to_numpy()] = table["idf"].to_numpy()
        return found

    def _target(self) -> Column:
        index = F.create_map(*[F.lit(x) for i, c in enumerate(self.classes) for x in (c, i)])
        return index[F.col("label")].alias("target")

    def _rows(self) -> DataFrame:
        """(target, features, scale) of all texts under a bounded vocabulary: ``scale`` times ``features`` times idf are the weights."""
        known = tfidf.known_terms(self.texts, self.numbered, [*self.keys, "label"])
        # Texts that share their keys share a norm, whatever their labels.
        norm = F.sqrt(F.sum("squares").over(Window.partitionBy(*self.keys)))
        scale = F.coalesce(F.try_divide(F.lit(1.0), norm), F.lit(0.0)).alias("scale")
        return known.select(self._target(), F.struct("indices", "values").alias("features"), scale)

    @cached_property
    def parts(self) -> DataFrame:
        """The sparse rows of all texts in parts, for solvers whose coefficients are bounded: without idf, which ``factors`` hold."""
        return work_table(dense.packed(self._rows(), sum(self.counts.values()), F.col("scale")), "parts")

    @cached_property
    def _dealt(self) -> RDD:
        return dense.dealt(self.parts)

    @contextmanager
    def dealt(self) -> Iterator[RDD]:
        """The parts as passes take them, kept until their last user leaves."""
        with self._lock:
            self._users += 1
            found = self._dealt
        try:
            yield found
        finally:
            with self._lock:
                self._users -= 1
                if not self._users:
                    del self._dealt
                    found.unpersist()

    @cached_property
    def layout(self) -> blocks.Layout:
        """The same rows with their terms in blocks, for coefficients without a bound."""
        weighted = tfidf.tfidf_weights(self.terms, self.numbered, self.keys, self.max_features, keep_empty=True)
        rows = feature_rows(weighted, self.keys).select(self._target(), F.struct("indices", "values").alias("features"))
        return blocks.lay_out(rows, sum(self.counts.values()))


def build_features(docs: DataFrame, keys: list[str], config: Mapping[str, Any] | None = None) -> Features:
    """Features of (keys..., text, label) under the configured vocabulary.

    The term counts are stored, so texts are folded and split once, however many
    passes and classifiers follow. ``keys`` have to be unique.
    """
    config = dict(config or {})
    ngrams = tuple(config.get("ngram_range") or (1, 2))
    max_features = config.get("max_features")
    texts = tfidf.stored_counts(docs, keys, ngrams, carry=["label"])
    vocabulary = tfidf.fit_vocabulary(tfidf.exploded(texts), docs, config.get("min_df", 1), max_features)
    return Features(texts, work_table(vocabulary, "vocabulary"), class_counts(docs), keys, ngrams, max_features)


def fit(features: Features, config: Mapping[str, Any] | None = None) -> TermModel:
    """Fit the configured classifier."""
    config = dict(config or {})
    kind = config.get("type", "logreg")
    if kind not in C.MODEL_TYPES:
        raise ValueError(f"No classifier is called '{kind}'; choose one of {', '.join(C.MODEL_TYPES)}.")
    if kind == "naive_bayes":
        return _fit_bayes(features, float(config.get("alpha", 1.0)))
    return _fit_dense(kind, features, config)


def fit_all(cells: Sequence[tuple[Features, Mapping[str, Any]]]) -> list[TermModel]:
    """The classifier of each (features, config), some fitted at once; see ``fit``."""
    with ThreadPoolExecutor(FITTED_AT_ONCE) as pool, ExitStack() as held:
        for features, config in cells:  # a corpus's classifiers share their rows, which are made before they start
            if config.get("type", "logreg") != "naive_bayes" and len(features.classes) > 1:
                if tfidf.is_bounded(features.max_features):
                    held.enter_context(features.dealt())
                else:
                    _ = features.layout
        # Each call inherits the caller's job properties, by a wrapper of its own.
        return [f.result() for f in [pool.submit(inheritable_thread_target(features.texts.sparkSession)(fit), features, config) for features, config in cells]]


# --- naive Bayes --------------------------------------------------------------


def bayes_terms(weighted: DataFrame, classes: list[str], alpha: float) -> DataFrame:
    """(term, idf, coef_<class>...): smoothed log share of each class's weight mass."""
    mass = weighted.groupBy("term", "idf").agg(
        *[F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(0.0)).alias(f"_m_{c}") for c in classes]
    )
    totals = mass.agg(
        F.count("*").alias("_v"), *[F.sum(f"_m_{c}").alias(f"_t_{c}") for c in classes]
    )
    return mass.crossJoin(F.broadcast(totals)).select(
        "term",
        "idf",
        *[
            F.log((F.col(f"_m_{c}") + alpha) / (F.col(f"_t_{c}") + alpha * F.col("_v"))).alias(f"coef_{c}")
            for c in classes
        ],
    )


def _fit_bayes(features: Features, alpha: float) -> TermModel:
    vocabulary = features.vocabulary.select("term", "idf")
    weighted = tfidf.tfidf_weights(features.terms, vocabulary, features.keys, features.max_features)
    table = work_table(bayes_terms(weighted, features.classes, alpha), "bayes")
    total = sum(features.counts.values())
    priors = tuple(math.log(n / total) for n in features.counts.values())
    return _model("naive_bayes", "prob", features, priors, table)


def _model(kind: str, scores: str, features: Features, intercepts, terms: DataFrame) -> TermModel:
    return TermModel(
        kind, scores, tuple(features.classes), tuple(float(b) for b in intercepts), terms,
        features.ngrams, features.max_features,
    )


# --- logistic regression and SVM ----------------------------------------------


def feature_rows(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., label, indices, values): one sparse row per text, empty for texts without known terms."""
    entries = F.array_sort(F.collect_list(F.when(F.col("term_id").isNotNull(), F.struct("term_id", "weight"))))
    rows = weighted.groupBy(*keys, "label").agg(entries.alias("_e"))
    return rows.select(
        *keys,
        "label",
        F.transform("_e", lambda e: e["term_id"]).alias("indices"),
        F.transform("_e", lambda e: e["weight"]).alias("values"),
    )


def _fit_dense(kind: str, features: Features, config: Mapping[str, Any]) -> TermModel:
    classes = features.classes
    if len(classes) < 2:
        raise ValueError("A discriminative classifier needs at least two classes.")
    weights = list(class_weights(features.counts, config.get("class_weight")).values())
    penalty, gap = float(config.get("C", 1.0)), None
    if tfidf.is_bounded(features.max_features):
        with features.dealt() as data:
            if kind == "logreg":
                coefficients, intercepts = dense.fit_logistic(data, features.factors, len(classes), weights, penalty, config.get("max_iter", 300))
            else:
                coefficients, intercepts, certificate = dense.fit_svm(data, features.factors, len(classes), weights, penalty, config.get("max_iter", 200))
        found = dense.term_rows(features.texts.sparkSession, coefficients)
    else:
        if kind == "logreg":
            vectors, intercepts = logistic.solve(features.layout, len(classes), weights, penalty, config.get("max_iter", 300))
        else:
            vectors, intercepts, certificate = svm.solve(features.layout, len(classes), weights, penalty, config.get("max_iter", 200))
        found = blocks.term_rows(vectors, len(intercepts))
    if kind != "logreg":
        gap = tuple(certificate.gap.tolist())
    width = len(intercepts)
    if width < len(classes):
        # One row, for the second class; the first class scores zero.
        found, intercepts, width = found.withColumns({"c1": F.col("c0"), "c0": F.lit(0.0)}), [0.0, intercepts[0]], 2
    named = [F.coalesce(F.col(f"c{i}"), F.lit(0.0)).alias(f"coef_{c}") for i, c in enumerate(classes)]
    joined = features.numbered.join(found, "term_id", "left").select("term", "idf", *named)
    model = _model(kind, "prob" if kind == "logreg" else "score", features, intercepts, work_table(joined, kind))
    return replace(model, gap=gap)


# --- scoring ------------------------------------------------------------------


def score(docs: DataFrame, model: TermModel, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """(keys..., carry..., prediction, prob_/score_ per label in canonical order).

    A label unseen in training has a null column. Unknown terms are ignored; a
    text without known terms gets the intercepts. ``keys`` have to be unique: rows
    that share them are scored as one text.
    """
    return score_terms(tfidf.doc_terms(docs, keys, model.ngrams, carry), {"": model}, keys, carry).drop("model")


def stored_terms(docs: DataFrame, keys: list[str], ngrams: tuple[int, int], carry: list[str] | None = None) -> DataFrame:
    """The term counts of ``docs``, written once for any number of scoring passes."""
    return tfidf.exploded(tfidf.stored_counts(docs, keys, ngrams, carry))


def score_terms(terms: DataFrame, models: Mapping[str, TermModel], keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """(model, keys..., carry..., prediction, prob_/score_ columns) of stored term counts, for several models in one pass.

    The models come from one corpus: they share its vocabulary, n-grams and classes.
    Their coefficients are laid side by side, so terms are joined and summed once.
    """
    carry, first = carry or [], next(iter(models.values()))
    stacked = None
    for number, model in enumerate(models.values()):
        part = model.terms.select("term", "idf", *[F.col(f"coef_{c}").alias(f"_c_{number}_{c}") for c in model.classes])
        stacked = part if stacked is None else stacked.join(part.drop("idf"), "term")
    joined = terms.join(tfidf.bounded(stacked, first.max_features), "term", "left")
    raw = tfidf.raw_weight()
    sums = joined.groupBy(*keys, *carry).agg(
        F.sqrt(F.sum(raw * raw)).alias("_norm"),
        *[F.sum(raw * F.col(f"_c_{n}_{c}")).alias(f"_s_{n}_{c}") for n, m in enumerate(models.values()) for c in m.classes],
    )
    kinds = sorted({m.kind for m in models.values()})
    rows = []
    for number, (name, model) in enumerate(models.items()):
        scores = F.array(
            *[
                F.coalesce(F.try_divide(F.col(f"_s_{number}_{c}"), F.col("_norm")), F.lit(0.0)) + F.lit(b)
                for c, b in zip(model.classes, model.intercepts)
            ]
        )
        rows.append(F.struct(F.lit(name).alias("model"), F.lit(model.kind).alias("_kind"), scores.alias("_scores")))
    scored = sums.select(*keys, *carry, F.inline(F.array(*rows)))
    scored = scored.withColumn("_out", F.when(F.col("_kind") == "prob", softmax(F.col("_scores"))).otherwise(F.col("_scores")))
    return scored.select(
        "model",
        *keys,
        *carry,
        decode(argmax(F.col("_scores")), first.classes).alias("prediction"),
        *[_class_column(kind, label, first.classes) for kind in kinds for label in C.LABELS],
    )


def _class_column(kind: str, label: str, classes: tuple[str, ...]) -> Column:
    name = f"{kind}_{label}"
    if label not in classes:
        return F.lit(None).cast("double").alias(name)
    return F.when(F.col("_kind") == kind, F.col("_out")[classes.index(label)]).alias(name)


def attach(docs: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions next to their rows."""
    return docs.join(scored, keys)


# --- optimality ---------------------------------------------------------------


def optimality(features: Features, model: TermModel, config: Mapping[str, Any]) -> DataFrame:
    """(label, rows, class_weight, terms, gradient): how far each class's part of a dense model is from the optimum.

    ``gradient`` is the length of the objective's gradient at the model, as a share of
    its length at zero, computed from the stored features in one pass.
    """
    classes = list(model.classes)
    weights, penalty = class_weights(features.counts, config.get("class_weight")), float(config.get("C", 1.0))
    coefficients = model.terms.select("term", *[f"coef_{c}" for c in classes])
    sums = _sums_in_batches if tfidf.is_bounded(features.max_features) else _sums_in_joins
    per_term, biases = sums(features, model, coefficients, weights)
    lengths = per_term.agg(
        F.count("*").alias("terms"),
        *[F.sum(F.pow(penalty * F.col(f"_p{n}") + F.col(f"coef_{c}"), 2)).alias(f"_g{n}") for n, c in enumerate(classes)],
        *[F.sum(F.pow(penalty * F.col(f"_z{n}"), 2)).alias(f"_h{n}") for n in range(len(classes))],
    )
    both = lengths.crossJoin(F.broadcast(biases))  # one row each
    rows = []
    for n, (c, b) in enumerate(zip(classes, model.intercepts)):
        bias = penalty * F.col(f"_bp{n}") + (0.0 if model.kind == "prob" else b)
        share = F.sqrt((F.col(f"_g{n}") + bias * bias) / (F.col(f"_h{n}") + F.pow(penalty * F.col(f"_bz{n}"), 2)))
        rows.append(F.struct(F.lit(c).alias("label"), F.lit(features.counts[c]).alias("rows"), F.lit(weights[c]).alias("class_weight"), "terms", share.alias("gradient")))
    return both.select(F.inline(F.array(*rows)))


def _sums_in_joins(features: Features, model: TermModel, coefficients: DataFrame, weights: Mapping[str, float]) -> tuple[DataFrame, DataFrame]:
    """(term, sums _p0.. and _z0.., coefficients) and (_bp0.., _bz0..): the loss's derivatives at the model and at zero by class."""
    classes = list(model.classes)
    weighted = tfidf.tfidf_weights(
        features.terms, features.vocabulary.select("term", "idf"), features.keys, features.max_features, keep_empty=True
    )
    known = weighted.join(tfidf.bounded(coefficients, model.max_features), "term", "left")
    margins = known.groupBy(*features.keys, "label").agg(
        F.array(
            *[
                F.coalesce(F.sum(F.col("weight") * F.col(f"coef_{c}")), F.lit(0.0)) + F.lit(b)
                for c, b in zip(classes, model.intercepts)
            ]
        ).alias("_margins")
    )
    weight = F.element_at(F.create_map(*[F.lit(x) for c in classes for x in (c, weights[c])]), F.col("label"))

    def pull(values: Column, number: int) -> Column:
        own = F.col("label") == classes[number]
        if model.kind == "prob":
            return weight * (softmax(values)[number] - own.cast("double"))
        sign = F.when(own, 1.0).otherwise(-1.0)
        return -2.0 * weight * sign * F.greatest(F.lit(0.0), 1.0 - sign * values[number])

    zero = F.array(*[F.lit(0.0) for _ in classes])
    pulls = margins.select(
        *features.keys,
        *[pull(F.col("_margins"), n).alias(f"_p{n}") for n in range(len(classes))],
        *[pull(zero, n).alias(f"_z{n}") for n in range(len(classes))],
    )
    sums = [F.sum(F.col("weight") * F.col(f"_{k}{n}")).alias(f"_{k}{n}") for k in "pz" for n in range(len(classes))]
    per_term = weighted.where(F.col("weight").isNotNull()).join(pulls, features.keys).groupBy("term").agg(*sums).join(coefficients, "term")
    return per_term, pulls.agg(*[F.sum(f"_{k}{n}").alias(f"_b{k}{n}") for k in "pz" for n in range(len(classes))])


def _sums_in_batches(features: Features, model: TermModel, coefficients: DataFrame, weights: Mapping[str, float]) -> tuple[DataFrame, DataFrame]:
    """The same under a bounded vocabulary: each task adds up its texts' rows, and only its sums by term are exchanged."""
    classes, names = list(model.classes), [f"_{k}{n}" for k in "pz" for n in range(len(model.classes))]
    table = features.numbered.join(coefficients, "term").select("term_id", *[f"coef_{c}" for c in classes]).toArrow()
    size, width, prob, step = len(features.factors), len(classes), model.kind == "prob", dense.SLICE
    factors, at, weight = features.factors[:-1], np.zeros((width, size - 1)), np.array([weights[c] for c in classes])
    at[:, table["term_id"].to_numpy()] = [table[f"coef_{c}"].to_numpy() for c in classes]
    intercepts = np.array(model.intercepts)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def pulls(margins, target):
            own = target == np.arange(width)[:, None]
            if prob:
                shares = np.exp(margins - margins.max(axis=0))
                return weight[target] * (shares / shares.sum(axis=0) - own)
            sign = np.where(own, 1.0, -1.0)
            return -2.0 * weight[target] * sign * np.maximum(0.0, 1.0 - sign * margins)

        total, met = np.zeros((2 * width, size)), np.zeros(size, bool)
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                target = batch.column("target").to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(target)), np.diff(batch.column("indices").offsets.to_numpy()))
                terms = batch.column("indices").flatten().to_numpy(zero_copy_only=False)
                values = batch.column("values").flatten().to_numpy(zero_copy_only=False) * factors[terms]
                values = values * batch.column("scale").to_numpy(zero_copy_only=False)[owner]
                margins = np.array([np.bincount(owner, values * at[c, terms], minlength=len(target)) for c in range(width)]) + intercepts
                found = np.concatenate([pulls(margins, target), pulls(np.zeros_like(margins), target)])
                for c in range(2 * width):
                    total[c, :-1] += np.bincount(terms, values * found[c, owner], minlength=size - 1)
                total[:, -1] += found.sum(axis=1)
                met[terms] = met[-1] = True
        ids = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *[pa.array(t[ids]) for t in total]], names=["term_id", *names])

    rows = features._rows().select("target", "features.indices", "features.values", "scale")
    met = rows.mapInArrow(run, ", ".join(["term_id int", *[f"{n} double" for n in names]]))
    sums = work_table(met.groupBy("term_id").agg(*[F.sum(n).alias(n) for n in names]), "sums")  # a row a term, and the intercept's
    per_term = sums.join(F.broadcast(features.numbered.select("term_id", "term")), "term_id").drop("term_id").join(coefficients, "term")
    return per_term, sums.where(F.col("term_id") == size - 1).select(*[F.col(n).alias(f"_b{n[1:]}") for n in names])
