"""TF-IDF features and statistical classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.catalog import inputs as I
from tonemill.catalog import snippets as S
from tonemill.functions.accents import fold_accents
from tonemill.operators import linear, metrics, splits, tfidf
from tonemill.plans.experiments import grid_predictions, statistical_grid
from tonemill.runtime import work_table

CONFIG = {"max_features": 20000, "min_df": 2, "ngram_range": [1, 2], "C": 2.0, "max_iter": 500, "class_weight": "balanced"}
KEYS = ["doc_id"]


def fold_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return docs.select("doc_id", fold_accents(F.col("text")).alias("folded"))


def _terms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = I.labelled_documents(spark, sf).select("doc_id", "text")
    return docs, tfidf.doc_terms(docs, KEYS)


def tfidf_vocab(spark: SparkSession, sf: str) -> DataFrame:
    docs, terms = _terms(spark, sf)
    vocabulary = tfidf.fit_vocabulary(terms, docs.select("doc_id"), CONFIG["min_df"], CONFIG["max_features"])
    return vocabulary.withColumn("idf", F.round("idf", 6))


def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    docs, terms = _terms(spark, sf)
    vocabulary = tfidf.fit_vocabulary(terms, docs.select("doc_id"), CONFIG["min_df"], CONFIG["max_features"])
    weights = tfidf.tfidf_weights(terms, vocabulary, KEYS, CONFIG["max_features"])
    return weights.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def divided(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with an exact 70/15/15 split."""
    docs = I.labelled_documents(spark, sf)
    return splits.stratified_split(docs, "doc_id", "label", ["train", "val", "test"], [0.30, 0.50])


def _train_and_evals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = work_table(divided(spark, sf), "divided")
    train = rows.where("split = 'train'").select("doc_id", "text", "label")
    evals = rows.where("split <> 'train'").select(F.col("split").alias("eval_name"), "doc_id", "text", "label")
    return train, evals


def _predicted(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    train, evals = _train_and_evals(spark, sf)
    config = {**CONFIG, "type": kind, "alpha": 1.0}
    model = linear.fit(linear.build_features(train, KEYS, config), config)
    return linear.score(evals, model, ["eval_name", "doc_id"], carry=["label"])


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n, t in df.dtypes if t == "double"})


def nb_model(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _train_and_evals(spark, sf)
    model = linear.fit(linear.build_features(train, KEYS, CONFIG), {"type": "naive_bayes"})
    return _rounded(model.terms)


def nb_predict(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_predicted(spark, sf, "naive_bayes"))


def nb_eval(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.evaluation_summary(_predicted(spark, sf, "naive_bayes"), ["eval_name"]))


def logreg_predict(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_predicted(spark, sf, "logreg"), 4)


def svm_predict(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_predicted(spark, sf, "linear_svm"), 3)


SPECS = [{"type": "logreg"}, {"type": "linear_svm"}, {"type": "naive_bayes", "alpha": 1.0}]
# A solver has converged when the gradient's length has shrunk to this share of its length at zero.
CONVERGED = 0.01
#: The largest duality gap, as a share of the objective, at which a solution counts as certified.
CERTIFIED = 1e-3


def _optimality(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Per class of a trained model: rows, weight, terms, and whether its gradient vanishes."""
    train, _ = _train_and_evals(spark, sf)
    config = {**CONFIG, "type": kind}
    features = linear.build_features(train, KEYS, config)
    model = linear.fit(features, config)
    found = linear.optimality(features, model, config).select(
        "label", F.col("rows").cast("long").alias("rows"), F.round("class_weight", 6).alias("class_weight"), "terms", (F.col("gradient") <= CONVERGED).alias("optimal")
    )
    return found if model.gap is None else found.withColumn("certified", F.lit(max(model.gap) <= CERTIFIED))


def logreg_optimality(spark: SparkSession, sf: str) -> DataFrame:
    return _optimality(spark, sf, "logreg")


def svm_optimality(spark: SparkSession, sf: str) -> DataFrame:
    return _optimality(spark, sf, "linear_svm")


def _grid(spark: SparkSession, sf: str) -> tuple:
    rows = work_table(domain_splits(spark, sf), "domains")
    evals = rows.where("split = 'test'").select(
        F.concat_ws("_", "domain", "split").alias("eval_name"), "doc_id", "text", "label"
    )
    corpora = {
        name: (rows.where((F.col("domain") == name) & (F.col("split") == "train")).select("doc_id", "text", "label"), evals)
        for name in I.DOMAINS
    }
    return corpora, SPECS, CONFIG, ["eval_name", "doc_id"], KEYS


def model_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Two training domains x three models x each domain's test set."""
    return _rounded(statistical_grid(*_grid(spark, sf)), 4)


def model_grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each cell of the grid: rows, rows of each true label, and rows with a label predicted."""
    cells = metrics.cell_counts(grid_predictions(*_grid(spark, sf)), ["run_name", "model_type", "train_name", "eval_name"])
    predicted = F.col("predicted_positive") + F.col("predicted_neutral") + F.col("predicted_negative")
    return cells.select(
        "run_name", "model_type", "train_name", "eval_name", "size", *[f"support_{c}" for c in S.LABELS], predicted.alias("predicted")
    )


def domain_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Each domain split 70/15/15 on its own."""
    docs = I.labelled_documents(spark, sf).withColumn("domain", I.domain(F.col("lang")))
    parts = [
        splits.stratified_split(docs.where(F.col("domain") == d), "doc_id", "label", ["train", "val", "test"], [0.30, 0.50])
        for d in I.DOMAINS
    ]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (
    fold_text, tfidf_vocab, tfidf_weights, nb_model, nb_predict, nb_eval, logreg_predict, svm_predict, model_grid,
    logreg_optimality, svm_optimality, model_grid_cells,
)}


def vocabulary_ctes(p: str, train: str, label: str = "") -> str:
    """CTEs {p}tf, {p}vocab and {p}w (weights) of a training relation."""
    keep = f"doc_id, {label}" if label else "doc_id"
    return f"""{p}tf AS (SELECT {keep}, term, count(*) AS tf FROM ({S.feature_terms(train, keep)}) GROUP BY ALL),
{p}vocab AS (
  SELECT term, df, cf, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {p}tf GROUP BY term), (SELECT count(*) AS n FROM {train})
  WHERE df >= 2 ORDER BY cf DESC, term LIMIT 20000),
{p}raw AS (SELECT {p}tf.*, idf, (1 + ln(tf::DOUBLE)) * idf AS raw FROM {p}tf JOIN {p}vocab USING (term)),
{p}w AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM {p}raw)"""


def bayes_ctes(p: str, train: str, evals: str) -> str:
    """CTEs {p}model and {p}pred (eval_name, doc_id, label, prediction, prob_*)."""
    classes = ("negative", "neutral", "positive")
    mass = ", ".join(f"coalesce(sum(weight) FILTER (WHERE label = '{c}'), 0) AS m_{c}" for c in classes)
    coef = ", ".join(f"ln((m_{c} + 1) / (sum(m_{c}) OVER () + count(*) OVER ())) AS coef_{c}" for c in classes)
    dots = ", ".join(f"sum(raw * coef_{c}) / sqrt(sum(raw * raw)) AS d_{c}" for c in classes)
    prior = ", ".join(f"ln(count(*) FILTER (WHERE label = '{c}')::DOUBLE / count(*)) AS p_{c}" for c in classes)
    joint = ", ".join(f"coalesce(d_{c}, 0) + p_{c} AS s_{c}" for c in classes)
    total = " + ".join(f"exp(s_{c} - greatest(s_negative, s_neutral, s_positive))" for c in classes)
    probs = ", ".join(f"exp(s_{c} - greatest(s_negative, s_neutral, s_positive)) / ({total}) AS prob_{c}" for c in classes)
    return f"""{vocabulary_ctes(p, train, 'label')},
{p}model AS (SELECT term, idf, {coef} FROM (SELECT term, idf, {mass} FROM {p}w GROUP BY term, idf)),
{p}etf AS (
  SELECT eval_name, doc_id, term, count(*) AS tf FROM ({S.feature_terms(evals, 'eval_name, doc_id')}) GROUP BY ALL),
{p}dots AS (
  SELECT eval_name, doc_id, {dots}
  FROM (SELECT *, (1 + ln(tf::DOUBLE)) * idf AS raw FROM {p}etf JOIN {p}model USING (term)) GROUP BY eval_name, doc_id),
{p}joint AS (
  SELECT e.eval_name, e.doc_id, e.label, {joint}
  FROM {evals} e LEFT JOIN {p}dots d ON d.eval_name = e.eval_name AND d.doc_id = e.doc_id
  CROSS JOIN (SELECT {prior} FROM {train})),
{p}pred AS (
  SELECT eval_name, doc_id, label,
         CASE WHEN s_negative >= s_neutral AND s_negative >= s_positive THEN 'negative'
              WHEN s_neutral >= s_positive THEN 'neutral' ELSE 'positive' END AS prediction, {probs}
  FROM {p}joint)"""


_PLAIN = "plain AS (SELECT doc_id, text FROM labelled)"
_SPLIT = S.split_ctes("labelled", "divided", "doc_id", ["train", "val", "test"], [0.30, 0.50])
_BAYES = f"""WITH {I.LABELLED}, {_SPLIT},
train AS (SELECT doc_id, text, label FROM divided WHERE split = 'train'),
evals AS (SELECT split AS eval_name, doc_id, text, label FROM divided WHERE split <> 'train'),
{bayes_ctes('b_', 'train', 'evals')}"""
_PROBS = ", ".join(f"round(prob_{c}, 6) AS prob_{c}" for c in S.LABELS)

_TRAIN = f"""WITH {I.LABELLED}, {_SPLIT}, train AS (SELECT doc_id, text, label FROM divided WHERE split = 'train'), {vocabulary_ctes('o_', 'train', 'label')}"""
_OPTIMAL = f"""{_TRAIN}
SELECT label, count(*) AS rows, round((SELECT count(*) FROM train)::DOUBLE / (3 * count(*)), 6) AS class_weight,
       (SELECT count(*) FROM o_vocab) AS terms, TRUE AS optimal
FROM train GROUP BY label"""
_DOMAIN_SPLITS = ", ".join(
    S.split_ctes("labelled", f"{d}_rows", "doc_id", ["train", "val", "test"], [0.30, 0.50], where=f"({I.DOMAIN}) = '{d}'") for d in I.DOMAINS
)
_TESTS = " UNION ALL ".join(f"SELECT '{d}_test' AS eval_name, label FROM {d}_rows WHERE split = 'test'" for d in I.DOMAINS)
_CELLS = f"""WITH {I.LABELLED}, {_DOMAIN_SPLITS}, tests AS ({_TESTS}),
m AS (SELECT * FROM (VALUES ('logreg'), ('linear_svm'), ('naive_bayes')) t(model_type)),
d AS (SELECT * FROM (VALUES ('en'), ('other')) t(train_name))
SELECT train_name || '_' || model_type AS run_name, model_type, train_name, eval_name, count(*) AS size,
       {", ".join(f"count(*) FILTER (WHERE label = '{c}') AS support_{c}" for c in S.LABELS)}, count(*) AS predicted
FROM tests CROSS JOIN m CROSS JOIN d GROUP BY ALL"""

ORACLES = {
    "logreg_optimality": _OPTIMAL,
    "svm_optimality": f"SELECT *, TRUE AS certified FROM ({_OPTIMAL})",
    "model_grid_cells": _CELLS,
    "fold_text": "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents",
    "tfidf_vocab": f"WITH {I.LABELLED}, {_PLAIN}, {vocabulary_ctes('v_', 'plain')} SELECT term, df, cf, round(idf, 6) AS idf FROM v_vocab",
    "tfidf_weights": f"WITH {I.LABELLED}, {_PLAIN}, {vocabulary_ctes('v_', 'plain')} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM v_w",
    "nb_model": f"{_BAYES} SELECT term, round(idf, 6) AS idf, "
    + ", ".join(f"round(coef_{c}, 6) AS coef_{c}" for c in S.LABELS)
    + " FROM b_model",
    "nb_predict": f"{_BAYES} SELECT eval_name, doc_id, label, prediction, {_PROBS} FROM b_pred",
    "nb_eval": f"{_BAYES} SELECT eval_name, size, {S.rounded_metrics()} FROM ({S.evaluation('b_pred', 'eval_name')})",
}
