"""Cross-run reports over evaluations computed from the documents, and training-log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.catalog import inputs as I
from tonemill.catalog import lexicon as L
from tonemill.catalog import models as M
from tonemill.catalog import snippets as S
from tonemill.functions.arrays import argmax, decode, softmax
from tonemill.operators import history, lexicon, linear, manifest, metrics
from tonemill.runtime import work_table


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(run_name, model_type, train_path, eval_name, path, label, prediction): two trained runs and the lexicon,
    each on the validation and test sets of both domains."""
    rows = work_table(M.domain_splits(spark, sf), "domains")
    evals = rows.where("split <> 'train'").select(
        F.concat_ws("_", "domain", "split").alias("eval_name"),
        F.format_string("data/%s/%s.csv", "domain", "split").alias("path"),
        "doc_id",
        "text",
        "label",
    )
    keys, carry = ["eval_name", "doc_id"], ["path", "label"]
    runs = []
    for name in I.DOMAINS:
        train = rows.where((F.col("domain") == name) & (F.col("split") == "train")).select("doc_id", "text", "label")
        model = linear.fit(linear.build_features(train, ["doc_id"], M.CONFIG), {"type": "naive_bayes"})
        scored = linear.score(evals, model, keys, carry)
        runs.append((f"{name}_bayes", "naive_bayes", f"data/{name}/train.csv", scored))
    runs.append(("lexicon", C.LEXICON_MODEL, None, lexicon.score(evals, keys, L._lexicon(spark))))
    union = None
    for run_name, model_type, train_path, scored in runs:
        part = scored.select(
            F.lit(run_name).alias("run_name"),
            F.lit(model_type).alias("model_type"),
            F.lit(train_path).cast("string").alias("train_path"),
            "eval_name",
            "path",
            "label",
            "prediction",
        )
        union = part if union is None else union.unionByName(part)
    return union


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.evaluation_summary(
        _predictions(spark, sf), ["run_name", "model_type", "train_path", "eval_name", "path"]
    )


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    table = manifest.manifest(_summary(spark, sf))
    doubles = [n for n, t in table.dtypes if t == "double"]
    return table.withColumns({n: F.round(n, 6) for n in doubles}).drop(
        "metrics_path", "prediction_path", "confusion_matrix_path", "confusion_figure_path"
    )


def run_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.ordered(_manifest(spark, sf))


def test_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.leaderboard(_manifest(spark, sf))


def generalisation_drop(spark: SparkSession, sf: str) -> DataFrame:
    drop = manifest.generalisation_drop(manifest.manifest(_summary(spark, sf)))
    return drop.withColumns({n: F.round(n, 6) for n, t in drop.dtypes if t == "double"})


def metric_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    summary = _summary(spark, sf).select("run_name", F.col("eval_name").alias("eval_set"), "accuracy", "macro_f1", "weighted_f1")
    return metrics.unpivot_metrics(summary, ["run_name", "eval_set"]).withColumn("score", F.round("score", 6))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """A training log read off the vectors: per run and step, the cross entropy of a training half
    and loss and metrics of an evaluation half; each logged row fills only its own columns."""
    vectors = I.table(spark, sf, "embeddings").select(
        F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("run_name"),
        F.floor(F.col("vec_id") / 50).cast("long").alias("step"),
        (F.col("label") < 5).alias("training"),
        (F.col("label") % 3).alias("truth"),
        I.logits().alias("logits"),
    )
    vectors = vectors.withColumn("_loss", -F.log(F.get(softmax(F.col("logits")), F.col("truth"))))
    train = vectors.where("training").groupBy("run_name", "step").agg(F.avg("_loss").alias("loss"))
    held = vectors.where("NOT training")
    named = held.select(
        "run_name", "step", decode(F.col("truth")).alias("label"), decode(argmax(F.col("logits"))).alias("prediction")
    )
    scores = metrics.evaluation_summary(named, ["run_name", "step"]).select(
        "run_name",
        "step",
        F.col("accuracy").alias("eval_accuracy"),
        F.col("macro_f1").alias("eval_macro_f1"),
        F.col("weighted_f1").alias("eval_weighted_f1"),
    )
    losses = held.groupBy("run_name", "step").agg(F.avg("_loss").alias("eval_loss"))
    return train.unionByName(losses.join(scores, ["run_name", "step"]), allowMissingColumns=True)


def loss_series(spark: SparkSession, sf: str) -> DataFrame:
    return history.loss_series(_history(spark, sf), ["run_name"]).withColumn("value", F.round("value", 6))


def metric_series(spark: SparkSession, sf: str) -> DataFrame:
    return history.metric_series(_history(spark, sf), ["run_name"]).withColumn("value", F.round("value", 6))


def best_step(spark: SparkSession, sf: str) -> DataFrame:
    # Rounded first, so that equal scores tie in every engine.
    log = _history(spark, sf)
    log = log.withColumns({n: F.round(n, 6) for n, t in log.dtypes if t == "double"})
    return history.best_steps(log, ["run_name"])


QUERIES = {f.__name__: f for f in (
    run_manifest, test_leaderboard, generalisation_drop, metric_unpivot, loss_series, metric_series, best_step,
)}


def _domain_ctes() -> str:
    parts = [I.LABELLED]
    for d in I.DOMAINS:
        parts.append(
            S.split_ctes("labelled", f"{d}_rows", "doc_id", ["train", "val", "test"], [0.30, 0.50], where=f"({I.DOMAIN}) = '{d}'")
        )
    union = " UNION ALL ".join(
        f"SELECT '{d}_' || split AS eval_name, 'data/{d}/' || split || '.csv' AS path, doc_id, text, label "
        f"FROM {d}_rows WHERE split <> 'train'"
        for d in I.DOMAINS
    )
    parts.append(f"evals AS ({union})")
    for d in I.DOMAINS:
        parts.append(f"{d}_train AS (SELECT doc_id, text, label FROM {d}_rows WHERE split = 'train')")
        parts.append(M.bayes_ctes(f"{d}_b_", f"{d}_train", "evals"))
    parts += [L.LEX, L.scored_cte("evals", "lex")]
    runs = [
        f"SELECT '{d}_bayes' AS run_name, 'naive_bayes' AS model, '{d}' AS train_domain, eval_name, label, prediction FROM {d}_b_pred"
        for d in I.DOMAINS
    ]
    runs.append(f"SELECT 'lexicon', '{C.LEXICON_MODEL}', 'none', eval_name, label, prediction FROM scored")
    parts.append(f"preds AS ({' UNION ALL '.join(runs)})")
    parts.append(f"summary AS ({S.evaluation('preds', 'run_name, model, train_domain, eval_name')})")
    parts.append(
        """man AS (
  SELECT run_name, model, train_domain, eval_name, split_part(eval_name, '_', 1) AS eval_domain,
         split_part(eval_name, '_', 2) AS eval_split,
         CASE WHEN train_domain = 'none' THEN 'lexicon_eval' WHEN train_domain = split_part(eval_name, '_', 1) THEN 'in_domain'
              ELSE 'cross_domain' END AS setting, accuracy, macro_f1, weighted_f1 FROM summary)"""
    )
    return "WITH " + ",\n".join(parts)


_MAN = _domain_ctes()
_THREE = S.rounded_metrics(("accuracy", "macro_f1", "weighted_f1"))
_COLS = f"run_name, model, train_domain, eval_name, eval_domain, eval_split, setting, {_THREE}"

_TOP = "greatest(a, b, c)"
_HIST = f"""WITH v AS (
  SELECT CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS run_name, floor(vec_id / 50)::BIGINT AS step, label < 5 AS training,
         label % 3 AS truth, {I.LOGITS} FROM embeddings),
l AS (SELECT *, -ln(exp(CASE truth WHEN 0 THEN a WHEN 1 THEN b ELSE c END - {_TOP})
                    / (exp(a - {_TOP}) + exp(b - {_TOP}) + exp(c - {_TOP}))) AS loss FROM v),
ev AS (SELECT run_name, step, CASE truth WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS label,
              CASE WHEN a >= b AND a >= c THEN 'positive' WHEN b >= c THEN 'neutral' ELSE 'negative' END AS prediction
       FROM v WHERE NOT training),
tr AS (SELECT run_name, step, round(avg(loss), 6) AS loss FROM l WHERE training GROUP BY run_name, step),
el AS (SELECT run_name, step, round(avg(loss), 6) AS eval_loss FROM l WHERE NOT training GROUP BY run_name, step),
em AS (SELECT run_name, step, {_THREE} FROM ({S.evaluation('ev', 'run_name, step')}))"""

ORACLES = {
    "run_manifest": f"{_MAN} SELECT {_COLS} FROM man",
    "test_leaderboard": f"{_MAN} SELECT {_COLS} FROM man WHERE eval_split = 'test'",
    "generalisation_drop": f"""{_MAN}, t AS (SELECT * FROM man WHERE eval_split = 'test' AND train_domain <> 'none'),
        i AS (SELECT run_name, max(macro_f1) AS inside FROM t WHERE setting = 'in_domain' GROUP BY run_name)
        SELECT run_name, model, train_domain, eval_domain AS cross_eval_domain, round(inside, 6) AS in_domain_macro_f1,
               round(macro_f1, 6) AS cross_domain_macro_f1, round(inside - macro_f1, 6) AS generalisation_drop
        FROM t JOIN i USING (run_name) WHERE setting = 'cross_domain'""",
    "metric_unpivot": f"""{_MAN}
        SELECT run_name, eval_name AS eval_set, 'Accuracy' AS metric, round(accuracy, 6) AS score FROM man
        UNION ALL SELECT run_name, eval_name, 'Macro-F1', round(macro_f1, 6) FROM man
        UNION ALL SELECT run_name, eval_name, 'Weighted-F1', round(weighted_f1, 6) FROM man""",
    "loss_series": f"""{_HIST}
        SELECT run_name, step, 'Train Loss' AS series, loss AS value FROM tr
        UNION ALL SELECT run_name, step, 'Eval Loss', eval_loss FROM el""",
    "metric_series": f"""{_HIST}
        SELECT run_name, step, 'Eval Accuracy' AS series, accuracy AS value FROM em
        UNION ALL SELECT run_name, step, 'Eval Macro-F1', macro_f1 FROM em
        UNION ALL SELECT run_name, step, 'Eval Weighted-F1', weighted_f1 FROM em""",
    "best_step": f"""{_HIST},
        f AS (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY macro_f1 DESC, step) AS r FROM em),
        g AS (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY eval_loss, step) AS r FROM el)
        SELECT f.run_name, f.step AS best_f1_step, f.macro_f1 AS best_macro_f1, g.step AS best_loss_step, g.eval_loss AS best_loss
        FROM f JOIN g ON g.run_name = f.run_name AND f.r = 1 AND g.r = 1""",
}
