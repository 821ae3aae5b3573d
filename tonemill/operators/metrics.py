"""Fixed-label classification metrics from one aggregation.

Nine cell counts per evaluation set are enough for every metric; they are
conditional counts in a single grouped aggregate, and the metrics are
projections over its few rows. Averages always run over the three fixed labels,
absent ones counting as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.functions.arrays import argmax, decode


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def cell_counts(df: DataFrame, group: list[str], truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """(group..., size, correct, n_<truth>_<prediction>, support_<label>, predicted_<label>)."""
    t, p = F.col(truth), F.col(prediction)
    return df.groupBy(*group).agg(
        F.count("*").alias("size"),
        F.count_if(t == p).alias("correct"),
        *[F.count_if((t == a) & (p == b)).alias(f"n_{a}_{b}") for a in C.LABELS for b in C.LABELS],
        *[F.count_if(t == a).alias(f"support_{a}") for a in C.LABELS],
        *[F.count_if(p == a).alias(f"predicted_{a}") for a in C.LABELS],
    )


def _scores(label: str) -> dict[str, Column]:
    hit, support, predicted = F.col(f"n_{label}_{label}"), F.col(f"support_{label}"), F.col(f"predicted_{label}")
    return {
        "precision": _ratio(hit, predicted),
        "recall": _ratio(hit, support),
        "f1": _ratio(2 * hit, support + predicted),
    }


def _averages(measure: str) -> tuple[Column, Column]:
    macro, weighted, support = F.lit(0.0), F.lit(0.0), F.lit(0)
    for label in C.LABELS:
        value = _scores(label)[measure]
        macro = macro + value
        weighted = weighted + value * F.col(f"support_{label}")
        support = support + F.col(f"support_{label}")
    return macro / len(C.LABELS), _ratio(weighted, support)


def evaluation_summary(df: DataFrame, group: list[str], truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """(group..., size, accuracy, macro/weighted f1, precision, recall): one row per evaluation set."""
    cells = cell_counts(df, group, truth, prediction)
    values = {"accuracy": _ratio(F.col("correct"), F.col("size"))}
    for measure in ("f1", "precision", "recall"):
        values[f"macro_{measure}"], values[f"weighted_{measure}"] = _averages(measure)
    return cells.select(*group, "size", *[values[m].alias(m) for m in C.METRICS])


def confusion_matrix(df: DataFrame, group: list[str], truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """(group..., label, positive, neutral, negative): three rows per group, true labels by predictions."""
    cells = cell_counts(df, group, truth, prediction)
    rows = [
        F.struct(F.lit(a).alias("label"), *[F.col(f"n_{a}_{b}").alias(b) for b in C.LABELS]) for a in C.LABELS
    ]
    return cells.select(*group, F.inline(F.array(*rows)))


def class_report(df: DataFrame, group: list[str], truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """(group..., entry, precision, recall, f1, support): labels, then accuracy, macro avg, weighted avg.

    The accuracy row carries its value under ``f1``, precision and recall are null.
    """
    cells = cell_counts(df, group, truth, prediction)

    def entry(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("entry"),
            precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"),
            f1.cast("double").alias("f1"),
            support.cast("long").alias("support"),
        )

    rows = []
    for label in C.LABELS:
        s = _scores(label)
        rows.append(entry(label, s["precision"], s["recall"], s["f1"], F.col(f"support_{label}")))
    known = F.col("support_positive") + F.col("support_neutral") + F.col("support_negative")
    nothing = F.lit(None)
    rows.append(entry("accuracy", nothing, nothing, _ratio(F.col("correct"), F.col("size")), F.col("size")))
    averages = {m: _averages(m) for m in ("precision", "recall", "f1")}
    for i, name in enumerate(("macro avg", "weighted avg")):
        rows.append(entry(name, averages["precision"][i], averages["recall"][i], averages["f1"][i], known))
    return cells.select(*group, F.inline(F.array(*rows)))


def metric_payload(df: DataFrame, group: list[str], truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """The summary row with the per-class report nested as MAP<entry, STRUCT<...>>."""
    report = class_report(df, group, truth, prediction)
    scores = F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support")
    pairs = F.struct("entry", scores.alias("scores"))
    nested = report.groupBy(*group).agg(F.map_from_entries(F.collect_list(pairs)).alias("report"))
    summary = evaluation_summary(df, group, truth, prediction)
    return summary.join(F.broadcast(nested), group) if group else summary.crossJoin(F.broadcast(nested))


def logit_metrics(df: DataFrame, group: list[str], truth_id: str, logits: str) -> DataFrame:
    """Accuracy, macro and weighted F1 of the argmax of raw logits against integer ids."""
    named = df.select(
        *group,
        decode(F.col(truth_id).cast("int")).alias("label"),
        decode(argmax(F.col(logits))).alias("prediction"),
    )
    return evaluation_summary(named, group).select(*group, "size", "accuracy", "macro_f1", "weighted_f1")


def unpivot_metrics(summary: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., metric, score): the three headline metrics in long form with display names."""
    long = summary.unpivot(ids, list(C.METRIC_NAMES), "metric", "score")
    names = F.create_map(*[F.lit(x) for pair in C.METRIC_NAMES.items() for x in pair])
    return long.withColumn("metric", names[F.col("metric")])
