"""Training-log tables: loss and metric series, best step per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill import constants as C


def _series(history: DataFrame, ids: list[str], columns: dict[str, str]) -> DataFrame:
    present = [c for c in columns if c in history.columns]
    names = F.create_map(*[F.lit(x) for c in present for x in (c, columns[c])])
    long = history.unpivot([*ids, "step"], [F.col(c).cast("double").alias(c) for c in present], "series", "value")
    return long.where(F.col("value").isNotNull()).withColumn("series", names[F.col("series")])


def loss_series(history: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., step, series, value) for training and evaluation loss, absent values skipped."""
    return _series(history, ids, C.LOSS_NAMES)


def metric_series(history: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., step, series, value) for the evaluation metrics."""
    return _series(history, ids, C.EVAL_METRIC_NAMES)


def best_steps(history: DataFrame, ids: list[str]) -> DataFrame:
    """Per run, the step with the best macro F1 and the one with the lowest evaluation loss; the first of equals."""

    def first(column: str, sign: int):
        order = F.struct((F.col(column) * sign).alias("_v"), (-F.col("step")).alias("_s"))
        return F.max_by("step", F.when(F.col(column).isNotNull(), order))

    return history.groupBy(*ids).agg(
        first("eval_macro_f1", 1).alias("best_f1_step"),
        F.max("eval_macro_f1").alias("best_macro_f1"),
        first("eval_loss", -1).alias("best_loss_step"),
        F.min("eval_loss").alias("best_loss"),
    )
