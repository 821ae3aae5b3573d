"""Run records and training logs stored as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.functions.text import strip

EVAL_SET = ", ".join(
    [f"{m}: DOUBLE" for m in C.METRICS]
    + ["size: BIGINT", "path: STRING", "prediction_path: STRING"]
    + ["confusion_matrix_path: STRING", "confusion_figure_path: STRING"]
)
RUN_SCHEMA = (
    "run_name STRING, model_name STRING, model_type STRING, train_path STRING, "
    f"eval_sets MAP<STRING, STRUCT<{EVAL_SET}>>"
)
LOG_SCHEMA = (
    "log_history ARRAY<STRUCT<step: BIGINT, epoch: DOUBLE, loss: DOUBLE, eval_loss: DOUBLE, "
    "eval_accuracy: DOUBLE, eval_macro_f1: DOUBLE, eval_weighted_f1: DOUBLE>>"
)


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON object file below ``path``; lists and malformed files are skipped."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("metrics_path"))
    )
    objects = files.where(strip(F.col("value")).startswith("{"))
    return objects.select(F.from_json("value", schema).alias("d"), "metrics_path").select("d.*", "metrics_path")


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records that hold evaluation sets."""
    return _documents(spark, path, RUN_SCHEMA).where(F.col("eval_sets").isNotNull())


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Training logs as rows, one per logged step; absent values are null."""
    logs = _documents(spark, path, LOG_SCHEMA).withColumnRenamed("metrics_path", "log_path")
    return logs.select("log_path", F.inline("log_history"))
