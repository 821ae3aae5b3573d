"""Cross-run tables: manifest, test leaderboard, generalisation drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.functions.paths import parent_name, stem


def explode_runs(runs: DataFrame) -> DataFrame:
    """Run records -> one row per (run, evaluation set)."""
    return runs.select(
        "run_name", "model_name", "model_type", "train_path", "metrics_path",
        F.explode("eval_sets").alias("eval_name", "_e"),
    ).select("*", "_e.*").drop("_e")


def manifest(rows: DataFrame) -> DataFrame:
    """Derive model, domains, split and setting for every (run, evaluation set) row.

    Needs run_name, eval_name, path, train_path and the three headline metrics;
    other columns of the manifest are null when absent.
    """
    for name in ("model_name", "model_type", "metrics_path", *C.MANIFEST[-3:]):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))

    def given(name: str):
        return F.coalesce(F.col(name), F.lit("")) != ""

    rows = rows.withColumns(
        {
            "run_name": F.coalesce("run_name", F.lit("")),
            "model": F.coalesce(F.nullif("model_name", F.lit("")), F.nullif("model_type", F.lit("")), F.lit("unknown")),
            "train_domain": F.when(given("train_path"), parent_name(F.col("train_path"))).otherwise("none"),
            "eval_domain": F.when(given("path"), parent_name(F.col("path"))).otherwise("unknown"),
            "eval_split": F.when(given("path"), stem(F.col("path"))).otherwise(F.col("eval_name")),
        }
    )
    setting = (
        F.when(F.col("train_domain") == "none", "lexicon_eval")
        .when(F.col("train_domain") == F.col("eval_domain"), "in_domain")
        .otherwise("cross_domain")
    )
    return rows.withColumn("setting", setting).select(*C.MANIFEST)


def ordered(table: DataFrame) -> DataFrame:
    return table.orderBy("model", "run_name", "eval_name")


def test_rows(table: DataFrame) -> DataFrame:
    return table.where(F.col("eval_split") == "test")


def leaderboard(table: DataFrame) -> DataFrame:
    """Test rows by model and domains, best macro F1 first."""
    return test_rows(table).orderBy("model", "train_domain", "eval_domain", F.desc("macro_f1"))


def generalisation_drop(table: DataFrame) -> DataFrame:
    """Best in-domain test macro F1 of a run minus that of each of its cross-domain test rows."""
    tests = test_rows(table).where(F.col("train_domain") != "none")
    inside = (
        tests.where(F.col("eval_domain") == F.col("train_domain"))
        .groupBy("run_name")
        .agg(F.max("macro_f1").alias("in_domain_macro_f1"))
    )
    across = tests.where(F.col("eval_domain") != F.col("train_domain"))
    return across.join(inside, "run_name").select(
        "run_name",
        "model",
        "train_domain",
        F.col("eval_domain").alias("cross_eval_domain"),
        "in_domain_macro_f1",
        F.col("macro_f1").alias("cross_domain_macro_f1"),
        (F.col("in_domain_macro_f1") - F.col("macro_f1")).alias("generalisation_drop"),
    )
