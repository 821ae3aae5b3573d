"""Cross-run reports from stored run documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonemill.operators import manifest
from tonemill.runtime import work_table
from tonemill.sinks.writers import write_csv
from tonemill.sources.runs import load_runs


def write_reports(spark: SparkSession, metrics_path: str, out: str) -> DataFrame:
    """Collect every run below ``metrics_path``; write manifest, test leaderboard and generalisation drop."""
    table = work_table(manifest.manifest(manifest.explode_runs(load_runs(spark, metrics_path))), "manifest")
    write_csv(manifest.ordered(table), f"{out}/experiment_manifest")
    write_csv(manifest.leaderboard(table), f"{out}/test_leaderboard")
    write_csv(manifest.generalisation_drop(table), f"{out}/generalisation_drop")
    return table
