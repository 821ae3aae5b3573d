"""Registered queries over the provided tables, each with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("text", "prepare", "profile", "lexicon", "models", "sequences", "reports", "files")


def _collect(name: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        merged.update(getattr(import_module(f"{__name__}.{module}"), name))
    return merged


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
