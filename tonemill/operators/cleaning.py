"""Cleaning, keep-first deduplication and the statistics of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.functions.text import clean_text, fix_encoding


def cleaned_text(text: Column, remove_urls: bool = True, repair: bool = False, null_text: str = "drop") -> Column:
    """``null_text='drop'`` treats a null text as blank; ``'literal'`` keeps it as the word ``nan``."""
    text = F.coalesce(text, F.lit("nan" if null_text == "literal" else ""))
    return clean_text(fix_encoding(text) if repair else text, remove_urls)


def distinct_texts(
    df: DataFrame,
    key: str,
    by: list[str] | None = None,
    remove_urls: bool = True,
    repair: bool = False,
    null_text: str = "drop",
) -> DataFrame:
    """One row per cleaned (text, by...): the first key and the number of copies.

    A single aggregation gives both the keep-first result and everything the
    statistics need. Copies collapse before the shuffle, so a text that fills a
    third of the table costs each task one row.
    """
    by = by or ["label"]
    cleaned = df.select(
        F.col(key), cleaned_text(F.col("text"), remove_urls, repair, null_text).alias("text"), *by
    )
    return cleaned.groupBy("text", *by).agg(
        F.min(key).alias(key), F.count("*").alias("copies"), F.max(F.length("text")).alias("chars")
    )


def kept_rows(distinct: DataFrame) -> DataFrame:
    """The cleaned, deduplicated, non-empty rows.

    The test is on an aggregate: one on the text would be moved below the
    aggregation, where the whole cleaning chain would run once more for it.
    """
    return distinct.where(F.col("chars") > 0).drop("copies", "chars")


def clean_stats(distinct: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows_before, empty_after_clean, duplicates_removed, rows_after, optionally per group."""
    blank = F.col("text") == ""

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name)

    return distinct.groupBy(*(by or [])).agg(
        total(F.col("copies"), "rows_before"),
        total(F.when(blank, F.col("copies")).otherwise(0), "empty_after_clean"),
        total(F.when(blank, 0).otherwise(F.col("copies") - 1), "duplicates_removed"),
        total(F.when(blank, 0).otherwise(1), "rows_after"),
    )
