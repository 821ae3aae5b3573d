"""Polarity lexicon source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.sources.labeled import read_csv, require_columns


def lexicon_words(
    table: DataFrame,
    word_column: str = "Word",
    positive_column: str = "Positive",
    negative_column: str = "Negative",
    threshold: float = 0,
) -> DataFrame:
    """Word table -> one row per upper-cased word: (word, positive, negative) booleans.

    A word counts for a polarity when its number is strictly above the threshold;
    words in neither set are dropped, words in both keep both flags.
    """
    require_columns(table, [word_column, positive_column, negative_column], "lexicon")

    return (
        table.select(
            F.upper(F.col(word_column).cast("string")).alias("word"),
            F.coalesce(F.col(positive_column).try_cast("double") > threshold, F.lit(False)).alias("positive"),
            F.coalesce(F.col(negative_column).try_cast("double") > threshold, F.lit(False)).alias("negative"),
        )
        .where(F.col("word").isNotNull() & (F.col("positive") | F.col("negative")))
        .groupBy("word")
        .agg(F.bool_or("positive").alias("positive"), F.bool_or("negative").alias("negative"))
    )


def load_lexicon(spark: SparkSession, path: str, **options) -> DataFrame:
    return lexicon_words(read_csv(spark, path), **options)
