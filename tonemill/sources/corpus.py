"""Unlabelled corpora: text only, from several CSV files in a given order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.functions.text import strip
from tonemill.sources.labeled import read_csv, require_columns
from tonemill.sources.numbering import number_file_rows, with_file_position


def load_texts(
    spark: SparkSession, paths: list[str], text_column: str = "text", multi_line: bool | None = None
) -> DataFrame:
    """(row_number, text): nulls and blanks dropped, numbered in path order then file order."""
    parts = []
    for position, path in enumerate(paths):
        df = read_csv(spark, path, multi_line)
        require_columns(df, [text_column], path)
        text = df.select(
            strip(F.col(text_column)).alias("text"), F.lit(position).alias("_part"), "_metadata"
        ).where(F.col("text").isNotNull() & (F.col("text") != ""))
        # Positions are taken after the filter, so that they have no gaps.
        parts.append(with_file_position(text).drop("_metadata"))
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return number_file_rows(combined, "row_number", order=["_part"]).drop("_part")


def load_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """Extra stop-words, one per line, as a table (word) for ``functions.tokens.stopword_table``."""
    lines = spark.read.text(path).select(F.lower(strip(F.col("value"))).alias("word"))
    return lines.where("word <> ''").distinct()
