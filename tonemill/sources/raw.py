"""Raw corpora before label mapping: delimited lines, split CSV files, a registry."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.functions.text import strip
from tonemill.sources.labeled import read_csv
from tonemill.sources.numbering import number_file_rows, with_file_position


def parse_delimited(df: DataFrame, line: str = "raw_line", delimiter: str = "@") -> DataFrame:
    """Split each line at its last delimiter into text and label; keep failures flagged."""
    raw = F.col(line)
    blank = strip(raw) == ""
    parsed = ~blank & F.contains(raw, F.lit(delimiter))
    label = F.substring_index(raw, delimiter, -1)
    head = F.substr(raw, F.lit(1), F.char_length(raw) - F.char_length(label) - len(delimiter))
    return df.withColumns(
        {
            "text": F.when(blank, F.lit("")).when(parsed, head).otherwise(raw),
            "label": F.when(parsed, label),
            "parse_ok": parsed,
        }
    )


def load_delimited(
    spark: SparkSession,
    path: str | list[str],
    dataset: str,
    split: str,
    encoding: str = "ISO-8859-1",
    delimiter: str = "@",
) -> DataFrame:
    """Text lines -> (dataset, split, line_number, text, label, parse_ok, raw_line)."""
    lines = with_file_position(spark.read.text(path))
    lines = lines.withColumn("raw_line", F.decode(F.col("value").cast("binary"), encoding))
    numbered = number_file_rows(lines, "line_number")
    return parse_delimited(numbered, "raw_line", delimiter).select(
        F.lit(dataset).alias("dataset"),
        F.lit(split).alias("split"),
        "line_number",
        "text",
        "label",
        "parse_ok",
        "raw_line",
    )


def load_split_csvs(
    spark: SparkSession, paths: Mapping[str, str], dataset: str, multi_line: bool | None = None
) -> DataFrame:
    """One CSV per named split -> union tagged with dataset, split, source_file, row_number."""
    parts = [
        with_file_position(
            read_csv(spark, path, multi_line).withColumns(
                {
                    "dataset": F.lit(dataset),
                    "split": F.lit(split),
                    "source_file": F.lit(path),
                    "_part": F.lit(position),
                }
            )
        ).drop("_metadata")
        for position, (split, path) in enumerate(paths.items())
    ]
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return number_file_rows(combined, "row_number", order=["_part"]).drop("_part")


def load_registry(
    spark: SparkSession, loaders: Mapping[str, Callable[[SparkSession], DataFrame]]
) -> dict[str, DataFrame]:
    """Named corpora as lazy DataFrames."""
    return {name: load(spark) for name, load in loaders.items()}
