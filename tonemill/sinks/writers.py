"""Writers. Every one is a plain distributed write; folders replace single files."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.operators.linear import TermModel


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", split: str = "split") -> None:
    """One sub-folder per split, so that reading a split prunes the others."""
    _table(df.write.partitionBy(split), path, fmt)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One sub-folder per (run_name, eval_name)."""
    _table(df.write.partitionBy("run_name", "eval_name"), path, fmt)


def _table(writer, path: str, fmt: str) -> None:
    writer = writer.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    writer.save(path)


def write_confusion(matrix: DataFrame, path: str) -> None:
    """CSV with the true label as first column."""
    keys = [c for c in matrix.columns if c not in ("label", *C.LABELS)]
    write_csv(matrix.select(*keys, "label", *C.LABELS), path)


def write_csv(table: DataFrame, path: str) -> None:
    """Summary, manifest and statistics tables: small, header first, in one file and in row order."""
    _table(table.coalesce(1).write, path, "csv")


def write_json(documents: DataFrame, path: str) -> None:
    """One JSON document per row and file."""
    writer = documents.write.mode("overwrite").option("maxRecordsPerFile", 1).option("ignoreNullFields", "false")
    writer.json(path)


def _said(value: Column) -> Column:
    """Whole numbers without a point."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def _numbered(lines: DataFrame, corpus: str) -> DataFrame:
    """Lines in the order of section and place; a corpus has a few dozen."""
    order = Window.partitionBy(corpus).orderBy("section", "place", "line")
    return lines.select(corpus, (F.row_number().over(order) - 1).alias("position"), "line")


def report_lines(
    summary: DataFrame, distribution: DataFrame, corpus: str, columns: Mapping[str, list[str]] | None = None
) -> DataFrame:
    """(corpus, position, line): a Markdown line for each statistic and each label of a corpus.

    ``summary`` is (corpus, stat, value), ``distribution`` is (corpus, label, count,
    ratio), ``columns`` names the columns of each corpus.
    """
    title = F.array(
        F.struct(F.lit(0).alias("section"), F.lit(0.0).alias("place"), F.concat(F.lit("# "), corpus).alias("line")),
        F.struct(F.lit(2).alias("section"), F.lit(0.0).alias("place"), F.lit("## Statistics").alias("line")),
        F.struct(F.lit(4).alias("section"), F.lit(0.0).alias("place"), F.lit("## Labels").alias("line")),
    )
    parts = [
        summary.select(corpus).distinct().select(corpus, F.inline(title)),
        summary.select(
            corpus, F.lit(3).alias("section"), F.lit(0.0).alias("place"),
            F.concat(F.lit("- "), F.translate("stat", "_", " "), F.lit(": "), F.coalesce(_said(F.col("value")), F.lit("none"))).alias("line"),
        ),
        distribution.select(
            corpus, F.lit(5).alias("section"), (-F.col("count")).cast("double").alias("place"),
            F.format_string("- %s: %d rows, %.2f%%", F.coalesce("label", F.lit("without a label")), F.col("count"), F.col("ratio") * 100).alias("line"),
        ),
    ]
    listed = [(name, 1, 0.0, "- columns: " + ", ".join(own)) for name, own in (columns or {}).items()]
    if listed:
        parts.append(summary.sparkSession.createDataFrame(listed, f"{corpus} string, section int, place double, line string"))
    return _numbered(reduce(DataFrame.unionByName, parts), corpus)


def comparison_lines(summary: DataFrame, corpus: str, names: list[str]) -> DataFrame:
    """(corpus, position, line): for each statistic, a line with its value in every corpus, and which has most.

    ``corpus`` holds the names joined, as the report is one document.
    """
    values = summary.groupBy("stat").agg(F.map_from_entries(F.collect_list(F.struct(corpus, "value"))).alias("_v"))
    told = [F.concat(F.lit(f"{n} "), F.coalesce(_said(F.try_element_at("_v", F.lit(n))), F.lit("none"))) for n in names]
    largest = F.array_max(F.map_values("_v"))
    most = F.array_join(F.map_keys(F.map_filter("_v", lambda _, v: v == largest)), ", ")
    whole = " and ".join(names)
    line = F.concat(F.lit("- "), F.translate("stat", "_", " "), F.lit(": "), F.concat_ws(", ", *told), F.lit("; most in "), F.coalesce(most, F.lit("none")))
    head = summary.sparkSession.createDataFrame([(whole, 0, 0.0, f"# {whole}")], f"{corpus} string, section int, place double, line string")
    rows = values.select(F.lit(whole).alias(corpus), F.lit(1).alias("section"), F.lit(0.0).alias("place"), line.alias("line"))
    return _numbered(head.unionByName(rows), corpus)


def write_report(lines: DataFrame, corpus: str, path: str) -> None:
    """Markdown text, one sub-folder per corpus, lines in order."""
    ordered = lines.repartition(corpus).sortWithinPartitions(corpus, "position")
    ordered.select(corpus, F.col("line").alias("value")).write.mode("overwrite").partitionBy(corpus).text(path)


def save_model(model: TermModel, path: str) -> None:
    """Term table as parquet, the rest as one JSON document."""
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")
    meta = {
        "model_type": model.model_type,
        "kind": model.kind,
        "classes": list(model.classes),
        "intercepts": list(model.intercepts),
        "ngrams": list(model.ngrams),
        "max_features": model.max_features,
    }
    spark = model.terms.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> TermModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    return TermModel(
        meta["model_type"],
        meta["kind"],
        tuple(meta["classes"]),
        tuple(meta["intercepts"]),
        spark.read.parquet(f"{path}/terms"),
        tuple(meta["ngrams"]),
        meta["max_features"],
    )
