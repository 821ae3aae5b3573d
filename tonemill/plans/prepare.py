"""Corpus preparation: parse, map labels, clean, deduplicate, split, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.functions.labels import decode_label, reject_unmapped, word_label
from tonemill.operators import cleaning, splits
from tonemill.runtime import work_table
from tonemill.sinks.writers import write_json, write_splits


@dataclass(frozen=True)
class Prepared:
    """``rows`` is (key, text, label, split); ``stats`` holds the cleaning counts per part."""

    dataset: str
    rows: DataFrame
    stats: DataFrame


def prepare_word_labelled(
    raw: DataFrame,
    dataset: str,
    key: str = "line_number",
    seed: int = 42,
    fractions: tuple[float, float] = (0.30, 0.50),
) -> Prepared:
    """Parsed lines -> repaired, cleaned, deduplicated corpus in 70/15/15 strata."""
    valid = raw.where("parse_ok").select(key, "text", word_label(F.col("label")).alias("label"))
    distinct = work_table(cleaning.distinct_texts(valid, key, repair=True), f"{dataset}-distinct")
    kept = cleaning.kept_rows(distinct)
    splits.check_strata(kept.groupBy("label").agg(F.count("*").alias("n")), "label", list(fractions))
    rows = splits.stratified_split(kept, key, "label", ["train", "val", "test"], list(fractions), seed)
    stats = cleaning.clean_stats(distinct).withColumn("part", F.lit("all"))
    return Prepared(dataset, rows, stats)


def prepare_coded(
    raw: DataFrame, dataset: str, key: str = "row_number", seed: int = 42, fraction: float = 0.15
) -> Prepared:
    """Integer-labelled official splits -> cleaned and deduplicated within each split, test cut from train."""
    mapped = raw.select(key, "text", "split", F.col("label").alias("_code"), decode_label(F.col("label")).alias("label"))
    unmapped = mapped.where(F.col("label").isNull()).count()
    if unmapped:
        raise ValueError(f"{unmapped} unmapped codes among the labels of {dataset}.")
    distinct = work_table(cleaning.distinct_texts(mapped, key, by=["label", "split"]), f"{dataset}-distinct")
    kept = cleaning.kept_rows(distinct)
    train = kept.where("split = 'train'").groupBy("label").agg(F.count("*").alias("n"))
    splits.check_strata(train, "label", [fraction])
    rows = splits.holdout_split(kept, key, "label", fraction, seed=seed)
    stats = cleaning.clean_stats(distinct, ["split"]).withColumnRenamed("split", "part")
    return Prepared(dataset, rows, stats)


def report_document(prepared: Prepared) -> DataFrame:
    """One nested row: dataset, cleaning counts per part, rows and label counts per split."""
    counts = ["rows_before", "empty_after_clean", "duplicates_removed", "rows_after"]
    cleaning_map = prepared.stats.agg(
        F.map_from_entries(F.collect_list(F.struct("part", F.struct(*counts)))).alias("cleaning")
    )
    per_label = prepared.rows.groupBy("split", "label").agg(F.count("*").alias("n"))
    per_split = per_label.groupBy("split").agg(
        F.sum("n").alias("rows"),
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("label_distribution"),
    )
    split_map = per_split.agg(
        F.map_from_entries(
            F.collect_list(F.struct("split", F.struct(F.col("split").alias("name"), "rows", "label_distribution")))
        ).alias("splits")
    )
    named = F.lit(prepared.dataset).alias("dataset")
    return cleaning_map.crossJoin(F.broadcast(split_map)).select(named, "cleaning", "splits")


def write_prepared(prepared: list[Prepared], data_dir: str, report_dir: str, fmt: str = "parquet") -> None:
    """Write every corpus by split, and one report document per corpus."""
    for corpus in prepared:
        write_splits(corpus.rows.select("text", "label", "split"), f"{data_dir}/{corpus.dataset}", fmt)
    documents = report_document(prepared[0])
    for corpus in prepared[1:]:
        documents = documents.unionByName(report_document(corpus))
    write_json(documents, report_dir)
