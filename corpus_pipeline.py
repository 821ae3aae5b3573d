"""From raw documents to packed training sequences: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm import decontamination, line_dedup, packing, simhash, toxicity
from tonemill.llm.common import in_fold
from tonemill.llm.queries import table, tokenizer_definition
from tonemill.runtime import work_table

#: No stage has an equivalent in SQL as a whole; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below the cut, by a model of the labelled ones; the others go."""
    labels = table(spark, folder, "labels")
    return toxicity.reject_toxic(docs, labels.filter(~in_fold(F.col("doc_id"), 3, 1)))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the lines that spread over sites; n_chars follows the text."""
    cleaned = line_dedup.remove_boilerplate(docs)
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", size.cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, folder, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of 2048 ids."""
    return packing.pack_documents(docs, tokenizer_definition(), words_apart=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_boilerplate),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
