"""Masked-token training corpus: number, head/tail split, encode, mask."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tonemill import constants as C
from tonemill.operators import encoding, splits
from tonemill.runtime import work_table
from tonemill.sources.corpus import load_texts


def masked_corpus(
    texts: DataFrame,
    key: str = "row_number",
    max_words: int = 30_000,
    max_length: int = 128,
    val_ratio: float = 0.05,
    probability: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """(key, split, input_ids, attention_mask, targets) for texts in key order."""
    words = work_table(encoding.fit_word_ids(texts, max_words), "words")
    size = words.count() + C.FIRST_WORD_ID
    divided = splits.head_tail_split(texts, key, val_ratio)
    encoded = encoding.encode(divided, [key], words, max_length, carry=["split"], max_words=max_words)
    return encoding.mask_tokens(encoded, key, size, probability, seed)


def run_corpus(spark: SparkSession, config: Mapping[str, Any], path: str) -> dict[str, int]:
    """Unlabelled CSV files -> stored examples; returns the number of texts per split."""
    data, model = config.get("data", {}), config.get("model", {})
    texts = load_texts(spark, data.get("corpus_paths", []), data.get("text_column", "text"))
    examples = masked_corpus(
        work_table(texts, "texts"),
        max_words=model.get("max_words", 30_000),
        max_length=model.get("max_length", 128),
        val_ratio=data.get("val_ratio", 0.05),
        probability=model.get("mlm_probability", 0.15),
        seed=config.get("training", {}).get("seed", 42),
    )
    write_corpus(examples, path)
    return {r["split"]: r["count"] for r in spark.read.parquet(path).groupBy("split").count().collect()}


def write_corpus(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").partitionBy("split").parquet(path)
