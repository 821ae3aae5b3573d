"""Polarity scoring against a lexicon of (word, positive, negative)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.functions.arrays import run_lengths
from tonemill.functions.tokens import lexicon_tokens


def polarity(score: Column, min_count_diff: int = 1) -> Column:
    """Positive is tested first, so it wins ties when the difference may be zero."""
    return (
        F.when(score >= min_count_diff, "positive").when(score <= -min_count_diff, "negative").otherwise("neutral")
    )


def _with_prediction(df: DataFrame, min_count_diff: int) -> DataFrame:
    score = F.col("positive_hits") - F.col("negative_hits")
    return df.withColumns({"lexicon_score": score, "prediction": polarity(score, min_count_diff)})


def score_with_sets(
    df: DataFrame, positive: Iterable[str], negative: Iterable[str], min_count_diff: int = 1, text: str = "text"
) -> DataFrame:
    """In-row scoring with word sets that the caller wrote down, as streams need it; no shuffle, no join.

    The same hits as ``score``: a null text has none.
    """

    def hits(words: list[str]) -> Column:
        if not words:
            return F.lit(0).cast("long")
        return F.size(F.filter(F.col("_tokens"), lambda t: t.isin(words))).cast("long")

    scored = df.withColumn("_tokens", lexicon_tokens(F.coalesce(text, F.lit("")))).withColumns(
        {"positive_hits": hits(sorted(positive)), "negative_hits": hits(sorted(negative))}
    )
    return _with_prediction(scored.drop("_tokens"), min_count_diff)


def score(
    df: DataFrame, keys: list[str], lexicon: DataFrame, min_count_diff: int = 1, text: str = "text"
) -> DataFrame:
    """Append positive_hits, negative_hits, lexicon_score and prediction, for a lexicon of any size.

    ``keys`` identify a row; null counts as a key value, and a null text has no
    hits. Repeats are counted inside their row, without an exchange, so a frequent word
    contributes one row per text; adaptive execution splits its join partition or
    broadcasts a lexicon that turns out small. Only keys and counts are joined
    back to the rows.
    """
    words = F.sort_array(lexicon_tokens(F.coalesce(text, F.lit(""))))
    counts = df.select(*keys, F.inline(run_lengths(words, "_word", "_n")))
    listed = lexicon.select(F.col("word").alias("_word"), "positive", "negative")
    hits = (
        counts.join(listed, "_word")
        .groupBy(*[F.col(k).alias(f"_hit_{k}") for k in keys])
        .agg(
            F.sum(F.when(F.col("positive"), F.col("_n")).otherwise(0)).alias("positive_hits"),
            F.sum(F.when(F.col("negative"), F.col("_n")).otherwise(0)).alias("negative_hits"),
        )
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_hit_{k}")) for k in keys])
    scored = df.join(hits, same, "left").drop(*[f"_hit_{k}" for k in keys])
    return _with_prediction(scored.fillna(0, ["positive_hits", "negative_hits"]), min_count_diff)
