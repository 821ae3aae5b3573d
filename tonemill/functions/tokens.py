"""Token arrays and n-grams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.functions.text import is_ascii, replace_urls


def build_stopwords(remove_english: bool, extra: Iterable[str] | None = None) -> list[str]:
    """The stop-word set as a sorted list: Spark's English list if asked for, plus extras."""
    words: set[str] = set(StopWordsRemover.loadDefaultStopWords("english")) if remove_english else set()
    words.update(w.strip().lower() for w in (extra or []) if w.strip())
    return sorted(words)


def stopword_table(spark: SparkSession, remove_english: bool, extra: DataFrame | None = None) -> DataFrame:
    """The stop-word set as a table (word): Spark's English list if asked for, plus a table of extras of any size."""
    words = spark.createDataFrame([(w,) for w in build_stopwords(remove_english)], "word string")
    if extra is not None:
        words = words.union(extra.select(F.lower(F.trim("word")).alias("word")).where("word <> ''"))
    return words.distinct()


def count_tokens(text: Column, stopwords: Iterable[str] = ()) -> Column:
    """Tokens for counting: URLs blanked, curly quotes straightened, lowercased,
    at least two characters, stop-words removed (repeats kept)."""
    text = replace_urls(text, " ")
    text = F.lower(F.replace(text, F.lit(C.RIGHT_QUOTE), F.lit("'")))
    tokens = F.regexp_extract_all(text, F.lit(C.COUNT_TOKEN), F.lit(0))
    stopwords = list(stopwords)

    def keep(token: Column) -> Column:
        long_enough = F.length(token) >= 2
        return long_enough & ~token.isin(stopwords) if stopwords else long_enough

    return F.filter(tokens, keep)


def lexicon_tokens(text: Column) -> Column:
    """Upper-cased alphabetic tokens with inner quotes and hyphens."""
    return F.transform(F.regexp_extract_all(text, F.lit(C.LEXICON_TOKEN), F.lit(0)), lambda t: F.upper(t))


def feature_tokens(folded: Column) -> Column:
    """Runs of at least two word characters; ASCII texts take the cheaper equivalent pattern."""
    ascii_only = F.regexp_extract_all(folded, F.lit(C.ASCII_FEATURE_TOKEN), F.lit(0))
    return F.when(is_ascii(folded), ascii_only).otherwise(
        F.regexp_extract_all(folded, F.lit(C.FEATURE_TOKEN), F.lit(0))
    )


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams in order, joined by a blank; empty when the text is shorter than n."""
    if n == 1:
        return tokens
    grams = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
        lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "),
    )
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngram_range(tokens: Column, low: int, high: int) -> Column:
    """All n-grams with low <= n <= high, repeats kept."""
    parts = [ngrams(tokens, n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)
