"""Trimming, cleaning, encoding repair and pattern predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill import constants as C


def strip(text: Column) -> Column:
    """Trim every Unicode whitespace character, not only U+0020."""
    return F.btrim(text, F.lit(C.WS_CHARS))


def is_ascii(text: Column) -> Column:
    """One byte per character; cheaper than any pattern."""
    return F.octet_length(text) == F.char_length(text)


def fix_encoding(text: Column) -> Column:
    """Drop ``+`` before a Latin-1 high byte, ``++`` before a letter, then U+FFFD."""
    unplussed = F.regexp_replace(F.regexp_replace(text, C.PLUS_BEFORE_BYTE, ""), C.DOUBLE_PLUS, "")
    text = F.when(F.contains(text, F.lit("+")), unplussed).otherwise(text)
    return F.replace(text, F.lit(C.REPLACEMENT_CHAR), F.lit(""))


def _may_hold_url(text: Column) -> Column:
    return F.contains(text, F.lit("://")) | F.contains(text, F.lit("www."))


def replace_urls(text: Column, by: str) -> Column:
    """Only texts that can match pay for the pattern."""
    return F.when(_may_hold_url(text), F.regexp_replace(text, C.URL, by)).otherwise(text)


def clean_text(text: Column, remove_urls: bool = True) -> Column:
    """Strip, drop URLs, collapse whitespace runs of two or more, strip again."""
    text = strip(text)
    if remove_urls:
        text = replace_urls(text, "")
    return strip(F.regexp_replace(text, C.SPACE_RUN, " "))


def word_count(stripped: Column) -> Column:
    """Whitespace-separated words of an already stripped text."""
    words = F.size(F.split(stripped, f"[{C.WS}]+"))
    return F.when(stripped == "", F.lit(0)).otherwise(words)


# Each predicate first tests for a literal its pattern needs.


def has_url(text: Column) -> Column:
    return _may_hold_url(text) & text.rlike(C.URL)


def has_ticker(text: Column) -> Column:
    return F.contains(text, F.lit("$")) & text.rlike(C.TICKER)


def has_number(text: Column) -> Column:
    return text.rlike(r"\p{Nd}") & text.rlike(C.NUMBER)


def has_percent(text: Column) -> Column:
    return F.contains(text, F.lit("%")) & text.rlike(C.PERCENT)


def has_replacement_char(text: Column) -> Column:
    return F.contains(text, F.lit(C.REPLACEMENT_CHAR))


PATTERNS = {
    "has_url": has_url,
    "has_ticker": has_ticker,
    "has_number": has_number,
    "has_percent": has_percent,
    "has_replacement_char": has_replacement_char,
}


def add_text_features(df: DataFrame, text_column: str = "text") -> DataFrame:
    """Append the stripped text, both lengths and the five pattern flags."""
    df = df.withColumn(text_column, F.coalesce(F.col(text_column), F.lit("")))
    df = df.withColumn("text_stripped", strip(F.col(text_column)))
    stripped = F.col("text_stripped")
    return df.withColumns(
        {
            "char_length": F.char_length(stripped),
            "word_count": word_count(stripped),
            **{name: flag(stripped) for name, flag in PATTERNS.items()},
        }
    )
