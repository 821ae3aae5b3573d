"""Label normalisation. Mapping is a column expression; rejects are counted by a job.

Raising from inside a projection is not safe in Spark: the optimizer may move a
filter below it or prune the column, so bad labels are found by an explicit
aggregate before the mapped frame is used.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.functions.text import strip


def merged_label_map(overrides: Mapping[Any, Any] | None = None) -> dict[str, str]:
    """The built-in map with the caller's entries on top, keys and values trimmed and lowercased."""
    merged = dict(C.WORD_LABELS)
    for key, value in (overrides or {}).items():
        merged[str(key).strip().lower()] = str(value).strip().lower()
    return merged


def word_label(label: Column) -> Column:
    """Labels that are already words: trim and lowercase only."""
    return F.lower(strip(label))


def _lookup(key: Column, mapping: Mapping[Any, str]) -> Column:
    pairs = [F.lit(part) for entry in mapping.items() for part in entry]
    return F.try_element_at(F.create_map(*pairs), key)


def normalize_label(label: Column, overrides: Mapping[Any, Any] | None = None) -> Column:
    """Map a raw label to one of the three labels, or null when that is impossible."""
    accepted = {k: v for k, v in merged_label_map(overrides).items() if v in C.LABELS}
    return _lookup(word_label(label.cast("string")), accepted)


def decode_label(code: Column) -> Column:
    """Integer-coded labels 0/1/2, or null for any other code: 1.7, text and null stay unmapped, "1.0" is 1."""
    number = code.try_cast("double")
    return F.when(number == F.floor(number), _lookup(number.try_cast("int"), C.CODED_LABELS))


def reject_unmapped(df: DataFrame, raw: str, mapped: str, shown: int = 5) -> DataFrame:
    """Run one aggregate over the label columns; raise when a non-null label stayed unmapped."""
    bad = df.where(F.col(raw).isNotNull() & F.col(mapped).isNull())
    worst = bad.groupBy(F.col(raw).cast("string").alias("raw")).count().orderBy(F.desc("count"), "raw").limit(shown)
    rows = worst.collect()
    if rows:
        examples = ", ".join(f"'{r['raw']}' ({r['count']} rows)" for r in rows)
        raise ValueError(f"Unsupported labels: {examples}. Map them to one of {C.LABELS}.")
    return df
