"""Scores held as arrays: softmax, argmax and label decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemill import constants as C


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def decode(index: Column, names: Sequence[str] = C.LABELS) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), index + 1)


def named(scores: Column, prefix: str, names: Sequence[str] = C.LABELS) -> list[Column]:
    """One column per class, e.g. ``prob_positive``."""
    return [F.get(scores, F.lit(i)).alias(f"{prefix}_{name}") for i, name in enumerate(names)]


def run_lengths(values: Column, name: str, count: str) -> Column:
    """ARRAY<STRUCT<name, count>> of a sorted array without nulls: its values, each once, and how often they stand there."""

    def runs(values: Column) -> Column:
        starts = F.filter(F.transform(values, lambda v, i: F.when(~v.eqNullSafe(F.get(values, i - 1)), i)), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(starts), lambda starts: counted(values, starts)), F.lit(0))

    def counted(values: Column, starts: Column) -> Column:
        def run(start: Column, i: Column) -> Column:
            length = F.coalesce(F.get(starts, i + 1), F.size(values)) - start
            return F.struct(F.get(values, start).alias(name), length.cast("long").alias(count))

        return F.transform(starts, run)

    return F.get(F.transform(F.array(values), runs), F.lit(0))
