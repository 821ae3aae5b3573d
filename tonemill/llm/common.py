"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def in_fold(col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the text ''."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as bytes, null as empty."""
    return [b"" if v is None else v for v in batch.column(name).cast(pa.binary()).to_pylist()]


def spaced_words(text: bytes) -> list[bytes]:
    """Words without ASCII blanks; A-Z lower-cased, other bytes kept."""
    return text.lower().split()


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold only whole runs of equal keys, from batches sorted by them.

    At most one run is carried from a batch to the next one.
    """
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows == 0:
            continue
        last = [held.column(k)[held.num_rows - 1] for k in keys]
        same = np.ones(held.num_rows, dtype=bool)
        for k, value in zip(keys, last):
            column = held.column(k)
            equal = column.is_null() if not value.is_valid else pc.fill_null(pc.equal(column, value), False)
            same &= equal.to_numpy(zero_copy_only=False)
        differing = np.flatnonzero(~same)
        cut = int(differing[-1]) + 1 if len(differing) else 0
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    change = np.zeros(len(columns[0]), dtype=bool)
    if len(change):
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def scalars(df: DataFrame) -> dict:
    """The only row of an ungrouped aggregate."""
    return df.first().asDict()


def text_slices(batch: pa.RecordBatch, name: str | int, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with at most ``most`` bytes of text each; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > begin and held + size > most:
            yield begin, row
            begin, held = row, 0
        held += size
    if begin < batch.num_rows:
        yield begin, batch.num_rows


def sliced(batches: Iterator[pa.RecordBatch], name: str | int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of a few megabytes of text, so that few texts are Python values at a time."""
    for batch in batches:
        for low, high in text_slices(batch, name):
            yield batch.slice(low, high - low)
