"""Feature rows in parts and model vectors in blocks, so that neither is ever whole in one place.

A part holds some thousand rows with the terms that occur in them; a block holds the coefficients of a range of
term ids, all classes side by side. ``pull`` brings each part the coefficients of its terms, ``push`` adds what the
parts say about single terms up to blocks. The large side of both joins is stored in buckets and stays
where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.runtime import bucketed_table, work_table

#: Terms in a block, and rows in a part at most.
BLOCK = 4096
PART_ROWS = 4096
#: Rows of ``push`` below zero carry sums over all rows, not terms; they meet in the block -1.
SUMS = -1


@dataclass(frozen=True)
class Layout:
    """``parts``: (part, target, starts, places, values, terms), a part's rows with their terms numbered within the
    part; ``needs``: (block, part, places), where a part's terms lie in a block."""

    parts: DataFrame
    needs: DataFrame
    blocks: DataFrame


def packed(rows: DataFrame, count: int) -> DataFrame:
    """(part, target, starts, places, values, terms) of ``count`` sparse rows: target and features STRUCT<indices, values, ...>."""
    most = PART_ROWS
    rows = rows.repartition(-(-count // most) or 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for whole in batches:
            for low in range(0, whole.num_rows, most):
                batch = whole.slice(low, most)
                indices = batch.column("indices").flatten().to_numpy(zero_copy_only=False)
                values = batch.column("values").flatten().to_numpy(zero_copy_only=False)
                starts = batch.column("indices").offsets.to_numpy()
                terms, places = np.unique(indices, return_inverse=True)
                number += 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([number], pa.int64()),
                        "target": pa.array([batch.column("target").to_numpy(zero_copy_only=False).astype(np.int32)], pa.list_(pa.int32())),
                        "starts": pa.array([(starts - starts[0]).astype(np.int32)], pa.list_(pa.int32())),
                        "places": pa.array([places.astype(np.int32)], pa.list_(pa.int32())),
                        "values": pa.array([values], pa.list_(pa.float64())),
                        "terms": pa.array([terms.astype(np.int64)], pa.list_(pa.int64())),
                    }
                )

    plain = rows.select("target", "features.indices", "features.values")
    return plain.mapInArrow(pack, "part long, target array<int>, starts array<int>, places array<int>, values array<double>, terms array<long>")


def lay_out(rows: DataFrame, count: int) -> Layout:
    """The layout of ``packed`` rows."""
    block = BLOCK
    parts = bucketed_table(packed(rows, count), "part", "parts")

    # Terms are in order within a part, so each block's are a run of them.
    needed = parts.select("part", F.explode("terms").alias("term")).select("part", F.floor(F.col("term") / block).alias("block"), (F.col("term") % block).cast("int").alias("place"))
    lists = needed.groupBy("part", "block").agg(F.array_sort(F.collect_list("place")).alias("places"))
    needs = bucketed_table(lists, "block", "needs")
    return Layout(parts, needs, work_table(needs.select("block").distinct(), "blocks"))


def pull(layout: Layout, vectors: DataFrame, width: int) -> DataFrame:
    """``layout.parts`` with ``pulled``: by class, the coefficients of the part's terms, out of (block, vector) rows."""
    block = BLOCK

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for vector, places in zip(batch.column("vector"), batch.column("places")):
                table = vector.values.to_numpy(zero_copy_only=False).reshape(width, block)
                out.append(np.ascontiguousarray(table[:, places.values.to_numpy(zero_copy_only=False)]).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("block"), pa.array(out, pa.list_(pa.float64()))], names=["part", "block", "picked"])

    met = layout.needs.join(vectors, "block").select("part", "block", "places", "vector")
    picked = met.mapInArrow(pick, "part long, block long, picked array<double>")
    by_part = picked.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("block", "picked"))).alias("_p"))
    return layout.parts.join(by_part.select("part", F.transform("_p", lambda p: p["picked"]).alias("pulled")), "part", "left")


def with_sharing(layout: Layout) -> Layout:
    """The layout with ``sharing`` in its parts: for each of a part's terms, how many parts hold it."""
    held = layout.parts.select(F.explode("terms").alias("term"), F.lit(1.0).alias("g0"))
    counted = pull(layout, work_table(push(held, 1), "sharing"), 1)
    parts = counted.withColumn("sharing", F.coalesce(F.flatten("pulled"), F.array().cast("array<double>"))).drop("pulled")
    return replace(layout, parts=bucketed_table(parts, "part", "sharing_parts"))


def push(flat: DataFrame, width: int) -> DataFrame:
    """(block, vector): sums of (term, g0, g1, ...) rows. Tasks add their own rows up before the exchange."""
    block = BLOCK
    names = [f"g{c}" for c in range(width)]
    sums = flat.groupBy("term").agg(*[F.sum(n).alias(n) for n in names])
    placed = sums.select(F.floor(F.col("term") / block).alias("block"), F.pmod("term", F.lit(block)).cast("int").alias("place"), *names)
    lists = placed.groupBy("block").agg(F.collect_list(F.struct("place", *names)).alias("entries"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for entries in batch.column("entries"):
                table = np.zeros((width, block))
                place = entries.values.field("place").to_numpy(zero_copy_only=False)
                for c, name in enumerate(names):
                    table[c, place] = entries.values.field(name).to_numpy(zero_copy_only=False)
                out.append(table.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.list_(pa.float64()))], names=["block", "vector"])

    return lists.mapInArrow(fill, "block long, vector array<double>")


def flat_schema(width: int) -> str:
    return ", ".join(["term long", *[f"g{c} double" for c in range(width)]])


def term_rows(vectors: DataFrame, width: int) -> DataFrame:
    """(term_id, c0, c1, ...) of (block, vector) rows; places past the last term are left out by the join that follows."""
    entries = vectors.select("block", F.posexplode(F.slice("vector", 1, BLOCK)).alias("place", "c0"), "vector")
    return entries.select(
        (F.col("block") * BLOCK + F.col("place")).cast("int").alias("term_id"), "c0",
        *[F.element_at("vector", F.col("place") + 1 + c * BLOCK).alias(f"c{c}") for c in range(1, width)],
    )
