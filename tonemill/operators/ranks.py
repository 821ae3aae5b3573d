"""Exact rank cuts: find the row holding a given rank without sorting the table.

A histogram over an order-preserving bucket locates the bucket in which each cut
falls; only rows of those buckets are ranked. The result is one small threshold
row per (group, cut), and membership becomes a comparison with that threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucket_sizes(df: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """(group..., bucket, _n)"""
    return df.groupBy(*group, bucket).agg(F.count("*").alias("_n"))


def rank_thresholds(
    df: DataFrame, sizes: DataFrame, cuts: DataFrame, group: list[str], bucket: str, order: list[str]
) -> DataFrame:
    """``cuts`` has (group..., cut, wanted): the position, 1-based, of the last row before the cut.

    ``sizes`` are the ``bucket_sizes`` of ``df``; ``bucket`` must not decrease
    along ``order``. Returns (group..., cut, threshold STRUCT<order...>), without
    rows for cuts at position zero.
    """
    running = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("_upto", F.sum("_n").over(running))
    inside = (
        (F.col("wanted") > F.col("_upto") - F.col("_n")) & (F.col("wanted") <= F.col("_upto"))
    )
    located = _join(sizes, cuts, group, inside).select(
        *group, bucket, "cut", (F.col("wanted") - F.col("_upto") + F.col("_n")).alias("_position")
    )
    candidates = df.select(*group, bucket, *order).join(F.broadcast(located), [*group, bucket])
    position = F.row_number().over(Window.partitionBy(*group, "cut").orderBy(*order))
    return (
        candidates.withColumn("_rank", position)
        .where(F.col("_rank") == F.col("_position"))
        .select(*group, "cut", F.struct(*order).alias("threshold"))
    )


def _join(left: DataFrame, right: DataFrame, group: list[str], condition) -> DataFrame:
    """Equi-join on the group with an extra condition; a plain condition join when ungrouped."""
    right = F.broadcast(right)
    if not group:
        return left.join(right, condition)
    renamed = right.select(*[F.col(g).alias(f"_{g}") for g in group], "cut", "wanted")
    for g in group:
        condition = condition & left[g].eqNullSafe(renamed[f"_{g}"])
    return left.join(renamed, condition)
