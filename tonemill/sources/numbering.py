"""Row numbers in file order and in key order, without pulling rows through one task."""

from __future__ import annotations

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_KEYS = ("_file", "_block", "_seq")


def file_order(df: DataFrame) -> Column:
    """A number that grows in file order inside the split of a row: the place it was given, or its place in the scan."""
    placed = "place" in df.schema["_metadata"].dataType.names if "_metadata" in df.columns else False
    return F.col("_metadata.place") if placed else F.monotonically_increasing_id()


def with_file_position(df: DataFrame) -> DataFrame:
    """Tag rows of a file scan with file, split offset and a sequence that grows by one inside the split."""
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), file_order(df).alias("_seq"))
    if "_metadata" in df.columns and "place" in df.schema["_metadata"].dataType.names:  # rows were put together from lines, so places have gaps
        placed = placed.withColumn("_seq", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_seq")).cast("long"))
    return placed


def number_file_rows(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """Number rows 1..N in file order (``order`` ranks files before the path does).

    Sums run on two levels, over the splits of a file and over the files, so that the only
    global ordering is of one small row per file; every row then adds its own
    position inside the split to the offsets. Adaptive execution picks the join.
    """
    files = [*(order or []), "_file"]
    blocks = df.groupBy(*files, "_block").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    totals = blocks.groupBy(*files).agg(F.sum("_rows").alias("_rows"))
    before_file = F.sum("_rows").over(Window.orderBy(*files).rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(*files, F.coalesce(before_file, F.lit(0)).alias("_start"))
    before_block = F.sum("_rows").over(Window.partitionBy(*files).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select(*files, "_block", "_first", F.coalesce(before_block, F.lit(0)).alias("_offset")).join(starts, files)
    numbered = df.join(offsets, [*files, "_block"])
    return numbered.withColumn(name, F.col("_start") + F.col("_offset") + F.col("_seq") - F.col("_first") + 1).drop(
        *FILE_KEYS, "_first", "_offset", "_start"
    )


def quantile_buckets(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Append ``_bucket``: ranges of a numeric key cut at approximate quantiles.

    Buckets are even whatever the distribution. By default there is one per
    million rows and 64 at least, so a bucket stays a small sort at any table size.
    """
    buckets = buckets or max(df.count() // 1_000_000, 64)
    keyed = df.withColumn("_key", F.col(key).cast("double"))
    cutter = QuantileDiscretizer(
        numBuckets=buckets, inputCol="_key", outputCol="_bucket", relativeError=1.0 / (4 * buckets)
    )
    return cutter.fit(keyed.select("_key")).transform(keyed).drop("_key")


def number_rows(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """Number rows 1..N by a unique numeric key: ranked inside even buckets, then
    shifted by the sizes of the buckets before."""
    bucketed = quantile_buckets(df, key, buckets)
    sizes = bucketed.groupBy("_bucket").count()
    before = F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        bucketed.withColumn("_rank", rank.cast("long"))
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_rank"))
        .drop("_bucket", "_rank", "_offset")
    )
