"""Sharding of documents: groups of equal texts packed best-fit-decreasing into shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonemill.llm.bins import best_fit_decreasing, level_fill
from tonemill.llm.common import scalars
from tonemill.runtime import work_table

PER_PART = 100_000


def _pack(items: DataFrame, parts: int, capacity: int, fixed_bins: int | None = None, slack: int = 0) -> DataFrame:
    """(item, bin) of (item, size): each of the parts is packed by itself, into ``fixed_bins`` of near equal load if given."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        sizes = pdf["size"].to_numpy()
        number = level_fill(sizes, fixed_bins, slack) if fixed_bins else best_fit_decreasing(sizes, capacity)
        return pd.DataFrame({"item": pdf["item"], "bin": pdf["part"].to_numpy() * np.int64(1 << 32) + number})

    part = F.pmod(F.xxhash64("item"), F.lit(parts)).cast("long")
    return items.select("item", "size", part.alias("part")).groupBy("part").applyInPandas(pack, "item string, bin long")


def shard_groups(groups: DataFrame, n_shards: int, fineness: int = 256) -> DataFrame:
    """(item, shard) of (item, size): indivisible groups into shards of near equal size.

    A group above an equal share has a shard of its own, and the share is that of the other groups in the other
    shards, until none is above it. These groups are packed into parcels of 1/``fineness`` of a share at most, within
    parts of 100,000 groups at most by expectation, and the parcels into larger
    ones while there are more of them than one part takes; larger groups are
    parcels by themselves. Then the parcels are packed into the shards. No step sees
    more than a part, and sizes end within about a parcel of each other unless single
    groups are larger than a parcel; shards that these overfill are left out of the others' share.
    """
    groups = work_table(groups.select("item", "size"), "shard-groups")
    total = scalars(groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")))
    left, alone = total["size"], []
    for row in groups.orderBy(F.desc("size"), "item").limit(n_shards).collect():  # n_shards groups at most
        if row["size"] <= max(1, -(-left // (n_shards - len(alone)))):
            break
        left -= row["size"]
        alone.append((row["item"], len(alone)))
    capacity = max(1, -(-left // (n_shards - len(alone))))
    own = groups.sparkSession.createDataFrame(alone, "item string, shard int")
    others = groups.join(F.broadcast(own), "item", "left_anti") if alone else groups
    chain, items, n = [], others, total["n"] - len(alone)
    first = parcel = max(1, capacity // fineness)
    while not chain or n > PER_PART:
        bins = work_table(_pack(items, max(1, -(-n // PER_PART)), parcel), "shard-parcels")
        name = F.concat(F.lit(f"{len(chain)}-"), F.col("bin").cast("string"))
        chain.append(bins.select("item", name.alias("parcel")))
        items = work_table(chain[-1].join(items, "item").groupBy("parcel").agg(F.sum("size").alias("size")).withColumnRenamed("parcel", "item"), "shard-items")
        before, n = n, items.count()
        if n > before // 2:
            parcel *= 2
        if parcel > capacity:
            break
    shards = _pack(items, 1, capacity, n_shards - len(alone), first)
    for level in reversed(chain):
        shards = level.join(shards.withColumnRenamed("item", "parcel"), "parcel").select("item", "bin")
    return shards.select("item", (F.col("bin") + len(alone)).cast("int").alias("shard")).union(own)


def shard_documents(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8
) -> DataFrame:
    """Every row's id, size, text_crc32, shard and slot; rows of equal text share a shard.

    The size is the text's UTF-8 length plus ``overhead``; a null text has no bytes and
    a checksum of 0, and is a group apart from the empty text. Slots count from 0 in
    each shard, without gaps, in the order of a hash bucket and then of the id;
    repeated rows each get a slot. Other columns are left out, an empty table gives
    no rows. Shards may stay empty when there are fewer groups than shards.
    """
    data = F.col(text_col).cast("binary")
    rows = work_table(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.sha2(text_col, 256), F.lit("null")).alias("item"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
            F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("item").agg(F.sum("size").alias("size"))
    placed = work_table(rows.join(shard_groups(groups, n_shards), "item"), "shard-placed")
    buckets = max(1, -(-placed.count() // (n_shards * 20_000)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "item"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "item"))
    return (
        placed.withColumn("place", place)
        .join(offsets, ["shard", "bucket"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))
    )
