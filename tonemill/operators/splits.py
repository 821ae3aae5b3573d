"""Exact seeded splits: stratified train/test(/val), official hold-out, head/tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.operators.ranks import bucket_sizes, rank_thresholds
from tonemill.sources.numbering import quantile_buckets


def _order_key(key: str, seed: int) -> Column:
    """Seeded pseudo-random order: the same in any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def _largest_remainder(counts: DataFrame, label: str, drawn: Column, size: str, total: str, out: str) -> DataFrame:
    """Distribute ``drawn`` rows over classes of ``size`` rows out of ``total``; ties go to the first label.

    Runs on one row per class.
    """
    everything = Window.partitionBy(F.lit(0))
    exact = F.col(size) / F.col(total) * drawn
    df = counts.withColumn("_floor", F.floor(exact).cast("long")).withColumn("_rest", exact - F.floor(exact))
    df = df.withColumn("_missing", drawn - F.sum("_floor").over(everything))
    place = F.row_number().over(everything.orderBy(F.desc("_rest"), F.asc_nulls_last(label)))
    return df.withColumn(out, F.col("_floor") + (place <= F.col("_missing")).cast("long")).drop(
        "_floor", "_rest", "_missing"
    )


def split_quotas(counts: DataFrame, label: str, fractions: list[float]) -> DataFrame:
    """Per class, how many rows each chained split keeps.

    ``counts`` has (label, n). ``fractions[i]`` is the share the i-th split sends
    on to the next one: its size is ceil(fraction x rows), the rest stays. The
    result has (label, n, keep_0, keep_1, ...).
    """
    everything = Window.partitionBy(F.lit(0))
    df = counts.withColumn("_left", F.col("n"))
    for i, fraction in enumerate(fractions):
        df = df.withColumn("_total", F.sum("_left").over(everything))
        moved = F.ceil(F.col("_total") * F.lit(fraction)).cast("long")
        df = df.withColumn("_stay", F.col("_total") - moved)
        df = _largest_remainder(df, label, F.col("_stay"), "_left", "_total", f"keep_{i}")
        df = df.withColumn("_left", F.col("_left") - F.col(f"keep_{i}"))
    return df.drop("_left", "_total", "_stay")


def check_strata(counts: DataFrame, label: str, fractions: list[float]) -> None:
    """Fail as a stratified split must: fewer than two rows in a class, or a side smaller than the class count."""
    classes = split_quotas(counts, label, fractions).collect()
    left = [row["n"] for row in classes]
    for i in range(len(fractions)):
        stay = [row[f"keep_{i}"] for row in classes]
        if min(left, default=0) < 2:
            raise ValueError("Every class needs at least two rows for a stratified split.")
        if min(sum(stay), sum(left) - sum(stay)) < len(classes):
            raise ValueError("Each side of a stratified split needs at least one row per class.")
        left = [n - kept for n, kept in zip(left, stay)]


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    names: list[str],
    fractions: list[float],
    seed: int = 42,
) -> DataFrame:
    """Append ``split``: exact sizes per split and per class.

    ``names`` has one more entry than ``fractions``: with ``["train", "val",
    "test"]`` and ``[0.30, 0.50]``, 30 % leave train, and half of those leave val.
    Rows are taken in seeded hash order of a unique key, so the result does not
    depend on partitioning. Three narrow passes, no per-class sort. Labels are
    few: thresholds, one row per label, are broadcast.
    """
    hashed = df.select(F.col(label), F.col(key), _order_key(key, seed).alias("_h"))
    hashed = hashed.withColumn("_bucket", F.substring("_h", 1, 4))
    sizes = bucket_sizes(hashed, [label], "_bucket")
    counts = sizes.groupBy(label).agg(F.sum("_n").alias("n"))
    quotas = split_quotas(counts, label, fractions)
    upto, cuts = F.lit(0), []
    for i in range(len(fractions)):
        upto = upto + F.col(f"keep_{i}")
        cuts.append(F.struct(F.lit(i).alias("cut"), upto.alias("wanted")))
    cut_rows = quotas.select(label, F.inline(F.array(*cuts)))
    thresholds = rank_thresholds(hashed, sizes, cut_rows, [label], "_bucket", ["_h", key])
    per_label = thresholds.groupBy(label).pivot("cut", list(range(len(fractions)))).agg(F.first("threshold"))
    per_label = per_label.select(
        F.col(label).alias("_label"), *[F.col(str(i)).alias(f"_t{i}") for i in range(len(fractions))]
    )
    marked = df.withColumn("_pos", F.struct(_order_key(key, seed).alias("_h"), F.col(key)))
    joined = marked.join(F.broadcast(per_label), F.col(label).eqNullSafe(F.col("_label")), "left")
    choice = F.lit(names[-1])
    for i in reversed(range(len(fractions))):
        choice = F.when(F.col("_pos") <= F.col(f"_t{i}"), F.lit(names[i])).otherwise(choice)
    return joined.withColumn("split", choice).drop("_pos", "_label", *[f"_t{i}" for i in range(len(fractions))])


def holdout_split(
    df: DataFrame, key: str, label: str, fraction: float = 0.15, split: str = "split", seed: int = 42,
    train: str = "train", test: str = "test", validation: str = "validation", validation_name: str = "val",
) -> DataFrame:
    """Cut ``fraction`` of the official train rows off as test; official validation rows stay as they are."""
    official_train = stratified_split(
        df.where(F.col(split) == train).drop(split), key, label, [train, test], [fraction], seed
    )
    official_val = df.where(F.col(split) == validation).withColumn(split, F.lit(validation_name))
    return official_train.unionByName(official_val.select(official_train.columns))


def head_tail_split(df: DataFrame, key: str, val_ratio: float = 0.05, buckets: int | None = None) -> DataFrame:
    """Append ``split``: the first floor(n x (1 - ratio)) rows by ``key`` are train, the tail is val."""
    bucketed = quantile_buckets(df.select(key), key, buckets)
    sizes = bucket_sizes(bucketed, [], "_bucket")
    cuts = sizes.agg(F.lit(0).alias("cut"), F.floor(F.sum("_n") * (F.lit(1.0) - F.lit(val_ratio))).alias("wanted"))
    threshold = rank_thresholds(bucketed, sizes, cuts, [], "_bucket", [key]).select(F.col(f"threshold.{key}").alias("_last"))
    last = threshold.agg(F.max("_last").alias("_last"))
    return (
        df.join(F.broadcast(last))
        .withColumn("split", F.when(F.col(key) <= F.col("_last"), "train").otherwise("val"))
        .drop("_last")
    )


def split_summary(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Rows per split and label, with per-split totals (null label column) and the grand total."""
    return df.rollup(split, label).agg(
        F.count("*").alias("rows"), F.grouping_id().alias("level")
    )
