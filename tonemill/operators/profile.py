"""Corpus profile: one scan builds a small length table, every statistic is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.functions.text import PATTERNS, add_text_features

LENGTHS = ("char_length", "word_count")


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, missing): nulls per column, in one pass."""
    columns = columns or df.columns
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return counts.unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "missing")


def length_table(df: DataFrame, group: list[str], features: bool = True) -> DataFrame:
    """(group..., feature, value, n, pattern sums...): how many rows have each length.

    Its size is bounded by the longest text, not by the number of rows, and it
    is enough for means, medians, quantiles, histograms and pattern counts.
    """
    enriched = add_text_features(df) if features else df
    pair = F.inline(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("long").alias("value")) for f in LENGTHS])
    )
    flags = [n for n in PATTERNS] + ["is_blank", "parse_failed"]
    parse_failed = ~F.col("parse_ok") if "parse_ok" in df.columns else F.lit(False)
    rows = enriched.withColumns({"is_blank": F.col("text_stripped") == "", "parse_failed": parse_failed})
    rows = rows.select(*group, *flags, pair)
    return rows.groupBy(*group, "feature", "value").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags]
    )


def length_stats(lengths: DataFrame, group: list[str], digits: int = 4) -> DataFrame:
    """Mean, exact median, min and max of each length; long form with one row per feature."""
    value, n = F.col("value"), F.col("n")
    return lengths.groupBy(*group, "feature").agg(
        F.sum(n).alias("rows"),
        F.round(F.sum(value * n) / F.sum(n), digits).alias("mean"),
        F.round(F.percentile(value, 0.5, n), digits).alias("median"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def _hit_totals(counted: Column) -> dict[str, Column]:
    """Row-count sums over the length rows of one feature, so that every text counts once."""
    names = {"n": "num_rows", "is_blank": "empty_text_rows", "parse_failed": "parse_failures"}
    names.update({flag: flag.replace("has_", "rows_with_") for flag in PATTERNS})
    return {
        name: F.coalesce(F.sum(F.when(counted, F.col(column))), F.lit(0)).cast("long") for column, name in names.items()
    }


def pattern_counts(lengths: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Rows hit by each pattern, blank rows, parse failures and the row count."""
    totals = _hit_totals(F.col("feature") == LENGTHS[0])
    return lengths.groupBy(*(group or [])).agg(*[v.alias(k) for k, v in totals.items()])


def label_distribution(df: DataFrame, label: str = "label", group: list[str] | None = None) -> DataFrame:
    """(group..., label, count, ratio); a null label is a class of its own."""
    group = group or []
    counts = df.groupBy(*group, label).agg(F.count("*").alias("count"))
    totals = counts.groupBy(*group).agg(F.sum("count").alias("_total"))
    joined = counts.join(F.broadcast(totals), group) if group else counts.crossJoin(F.broadcast(totals))
    return joined.withColumn("ratio", F.col("count") / F.col("_total")).drop("_total")


def duplicate_count(df: DataFrame, columns: list[str] | None = None, group: list[str] | None = None) -> DataFrame:
    """Rows minus distinct rows over ``columns`` (all by default), nulls being equal.

    Rows are compared by SHA-256, so 32 bytes per distinct row are shuffled instead of its text.
    """
    group = group or []
    columns = columns or [c for c in df.columns if c not in group]
    digest = F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)).alias("_digest")
    groups = df.select(*group, digest).groupBy(*group, "_digest").agg(F.count("*").alias("_n"))
    return groups.groupBy(*group).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates")
    )


def histogram(lengths: DataFrame, group: list[str] | None = None, bins: int = 30) -> DataFrame:
    """(group..., feature, bin, low, high, count) over equal-width bins, empty bins included.

    Edges are min + i x width in doubles, a value belongs to the bin whose lower
    edge it reaches, the last bin is closed. A constant column gets
    [x - 0.5, x + 0.5].
    """
    keys = [*(group or []), "feature"]
    every = Window.partitionBy(*keys)
    low, high = F.min("value").over(every).cast("double"), F.max("value").over(every).cast("double")
    spanned = lengths.withColumns({"_lo": low, "_hi": high}).withColumn("_flat", F.col("_lo") == F.col("_hi"))
    spanned = spanned.withColumns(
        {
            "_lo": F.when(F.col("_flat"), F.col("_lo") - 0.5).otherwise(F.col("_lo")),
            "_hi": F.when(F.col("_flat"), F.col("_hi") + 0.5).otherwise(F.col("_hi")),
        }
    ).withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("_hi")).otherwise(i * F.col("_w") + F.col("_lo"))

    guess = F.least(
        F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)
    )
    # Settle rounding of the guess against the edges themselves.
    settled = (
        F.when(F.col("value") < edge(F.col("_g")), F.col("_g") - 1)
        .when((F.col("value") >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1), F.col("_g") + 1)
        .otherwise(F.col("_g"))
    )
    counted = spanned.withColumn("_g", guess).withColumn("bin", settled.cast("int"))
    counted = counted.groupBy(*keys, "_lo", "_hi", "_w", "bin").agg(F.sum("n").alias("_n"))
    filled = counted.groupBy(*keys, "_lo", "_hi", "_w").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "_n"))).alias("_counts")
    )
    filled = filled.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return filled.select(
        *keys,
        "bin",
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0)).cast("long").alias("count"),
    )


def box_plot(lengths: DataFrame, group: list[str], whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers clipped to the data and outlier counts; null groups are left out."""
    keys = [*group, "feature"]
    for g in group:
        lengths = lengths.where(F.col(g).isNotNull())
    value, n = F.col("value"), F.col("n")
    quantiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    quartiles = lengths.withColumn("_q", quantiles.over(Window.partitionBy(*keys))).select(
        *keys, "value", "n",
        F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"),
    )
    reach = whisker * (F.col("q3") - F.col("q1"))
    low, high = value >= F.col("q1") - reach, value <= F.col("q3") + reach
    whiskers = quartiles.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(low, value)).cast("double").alias("_low"),
        F.max(F.when(high, value)).cast("double").alias("_high"),
        F.sum(F.when(low & high, 0).otherwise(n)).alias("outliers"),
    )
    return whiskers.select(
        *keys,
        "q1",
        "median",
        "q3",
        F.least(F.coalesce("_low", "q1"), "q1").alias("whisker_low"),
        F.greatest(F.coalesce("_high", "q3"), "q3").alias("whisker_high"),
        F.col("outliers").cast("long").alias("outliers"),
    )


def summary_rows(lengths: DataFrame, group: list[str] | None = None, digits: int = 4) -> DataFrame:
    """(group..., stat, value): every scalar of the profile in one long table, from one aggregation."""
    group = group or []
    stats = _hit_totals(F.col("feature") == LENGTHS[0])
    for feature in LENGTHS:
        value = F.when(F.col("feature") == feature, F.col("value"))
        n = F.when(F.col("feature") == feature, F.col("n"))
        stats[f"{feature}_mean"] = F.round(F.sum(value * n) / F.sum(n), digits)
        stats[f"{feature}_median"] = F.round(F.percentile(value, 0.5, F.coalesce(n, F.lit(0))), digits)
        stats[f"{feature}_min"] = F.min(value)
        stats[f"{feature}_max"] = F.max(value)
    wide = lengths.groupBy(*group).agg(*[v.cast("double").alias(k) for k, v in stats.items()])
    return wide.unpivot(group, list(stats), "stat", "value")


def compare(rows: DataFrame, corpus: str, names: list[str]) -> DataFrame:
    """One row per statistic, one column per corpus."""
    return rows.groupBy("stat").pivot(corpus, names).agg(F.first("value"))
