"""Removal of lines that spread over many sites: sketches first, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.runtime import work_table

SITES = 10
SKETCH_ERROR = 0.1


def _hash(line: Column) -> Column:
    """128 bits of a line, as two longs; blanks at its ends don't count."""
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit("line"), trimmed).alias("b"))


def _lines(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """(digest of the text, site, line hash): each different line of each text that isn't blank."""
    hashes = F.array_distinct(F.transform(F.filter(F.split(text_col, "\n", -1), lambda x: F.trim(x) != ""), _hash))
    return docs.filter(F.col(text_col).isNotNull()).select(
        F.md5(text_col).alias("digest"), F.col(site_col).alias("site"), F.explode(hashes).alias("line")
    )


def spread_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = SITES) -> DataFrame:
    """The hashes of lines on ``min_sites`` sites or more, in as many different texts.

    HyperLogLog sketches of the sites and of the texts of each line merge on the way
    through one aggregation. A line whose estimates lie above twice the threshold
    passes, one below half of it doesn't (both far outside the sketch's error);
    the lines between get exact distinct counts. Counting texts too keeps copies of
    one document, spread over sites, from making all its lines boilerplate.
    A null site is no site.
    """
    lines = _lines(docs, text_col, site_col)
    sketched = lines.groupBy("line").agg(
        F.approx_count_distinct("site", SKETCH_ERROR).alias("sites"), F.approx_count_distinct("digest", SKETCH_ERROR).alias("texts")
    )
    least = F.least("sites", "texts")
    # Stored: sketches are then made once, and the joins below read plain tables, which Spark can split at a hot line.
    sketched = work_table(sketched.filter(least >= min_sites / 2).select("line", least.alias("least")), "spread-lines")
    near = sketched.filter(F.col("least") <= 2 * min_sites).select("line")
    exact = (
        lines.join(near, "line", "left_semi")
        .hint("rebalance")  # a line of many rows on few sites is dealt out evenly, and combined before it meets itself
        .groupBy("line")
        .agg(F.count_distinct("site").alias("sites"), F.count_distinct("digest").alias("texts"))
        .filter((F.col("sites") >= min_sites) & (F.col("texts") >= min_sites))
    )
    return sketched.filter(F.col("least") > 2 * min_sites).select("line").union(exact.select("line"))


def remove_boilerplate(
    docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = SITES
) -> DataFrame:
    """``docs`` with the text rid of lines that spread over sites, and n_lines and n_removed.

    All rows and other columns stay, also where no line is left (the text is then
    empty). Blank lines are kept and never counted. A null text stays null, with
    no lines. Columns called n_lines or n_removed are replaced. Two texts are told
    apart by their md5, so copies, repeated rows and missing ids need no key.
    """
    spread = spread_lines(docs, text_col, site_col, min_sites)
    per_text = (
        _lines(docs, text_col, site_col)
        .select("digest", "line")
        .join(spread, "line", "left_semi")
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.collect_set("line").alias("_spread"))
    )
    per_text = work_table(per_text, "spread-of-texts")  # stored, so that the join below can be split at a text with many copies
    lines = F.split(text_col, "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains("_spread", _hash(x)) | (F.trim(x) == ""))
    found = F.col("_spread").isNotNull()
    total = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    return (
        docs.drop("n_lines", "n_removed")
        .withColumn("_digest", F.md5(text_col))
        .join(per_text, "_digest", "left")
        .withColumn("_kept", F.when(found, kept))
        .withColumns(
            {
                text_col: F.when(found, F.array_join("_kept", "\n")).otherwise(F.col(text_col)),
                "n_lines": total,
                "n_removed": F.when(found, total - F.size("_kept")).otherwise(0),
            }
        )
        .drop("_digest", "_spread", "_kept")
    )
