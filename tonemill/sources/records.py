"""Records of CSV files whose quoted cells run over line ends, read in many tasks.

Whether a line begins inside a quoted cell depends on all lines before it, but a line by
itself tells where it leads from either state: outside a cell or inside one. Most lines lead to the
same state from both, some keep the state and some turn it around. Such steps chain like
sums do: within the splits of a file first, then over one small row per split, so that every
split knows the state it begins in and finds its own record starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTED = r'[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+'
_CELL = rf'(?:"{_QUOTED}|(?!")[^,]*+)'
#: Lines that end outside a quoted cell, for those that begin outside and inside one. A quote within a bare cell is text.
ENDS_OUTSIDE = rf"\A{_CELL}(?:,{_CELL})*+\z"
LEAVES = rf"\A{_QUOTED}(?:,{_CELL})*+\z"
_SPLIT = ("_file", "_block")


def _opens(line: Column) -> Column:
    """Whether a line that begins outside a quoted cell ends inside one."""
    return F.contains(line, F.lit('"')) & ~line.rlike(ENDS_OUTSIDE)


def holds_line_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some quoted cell runs over its line's end: without a line that opens one, every line is a record."""
    return not spark.read.text(path, lineSep="\n").where(_opens(F.col("value"))).isEmpty()


def _chained(steps: DataFrame, window: Window) -> DataFrame:
    """``steps`` with ``fixed`` and ``turned`` over all steps up to each one.

    A step leads from state s to (fixed, else s) != turned: ``fixed`` is null where the state
    before matters, ``turned`` is whether it is turned around. A chain of steps is such a step.
    """
    turned = F.sum(F.col("turned").cast("int")).over(window) % 2 == 1
    since = F.last(F.when(F.col("fixed").isNotNull(), (F.col("fixed") != F.col("turned")) != F.col("_turned")), ignorenulls=True)
    return steps.withColumn("_turned", turned).withColumn("fixed", since.over(window)).withColumn("turned", F.col("_turned")).drop("_turned")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, _file, _block, _seq, fixed, turned): lines with their step."""
    lines = spark.read.text(path, lineSep="\n").select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    opens, stays = _opens(F.col("value")), ~F.col("value").rlike(LEAVES)
    lines = lines.withColumn("_opens", opens).withColumn("_stays", stays)
    return lines.select(
        "value", *_SPLIT, "_seq", F.when(F.col("_opens") == F.col("_stays"), F.col("_opens")).alias("fixed"), (F.col("_opens") & ~F.col("_stays")).alias("turned")
    )


def _state(start: str) -> Column:
    return F.coalesce("fixed", start) != F.col("turned")


def _split_starts(lines: DataFrame, in_split: Window) -> DataFrame:
    """(_file, _block, _inside): whether a split begins inside a quoted cell. No text is moved for it."""
    steps = lines.select(*_SPLIT, "_seq", "fixed", "turned")
    last = F.max_by(F.struct("fixed", "turned"), "_seq").alias("last")
    splits = _chained(steps, in_split).groupBy(*_SPLIT).agg(last)
    splits = splits.select(*_SPLIT, "last.*")  # a split is a step as well
    in_file = Window.partitionBy("_file").orderBy("_block")
    after = _chained(splits, in_file.rowsBetween(Window.unboundedPreceding, 0)).withColumn("_outside", F.lit(False))
    return after.withColumn("_after", _state("_outside")).select(*_SPLIT, F.lag("_after", 1, False).over(in_file).alias("_inside"))


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_file, _block, _seq, record): the text of each record, its line breaks kept, without blank records and headers.

    A record belongs to the split and the line where it begins. Splits are dealt to
    tasks; only the parts of records that run over a split's end meet elsewhere. Lines end
    at a line feed; a carriage return before it is no part of a record's end. A quote that is never closed
    takes the rest of its file.
    """
    lines = _lines(spark, path)
    by_line = Window.partitionBy(*_SPLIT).orderBy("_seq")
    in_split = by_line.rowsBetween(Window.unboundedPreceding, 0)
    placed = _chained(lines, in_split).join(_split_starts(lines, in_split), list(_SPLIT)).withColumn("_after", _state("_inside"))
    placed = placed.withColumn("_before", F.coalesce(F.lag("_after").over(by_line), "_inside"))
    placed = placed.withColumn("_first", F.max(F.when(~F.col("_before"), F.col("_seq"))).over(in_split))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "value"))), lambda x: x["value"]), "\n")
    parts = placed.groupBy(*_SPLIT, "_first").agg(text.alias("record"), F.max_by("_after", "_seq").alias("_open"))
    whole = parts.where(F.col("_first").isNotNull() & ~F.col("_open")).select(*_SPLIT, F.col("_first").alias("_seq"), "record")

    begins = F.sum(F.col("_first").isNotNull().cast("int"))
    in_order = Window.partitionBy("_file").orderBy("_block", F.col("_first").asc_nulls_first())
    cut = parts.where(F.col("_first").isNull() | F.col("_open")).withColumn("_chain", begins.over(in_order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "record"))), lambda x: x["record"]), "\n")
    cut = cut.groupBy("_file", "_chain").agg(F.min("_block").alias("_block"), F.max("_first").alias("_seq"), joined.alias("record"))

    filled = F.trim(F.regexp_replace("value", "[\r\t]", " ")) != ""
    headers = lines.where(filled).groupBy("_file").agg(F.min(F.struct("_block", "_seq")).alias("_top")).select("_file", "_top.*")
    records = whole.unionByName(cut.select(*_SPLIT, "_seq", "record")).join(headers, [*_SPLIT, "_seq"], "left_anti")
    records = records.withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return records.where(F.trim("record") != "")
