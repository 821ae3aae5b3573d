"""Connected components of a large graph, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import scalars
from tonemill.runtime import work_table


def _state(edges: DataFrame) -> tuple:
    row = scalars(edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
    return row["n"], row["sum"]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of all nodes with an edge; the component is its smallest node.

    ``edges`` has long columns a and b; loops and repeated edges do no harm. Large-star and
    small-star steps alternate: each node's larger neighbours, then its smaller ones, are
    tied to the smallest neighbour, until only stars are left. Each step is an aggregation
    and a join on the node, written to the shared folder; a hub's rows are combined
    before they are shuffled, and the join can be split.
    """
    up = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = work_table(up, name), None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = work_table(large, name)
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(smallest, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = work_table(tied.union(smallest.select("a", F.col("m").alias("b"))).distinct(), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
