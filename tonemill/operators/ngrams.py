"""Top-k n-grams with first-seen tie-breaks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.functions.tokens import count_tokens, ngrams
from tonemill.runtime import work_table

# Salted parts of a size that rank their n-grams side by side.
RANK_PARTS = 64
#: Buckets of a size in which n-grams are counted first, whatever the corpus: no n-gram is more frequent than its bucket.
BUCKETS = 1 << 20
#: Corpora with no more n-grams than this are counted at once.
FEW = 2_000_000


def listed_tokens(df: DataFrame, key: str, stopwords: DataFrame, text: str = "text") -> DataFrame:
    """(key, _tokens): count tokens in order, less those in the table ``stopwords`` (word), of any size.

    Tokens meet the table in an anti-join and come back together by key; a null key is a key like others.
    """
    words = df.select(key, F.posexplode(count_tokens(F.col(text))).alias("_pos", "word"))
    kept = words.join(stopwords.select("word").distinct(), "word", "left_anti")
    ordered = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "word"))).alias("_t"))
    return ordered.select(key, F.transform("_t", lambda t: t["word"]).alias("_tokens"))


def ngram_counts(
    df: DataFrame, key: str, sizes: list[int], stopwords: Iterable[str] | DataFrame = (), text: str = "text"
) -> DataFrame:
    """(size, ngram, count, first_seen): every n-gram of the given sizes.

    ``stopwords`` is a short list written down by the caller, or a table (word) of any size.

    ``first_seen`` packs (key, position) into one decimal, a fixed-width value
    that keeps the aggregation hash-based; a struct would force a sort. The key
    must be a non-negative integer.
    """
    return _counted(_placed_ngrams(_tokens(df, key, stopwords, text), sizes))


def _tokens(df: DataFrame, key: str, stopwords: Iterable[str] | DataFrame, text: str) -> DataFrame:
    """(_base, _tokens): the key's part of ``first_seen`` and the tokens of each row."""
    base = F.col(key).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)")
    if isinstance(stopwords, DataFrame):
        return listed_tokens(df, key, stopwords, text).select(base.alias("_base"), "_tokens")
    return df.select(base.alias("_base"), count_tokens(F.col(text), stopwords).alias("_tokens"))


def _placed_ngrams(tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, ngram, _at)"""
    grams = [_placed(ngrams(F.col("_tokens"), n), n) for n in sizes]
    rows = tokens.select("_base", F.inline(F.concat(*grams) if len(grams) > 1 else grams[0]))
    return rows.select("size", "ngram", (F.col("_base") + F.col("pos")).alias("_at"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("size", "ngram").agg(F.count("*").alias("count"), F.min("_at").alias("first_seen"))


def frequent_counts(
    df: DataFrame, key: str, sizes: list[int], top_k: int, stopwords: Iterable[str] | DataFrame = (), text: str = "text"
) -> DataFrame:
    """The rows of ``ngram_counts`` that can be among the ``top_k`` of their size, and some others; all counts are exact.

    N-grams are first counted by bucket, in a table of fixed size. Those of the fullest buckets are counted by themselves:
    their ``top_k``-th count is one that the best reach at least. Then all buckets that hold as many are counted.
    """
    tokens = work_table(_tokens(df, key, stopwords, text), "tokens")
    rows = _placed_ngrams(tokens, sizes)
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64("ngram"), F.lit(BUCKETS)))
    buckets = work_table(bucketed.groupBy("size", "_bucket").agg(F.count("*").alias("_n")), "buckets")
    if (buckets.agg(F.sum("_n")).first()[0] or 0) <= FEW:
        return _counted(rows)
    fullest = [buckets.where(F.col("size") == n).orderBy(F.desc("_n"), "_bucket").limit(4 * top_k) for n in sizes]
    sure = work_table(_counted(bucketed.join(F.broadcast(reduce(DataFrame.union, fullest).drop("_n")), ["size", "_bucket"], "left_semi")), "sure")
    best = [
        sure.where(F.col("size") == n).orderBy(F.desc("count")).limit(top_k).agg(F.count("*").alias("found"), F.min("count").alias("least")).withColumn("size", F.lit(n))
        for n in sizes
    ]
    least = {r["size"]: r["least"] if r["found"] == top_k else 1 for r in reduce(DataFrame.union, best).collect()}  # a row a size
    reached = reduce(lambda a, b: a | b, [(F.col("size") == n) & (F.col("_n") >= least[n]) for n in sizes])
    kept = buckets.where(reached).drop("_n")
    return _counted(bucketed.join(F.broadcast(kept), ["size", "_bucket"], "left_semi"))


def _placed(grams: Column, n: int) -> Column:
    return F.transform(
        grams, lambda g, i: F.struct(F.lit(n).alias("size"), i.alias("pos"), g.alias("ngram"))
    )


def top_ngrams(
    df: DataFrame, key: str, n: int, top_k: int = 20, stopwords: Iterable[str] | DataFrame = (), text: str = "text"
) -> DataFrame:
    """The ``top_k`` most frequent n-grams; equal counts are ordered by first occurrence."""
    counts = frequent_counts(df, key, [n], top_k, stopwords, text)
    return counts.orderBy(F.desc("count"), "first_seen").limit(top_k).select("ngram", "count")


def top_ngram_table(
    df: DataFrame, key: str, sizes: list[int], top_k: int = 20, stopwords: Iterable[str] | DataFrame = (), text: str = "text"
) -> DataFrame:
    """(size, rank, ngram, count) for several sizes.

    N-grams are ranked within salted parts of a size first, whatever ``top_k``; the final
    ranking sees at most ``top_k`` rows of each part.
    """
    order = [F.desc("count"), "first_seen"]
    counts = frequent_counts(df, key, sizes, top_k, stopwords, text).withColumn("_part", F.pmod(F.xxhash64("ngram"), F.lit(RANK_PARTS)))
    within = F.row_number().over(Window.partitionBy("size", "_part").orderBy(*order))
    best = counts.withColumn("_place", within).where(F.col("_place") <= top_k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("size").orderBy(*order)))
    return ranked.where(F.col("rank") <= top_k).select("size", "rank", "ngram", "count")
