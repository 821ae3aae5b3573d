"""TF-IDF in long form: (key, term, tf) -> vocabulary -> (key, term, weight)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.functions.accents import fold_accents
from tonemill.functions.arrays import run_lengths
from tonemill.functions.tokens import feature_tokens, ngram_range
from tonemill.runtime import work_table

# A vocabulary is broadcast only when max_features bounds it to this many terms.
MAX_BROADCAST_TERMS = 200_000
# Texts whose words and n-grams are arrays at the same time.
COUNTED_AT_ONCE = 256


def doc_terms(
    docs: DataFrame,
    keys: list[str],
    ngrams: tuple[int, int] = (1, 2),
    carry: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """(keys..., carry..., term, tf) of ``counted_texts``. A text without terms keeps one row with a null term."""
    return exploded(counted_texts(docs, keys, ngrams, carry, text))


def counted_texts(
    docs: DataFrame,
    keys: list[str],
    ngrams: tuple[int, int] = (1, 2),
    carry: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """(keys..., carry..., counts ARRAY<STRUCT<term, tf>>): lowercase, fold accents, words of two or more characters, n-grams.

    Folded texts are partitioned by key once and counted within their row, so that no table
    of (text, term) pairs is kept in memory, and later per-text steps need no further exchange.
    The partitions are the session's, not merged by adaptive execution, as terms take many times
    the room of their texts. Folding comes first because a Python step would hide the
    partitioning.
    """
    carry = carry or []
    tokens = _tokens(docs, keys, carry, text)
    grams = F.flatten(F.transform("_tokens", lambda t: ngram_range(t, *ngrams)))
    return tokens.select(*keys, *carry, run_lengths(F.sort_array(grams), "term", "tf").alias("counts"))


def _tokens(docs: DataFrame, keys: list[str], carry: list[str], text: str) -> DataFrame:
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lowered = docs.select(*keys, *carry, F.lower(text).alias("_text"))
    folded = lowered.withColumn("_text", fold_accents(F.col("_text"))).repartition(partitions, *keys)
    together = folded.groupBy(*keys, *carry).agg(F.collect_list("_text").alias("_texts"))
    return together.select(*keys, *carry, F.transform("_texts", feature_tokens).alias("_tokens"))


def stored_counts(docs: DataFrame, keys: list[str], ngrams: tuple[int, int] = (1, 2), carry: list[str] | None = None) -> DataFrame:
    """``counted_texts``, written once for several passes: words are numbered and their n-grams counted in Arrow, some texts at a time.

    A stored table has no partitioning for the Python step to hide. A text's terms are in no order.
    """
    carry, step, (low, high) = carry or [], COUNTED_AT_ONCE, ngrams
    tokens = _tokens(docs, keys, carry, "text")

    def count(texts: pa.ListArray) -> pa.ListArray:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        inner = texts.flatten()  # a row's texts; n-grams don't cross from one to the next
        coded = inner.flatten().dictionary_encode()
        words, places = coded.dictionary, coded.indices.to_numpy()
        ends = inner.offsets.to_numpy() - inner.offsets[0].as_py()
        row = np.repeat(np.arange(len(texts)), np.diff(texts.offsets.to_numpy()))
        left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(places))  # words of the text from here on
        owner, gram, at = np.repeat(row, np.diff(ends)), np.zeros(len(places), np.int64), np.arange(len(places))
        found = []
        for n in range(1, high + 1):
            kept = left[at] >= n
            at, gram = at[kept], gram[kept]
            _, gram = np.unique(gram * max(len(words), 1) + places[at + n - 1], return_inverse=True)
            if n < low:
                continue
            _, first, tf = np.unique(owner[at] * (gram.max(initial=0) + 1) + gram, return_index=True, return_counts=True)
            first = at[first]
            parts = [words.take(pa.array(places[first + i])) for i in range(n)]
            found.append((owner[first], parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " "), tf))
        owners = np.concatenate([o for o, _, _ in found])
        order = np.argsort(owners, kind="stable")
        terms = pa.concat_arrays([t for _, t, _ in found]).take(pa.array(order))
        entries = pa.StructArray.from_arrays([terms, pa.array(np.concatenate([c for _, _, c in found])[order].astype(np.int64))], names=["term", "tf"])
        offsets = np.append(0, np.cumsum(np.bincount(owners, minlength=len(texts))))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, *carry)], count(batch.column("_tokens"))], names=[*keys, *carry, "counts"])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields if f.name != "_tokens"]
    return work_table(tokens.mapInArrow(run, ", ".join([*columns, "counts array<struct<term: string, tf: bigint>>"])), "counts")


def exploded(counted: DataFrame) -> DataFrame:
    """``counted_texts`` with a row for each term."""
    rows = counted.select(*[c for c in counted.columns if c != "counts"], F.inline_outer("counts"))
    return rows.withColumn("tf", F.coalesce("tf", F.lit(1).cast("long")))


def known_terms(counted: DataFrame, numbered: DataFrame, carry: list[str]) -> DataFrame:
    """(carry..., indices, values, squares) of ``counted_texts`` by a bounded vocabulary (term_id, term, idf).

    ``values`` are the sublinear frequencies of a text's known terms, ``squares`` the sum of the squares of their raw weights.
    """
    table = numbered.select("term_id", "term", "idf").toArrow().sort_by("term_id").combine_chunks()
    vocabulary, idf = table["term"].chunk(0), table["idf"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            counts = batch.column("counts")
            entries, offsets = counts.flatten(), counts.offsets.to_numpy()
            found = pc.index_in(entries.field("term").cast(vocabulary.type), value_set=vocabulary)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(known))[offsets - offsets[0]]
            terms = found.drop_null().to_numpy()
            values = np.log(entries.field("tf").to_numpy(zero_copy_only=False)[known]) + 1.0
            owner = np.repeat(np.arange(len(counts)), np.diff(ends))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(data)) for data in (terms, values)]
            squares = np.bincount(owner, (values * idf[terms]) ** 2, minlength=len(counts)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [*lists, pa.array(squares, pa.float64())], names=[*carry, "indices", "values", "squares"])

    kept = counted.select(*carry, "counts")
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "counts"]
    return kept.mapInArrow(run, ", ".join([*columns, "indices array<int>", "values array<double>", "squares double"]))


def fit_vocabulary(
    terms: DataFrame, docs: DataFrame, min_df: int | float = 1, max_features: int | None = None
) -> DataFrame:
    """(term, df, cf, idf): terms in at least ``min_df`` texts (a float is a share of them),
    cut to the ``max_features`` most frequent by corpus count, ties in term order."""
    total = docs.agg(F.count("*").alias("_n"))
    stats = (
        terms.where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        .crossJoin(F.broadcast(total))
    )
    least: Column = F.col("_n") * F.lit(min_df) if isinstance(min_df, float) else F.lit(min_df)
    stats = stats.where(F.col("df") >= least)
    if max_features is not None:
        stats = stats.orderBy(F.desc("cf"), "term").limit(max_features)
    idf = F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1
    return stats.select("term", "df", "cf", idf.alias("idf"))


def is_bounded(max_features: int | None) -> bool:
    """Whether ``max_features`` keeps a vocabulary provably small."""
    return max_features is not None and max_features <= MAX_BROADCAST_TERMS


def bounded(table: DataFrame, max_features: int | None) -> DataFrame:
    """Hint a broadcast when the term table is provably small; otherwise leave the join to the optimizer."""
    return F.broadcast(table) if is_bounded(max_features) else table


def raw_weight() -> Column:
    """Sublinear term frequency times idf, before the per-text norm."""
    return (F.log(F.col("tf").cast("double")) + 1) * F.col("idf")


def tfidf_weights(
    terms: DataFrame, vocabulary: DataFrame, keys: list[str], max_features: int | None = None, keep_empty: bool = False
) -> DataFrame:
    """``terms`` with the vocabulary's columns and the L2-normalised ``weight``.

    ``keep_empty`` also keeps unknown terms, with a null weight, so that texts
    without any known term stay visible to a later aggregation.
    """
    joined = terms.join(bounded(vocabulary, max_features), "term", "left" if keep_empty else "inner")
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(*keys)))
    return joined.withColumn("_raw", raw_weight()).withColumn("weight", F.col("_raw") / norm).drop("_raw")
