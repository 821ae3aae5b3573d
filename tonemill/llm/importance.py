"""Target-distribution importance resampling over hashed word runs, whose hashes come from running CRCs."""

from __future__ import annotations

import zlib
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.llm.common import scalars, text_slices, utf8
from tonemill.runtime import work_table
from tonemill.sources.numbering import quantile_buckets

LONGEST = 1
BUCKETS = 10_000
SCALE = 1000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

_POLYNOMIAL = 0xEDB88320
#: A-Z to a-z; every other ASCII byte that is no letter or digit separates words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


@cache
def _byte_table() -> np.ndarray:
    """What a CRC register turns into when a byte of zeros is shifted through its lowest byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


@cache
def _shift(power: int) -> np.ndarray:
    """The GF(2) map of a CRC over 2**power more bytes of zeros, as four tables, one for each byte of the CRC."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    if power == 0:
        moved = _byte_table()[values & 255] ^ (values >> 8)
    else:
        moved = _apply(_shift(power - 1), _apply(_shift(power - 1), values))
    return moved.reshape(4, 256)


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC as it would stand after ``by`` bytes of zeros: what a prefix adds to the CRC of a longer text."""
    out, power = crc.copy(), 0
    while len(by) and (by >> power).any():
        chosen = np.flatnonzero((by >> power) & 1)
        out[chosen] = _apply(_shift(power), out[chosen])
        power += 1
    return out


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def run_crcs(words: list[bytes], text_of: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, crc32) of all runs of 1 to ``longest`` words that lie within one text.

    The words, each after one separator, are scanned once with a running CRC. A run's own CRC is the
    one at its end, less the one at its start carried over the run's length: whatever stood
    before the run cancels out.
    """
    end = np.fromiter(accumulate(words, lambda crc, word: zlib.crc32(word, zlib.crc32(b" ", crc)), initial=0), np.uint32, len(words) + 1)
    register = ~end[:-1]
    start = ~(_byte_table()[(register ^ np.uint32(32)) & 255] ^ (register >> 8))  # past the separator
    to = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.r_[np.int64(0), to[:-1]][: len(words)] + 1
    texts, crcs = [], []
    for size in range(1, longest + 1):
        first = np.arange(max(len(words) - size + 1, 0))
        first = first[text_of[first] == text_of[first + size - 1]] if size > 1 else first
        last = first + size - 1
        texts.append(text_of[first])
        crcs.append(end[1:][last] ^ shifted(start[first], to[last] - begin[first]))
    return np.concatenate(texts), np.concatenate(crcs)


def hashed_runs(docs: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(id, n_words, buckets ARRAY<INT>): each text's runs of words as hash buckets, repeats kept."""

    def run(batches):
        for batch in batches:
            for low, high in text_slices(batch, "text"):
                part = batch.slice(low, high - low)
                words, size = [], []
                for text in utf8(part, "text"):
                    own = words_of(text)
                    words += own
                    size.append(len(own))
                text, crc = run_crcs(words, np.repeat(np.arange(len(size)), size), longest)
                order = np.argsort(text, kind="stable")
                place = np.searchsorted(text[order], np.arange(len(size) + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(place), pa.array((crc[order] % np.uint32(buckets)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), runs], names=["id", "n_words", "buckets"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, n_words long, buckets array<int>")


def _bucket_counts(runs: DataFrame, name: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            bucket, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    return runs.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Each bucket's gain: the scaled logarithm of its share of the target over its share of the source, floored.

    Both shares have one more in every bucket. ``source`` and ``target`` are tables of ``hashed_runs``.
    """
    counts = _bucket_counts(source, "s").join(_bucket_counts(target, "t"), "bucket", "full").fillna(0, ["s", "t"])
    sums = scalars(counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")))

    def gain(s: Column, t: Column) -> Column:
        ratio = ((t + 1) * F.lit(float(sums["s"] + buckets))) / ((s + 1) * F.lit(float(sums["t"] + buckets)))
        return F.floor(SCALE * F.log(ratio))

    unseen = scalars(counts.sparkSession.range(1).select(gain(F.lit(0.0), F.lit(0.0)).alias("gain")))["gain"]
    out = np.full(buckets, unseen, dtype=np.int64)
    table = counts.select("bucket", gain(F.col("s").cast("double"), F.col("t").cast("double")).alias("gain")).toArrow()  # a row a bucket
    out[table.column("bucket").to_numpy()] = table.column("gain").to_numpy()
    return out


def _weighed(runs: DataFrame, gains: np.ndarray) -> DataFrame:
    shared = runs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        for batch in batches:
            lists = batch.column("buckets")
            sums = np.r_[0, np.cumsum(shared.value[lists.flatten().to_numpy(zero_copy_only=False)])]
            place = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), pa.array(np.diff(place).astype(np.int64)), pa.array(np.diff(sums[place]).astype(np.int64))],
                names=["id", "n_words", "n_features", "weight"],
            )

    return runs.mapInArrow(run, f"id {runs.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def _noise(id_text: Column, seed: int) -> Column:
    """Scaled Gumbel noise of an id, floored."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-SCALE * F.log(-F.log(uniform)))


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with their rank by score, ties to the smaller id: sorted in even ranges, shifted by the ranges before."""
    ends = scalars(rows.agg(F.min("id").cast("double").alias("low"), F.max("id").cast("double").alias("high")))
    width = (ends["high"] or 0.0) - (ends["low"] or 0.0) + 1.0
    place = (F.coalesce(F.col("id"), F.lit(ends["low"] or 0.0)).cast("double") - F.lit(ends["low"] or 0.0)) / F.lit(width)
    parted = quantile_buckets(rows.withColumn("_order", place - F.col("score")), "_order")
    sizes = parted.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.desc("score"), "id", "n_features"))
    ranked = parted.withColumn("_within", within).join(F.broadcast(offsets), "_bucket")
    return ranked.withColumn("rank", F.col("_before") + F.col("_within")).drop("_order", "_bucket", "_within", "_before")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = LONGEST,
    buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row: a draw of documents that resemble ``target``.

    Words are runs of ASCII letters, digits and all other characters above ASCII, A-Z lower-cased;
    features are all runs of 1 to ``longest`` words, counted in ``buckets`` by the CRC of their bytes. A
    document's weight is the sum of its features' gains, its score that plus the noise of its id; of
    those with ``least_words`` words or more, the ``percent`` per cent of highest score are ranked from 1, ties to the
    smaller id; the rank of others is null. Ids are integers. Null, blank and wordless texts have no
    features, weight 0 and are never drawn; a null id counts as the id '' in the noise and comes first in
    ties. Repeated rows and ids are drawn each for itself. An empty ``docs`` gives no row; an empty ``target``
    is a uniform one. Other columns of both tables are left out.
    """
    source = work_table(hashed_runs(docs, id_col, text_col, longest, buckets), "runs")
    aimed = work_table(hashed_runs(target.withColumn("_id", F.lit(0)), "_id", target_text, longest, buckets), "target-runs")
    weighed = _weighed(source, bucket_gains(source, aimed, buckets))
    score = F.col("weight") + _noise(F.coalesce(F.col("id").cast("string"), F.lit("")), seed)
    scored = work_table(weighed.withColumn("score", score), "scored")
    fit = F.col("n_words") >= least_words
    drawn = percent * scored.filter(fit).count() // 100
    unranked = scored.withColumn("rank", F.lit(None).cast("long"))
    if drawn:
        ranked = _ranked(scored.filter(fit))
        ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
        unranked = ranked.unionByName(unranked.filter(~fit))
    return unranked.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
