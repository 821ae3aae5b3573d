"""Benchmark decontamination by greedy string tiling over documents that share seeds with an item."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import sliced
from tonemill.runtime import work_table

SEED = 5
COVERAGE = 0.6
#: Bits of the filter that documents meet before the join: fixed, so is its size (1 MB) for any benchmark.
FILTER_BITS = 1 << 23
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")
#: Words whose codes a task keeps.
CACHED = 500_000


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _codes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit codes of words, kept in ``known``: a task's own, which goes with it, as the worker goes on to other stages."""
    if len(known) > CACHED:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``length`` codes, modulo 2**64."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        out = out * _MULTIPLIER + codes[k : k + n]
    return out ^ (out >> np.uint64(29))


def _matches(item, doc, free_item, free_doc, length):
    """Maximal common runs (length, item start, doc start) of free codes, from windows of equal hash."""
    found: dict[int, list[int]] = {}
    whole = lambda free: np.flatnonzero(np.convolve(free, np.ones(length, dtype=int), "valid") == length)
    hashes = window_hashes(item, length)
    for i in whole(free_item) if len(hashes) else ():
        found.setdefault(int(hashes[i]), []).append(int(i))
    hashes = window_hashes(doc, length)
    if not found or not len(hashes):
        return []
    at = whole(free_doc)
    at = at[np.isin(hashes[at], np.fromiter(found, dtype=np.uint64, count=len(found)))]
    out = []
    for j in at.tolist():
        for i in found[int(hashes[j])]:
            if i and j and free_item[i - 1] and free_doc[j - 1] and item[i - 1] == doc[j - 1]:
                continue  # begins further left
            n = 0
            while i + n < len(item) and j + n < len(doc) and free_item[i + n] and free_doc[j + n] and item[i + n] == doc[j + n]:
                n += 1
            if n >= length:
                out.append((n, i, j))
    return out


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, length) that cover no code twice, longest first.

    Running Karp-Rabin: windows of the search length are met by their hashes, matches are
    run to their ends and marked longest first. A match that a longer one cuts into is left
    for the next round, whose search length is the longest run still free, or half of the
    length before; the last round searches for ``least``.
    """
    least = max(1, min(least, len(item)))
    free_item, free_doc = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    tiles, length = [], max(least, len(item))
    while len(item) and len(doc):
        found = _matches(item, doc, free_item, free_doc, length)
        cut = 0
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_item[i : i + n].all() and free_doc[j : j + n].all():
                free_item[i : i + n] = free_doc[j : j + n] = False
                tiles.append((i, j, n))
            else:
                cut = max(cut, n)
        if cut >= length:
            continue
        if length == least:
            return tiles
        length = max(least, length // 2)
    return tiles


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, item_text): ``item`` is the md5 of the text, whatever the ids are; null texts are left out."""
    text = F.col("text").cast("string")
    return benchmark.filter(text.isNotNull()).select(F.md5(text).alias("item"), F.col("item_id").cast("long").alias("item_id"), text.alias("item_text"))


def _seeds(items: DataFrame, seed: int) -> DataFrame:
    """(seed, item, place, length, window): the windows of ``seed`` words of each text; shorter texts are one window."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            out: dict[str, list] = {"seed": [], "item": [], "place": [], "length": [], "window": []}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = _codes(tokens(text), known)
                window = min(seed, len(codes))
                for place, code in enumerate(window_hashes(codes, window).view(np.int64).tolist() if window else ()):
                    for name, value in zip(out, (code, item, place, len(codes), window)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("seed", pa.int64()), ("item", pa.string()), ("place", pa.int32()), ("length", pa.int32()), ("window", pa.int32())])
    return items.select("item", "item_text").mapInArrow(run, "seed long, item string, place int, length int, window int")


def _filter_words(seeds: DataFrame, bits: int) -> np.ndarray:
    place = F.pmod(F.col("seed"), F.lit(bits))
    words = seeds.select((place / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(seed, {bits}) % 64 as int))").alias("bit"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """(digest, item_id, covered, length): md5 of each text in ``docs`` with an item it covers, and by how many words.

    Items are told apart by their texts, so that each text of an id is tried and a null id is one like any other.
    """
    items = _items(benchmark)
    texts_of = items.groupBy("item").agg(F.first("item_text").alias("item_text"))
    seeds = work_table(_seeds(texts_of, seed), "seeds")
    windows = [r["window"] for r in seeds.select("window").distinct().collect()]
    filters = docs.sparkSession.sparkContext.broadcast(_filter_words(seeds, FILTER_BITS))

    def find(batches):
        words, known = filters.value, {}
        for batch in sliced(batches, "text"):
            out: dict[str, list] = {"digest": [], "text": [], "seeds": []}
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = _codes(tokens(text), known)
                hashes = np.concatenate([window_hashes(codes, w) for w in windows] or [np.zeros(0, dtype=np.uint64)])
                place = (hashes.view(np.int64) % FILTER_BITS).astype(np.int64)
                hits = np.unique(hashes[(words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1])
                if len(hits):
                    for name, value in zip(out, (digest, text, hits.view(np.int64))):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("digest", pa.string()), ("text", pa.string()), ("seeds", pa.list_(pa.int64()))])
    chosen = docs.filter(F.col(text_col).isNotNull()).select(F.md5(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    passing = work_table(chosen.mapInArrow(find, "digest string, text string, seeds array<long>"), "passing")
    # A tile of n words has n - window + 1 seeds, so a covering of c words takes c / window of them at least.
    pairs = (
        passing.select("digest", F.explode("seeds").alias("seed"))
        .distinct()
        .join(seeds, "seed")
        .groupBy("digest", "item")
        .agg(F.count_distinct("place").alias("places"), F.max("length").alias("length"), F.max("window").alias("window"))
        .filter(F.col("places") * F.col("window") >= coverage * F.col("length"))
        .select("digest", "item", "window")
    )
    texts = passing.groupBy("digest").agg(F.first("text").alias("text"))

    def cover(batches):
        known: dict[str, int] = {}
        for batch in sliced(batches, "text"):
            rows, out = batch.to_pydict(), {"digest": [], "item": [], "covered": [], "length": []}
            for digest, item, window, text, item_text in zip(*(rows[k] for k in ("digest", "item", "window", "text", "item_text"))):
                codes = _codes(tokens(item_text), known)
                covered = sum(n for _, _, n in tile(codes, _codes(tokens(text), known), window))
                if covered >= coverage * len(codes):
                    for name, value in zip(out, (digest, item, covered, len(codes))):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=found)

    found = pa.schema([("digest", pa.string()), ("item", pa.string()), ("covered", pa.int32()), ("length", pa.int32())])
    both = pairs.join(texts_of, "item").join(texts, "digest").select("digest", "item", "window", "text", "item_text")
    covered = both.mapInArrow(cover, "digest string, item string, covered int, length int")
    best = F.max(F.struct((F.col("covered") / F.col("length")).alias("share"), "covered", "length")).alias("best")
    named = covered.join(items.select("item", "item_id").distinct(), "item").groupBy("digest", "item_id").agg(best)
    return work_table(named.select("digest", "item_id", "best.covered", "best.length"), "contaminated")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE
) -> DataFrame:
    """(id, item_id, covered, length, coverage) of documents that hold ``coverage`` of an item's words or more.

    Words are runs of letters, digits and underscores in lower case. Tiles of ``seed`` words or
    more are matched in any order, each word once, so passages whose sentences
    changed places are found as well; an item of fewer words is one tile, one of none
    is in no document. ``benchmark`` has item_id and text; each text is tried by itself, and
    of several covered ones with the same id, null included, the best covered stands. Null and blank texts hold nothing. Equal texts are tiled once, and
    repeated rows and ids each give their rows. Other columns are left out.
    """
    texts = contaminated_texts(docs, benchmark, text_col, seed, coverage)
    rows = docs.select(F.col(id_col).alias(id_col), F.md5(text_col).alias("digest"))
    return rows.join(texts, "digest").select(id_col, "item_id", "covered", "length", (F.col("covered") / F.col("length")).alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay, null texts too."""
    texts = contaminated_texts(docs, benchmark, text_col, seed, coverage).select(F.col("digest").alias("_digest"))
    return docs.withColumn("_digest", F.md5(text_col)).join(texts.distinct(), "_digest", "left_anti").drop("_digest")
