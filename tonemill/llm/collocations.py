"""Phrase collocations from count streams that are kept in prefix order and in suffix order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.llm.common import text_slices, utf8
from tonemill.runtime import work_table

LONGEST = 5
LEAST_COUNT = 100
SCALE = 1000
#: A phrase goes where a longer one has this share of its count, in per cent.
INSIDE_PERCENT = 100
TOP = 2000
NO_LANG = "und"
#: Bits of the filter of frequent phrases that a task holds: fixed, so is its size (8 MB) for any corpus. Where it
#: fills up, more phrases are counted than need be; the counts stay right.
FILTER_BITS = 1 << 26
#: Salted parts of a language that rank their phrases side by side.
RANK_PARTS = 64

_BREAK = b","
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to a-z, a tab to a blank, all that ends a piece to one mark.
_NORMAL = bytes(ord(",") if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def marked_words(texts: list[bytes]) -> list[bytes]:
    """The words of all texts in order, with a break mark where a piece or a text ends."""
    return _BREAK.join(texts).translate(_NORMAL).replace(_BREAK, b" , ").split()


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(31))) * _MULTIPLIER
    return codes ^ (codes >> np.uint64(29))


class _Slice:
    """Words of one language's texts as numbers, with hashes of all their runs."""

    def __init__(self, lang: str, texts: list[bytes]):
        coded = pa.array(marked_words(texts), pa.binary()).dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.inside = np.fromiter((w != _BREAK for w in self.words), bool, len(self.words))[self.codes]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.hashes = hashes[self.codes]
        self.seed = np.uint64(xxhash.xxh64_intdigest(lang))

    def starts(self, size: int) -> np.ndarray:
        """Where runs of ``size`` words begin that hold no break."""
        if len(self.codes) < size:
            return np.zeros(0, dtype=np.int64)
        whole = self.inside[: len(self.codes) - size + 1].copy()
        for k in range(1, size):
            whole &= self.inside[k : len(self.codes) - size + 1 + k]
        return np.flatnonzero(whole)

    def run_hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(starts), self.seed)
        for k in range(size):
            out = out * _MULTIPLIER + self.hashes[starts + k]
        return _mixed(out)

    def counted(self, starts: np.ndarray, size: int) -> tuple[list[bytes], np.ndarray]:
        """The distinct runs at ``starts`` and how often each stands there."""
        key, span = self.codes[starts], max(len(self.words), 1)
        held = span
        for k in range(1, size):
            if held * span > 1 << 62:
                key, held = np.unique(key, return_inverse=True)[1].astype(np.int64), len(key)
            key = key * span + self.codes[starts + k]
            held *= span
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        at = self.codes[starts[first][:, None] + np.arange(size)]
        return [b" ".join([self.words[c] for c in row]) for row in at.tolist()], n


def _in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), dtype=bool)
    for place in (hashes % np.uint64(FILTER_BITS), (hashes >> np.uint64(32)) % np.uint64(FILTER_BITS)):
        found &= (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def _filter_words(phrases: DataFrame, size: int) -> np.ndarray:
    """The bits that stand for (lang, phrase) rows; at most FILTER_BITS / 64 rows come to the driver."""

    def run(batches):
        for batch in batches:
            hashes = np.zeros(batch.num_rows, dtype=np.uint64)
            for row, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                code = xxhash.xxh64_intdigest(lang)
                for word in phrase.split(b" "):
                    code = (code * int(_MULTIPLIER) + xxhash.xxh64_intdigest(word)) % (1 << 64)
                hashes[row] = code
            hashes = _mixed(hashes)
            place = np.r_[hashes % np.uint64(FILTER_BITS), (hashes >> np.uint64(32)) % np.uint64(FILTER_BITS)]
            bit = np.left_shift(np.uint64(1), place & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array(bit)], names=["word", "bit"])

    bits = phrases.select("lang", "phrase").mapInArrow(run, "word int, bit long")
    table = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def _counts(docs: DataFrame, size: int, known: np.ndarray | None) -> DataFrame:
    """(lang, phrase, f): runs of ``size`` words whose first and last ``size`` - 1 words pass the filter, counted.

    Tasks hold a few megabytes of text at a time, and Spark adds their counts before the exchange.
    """
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            for low, high in text_slices(batch, "text"):
                part, by_lang = batch.slice(low, high - low), {}
                for lang, text in zip(part.column("lang").to_pylist(), utf8(part, "text")):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    words = _Slice(lang, texts)
                    starts = words.starts(size)
                    if shared is not None:
                        for ahead in (0, 1):
                            starts = starts[_in_filter(shared.value, words.run_hashes(starts + ahead, size - 1))]
                    phrases, n = words.counted(starts, size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "f"]
                    )

    return docs.mapInArrow(run, "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, words ARRAY<STRING>, f) of all phrases of up to ``longest`` words with ``least`` occurrences, and (lang, n) of all words.

    ``docs`` has lang and text. A phrase can only be as frequent as what is left of it without its first or
    last word, so each length is counted among runs that the length before leaves.
    """
    words = work_table(_counts(docs, 1, None), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    level, levels = work_table(words.filter(F.col("f") >= least), "phrases"), []
    for size in range(2, longest + 1):
        levels.append(level)
        known = _filter_words(level, size - 1)
        if not known.any():
            break
        level = work_table(_counts(docs, size, known).filter(F.col("f") >= least), "phrases")
    else:
        levels.append(level)
    union = levels[0]
    for other in levels[1:]:
        union = union.unionByName(other)
    return work_table(union.select("lang", F.split(F.col("phrase").cast("string"), " ").alias("words"), "f"), "frequent"), totals


class _Walk:
    """A sorted stream's open phrases: each begins with the one below it."""

    def __init__(self):
        self.stack: list[list] = []  # words, f, counts of the shorter ones, most frequent extension, whether its row is here
        self.out: list[tuple] = []

    def enter(self, lang: str, opening: list[tuple[list[str], int]]) -> None:
        self.close(0)
        self.lang = lang
        for words, f in opening:
            self.push(words, f, False)

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            words, f, shorter, extension, own = self.stack.pop()
            if own or extension:
                self.out.append((self.lang, words, f if own else None, shorter if own else None, extension))

    def push(self, words: list[str], f: int, own: bool = True) -> None:
        while self.stack and self.stack[-1][0] != words[: len(self.stack[-1][0])]:
            self.close(len(self.stack) - 1)
        shorter = []
        if self.stack:
            above = self.stack[-1]
            shorter = [*above[2], above[1]]
            if own:
                above[3] = max(above[3], f)
        self.stack.append([words, f, shorter, 0, own])


def lockstep(phrases: DataFrame) -> DataFrame:
    """(lang, words, f, shorter, extension) in the order of ``words``: one merged pass over the streams of all lengths.

    ``phrases`` holds (lang, words, f), with each phrase also what it begins with. In order, a phrase
    stands right before those that it begins, so the counts of its ``shorter`` beginnings, by length, and of its
    most frequent ``extension`` by one word are met by walking on, with as many rows in hand as the longest
    phrase has words. The streams are cut in even ranges; a range opens with the beginnings of its first phrase. What
    a range adds to a phrase of an earlier range is a row without f.
    """
    spark = phrases.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = phrases.repartitionByRange(parts, "lang", "words").withColumn("part", F.spark_partition_id())
    stored = work_table(ranged, "stream")
    firsts = stored.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("first"))
    begun = firsts.select(
        F.col("part").alias("_part"), F.col("first.lang").alias("lang"), F.explode(F.transform(F.sequence(F.lit(1), F.size("first.words")), lambda k: F.slice("first.words", 1, k))).alias("words")
    )
    opening: dict[int, list] = {}
    for row in stored.join(F.broadcast(begun), ["lang", "words"]).filter("part <> _part").collect():  # a few rows a partition
        opening.setdefault(row["_part"], []).append((row["lang"], list(row["words"]), row["f"]))
    shared = spark.sparkContext.broadcast({p: (rows[0][0], sorted((w, f) for _, w, f in rows)) for p, rows in opening.items()})

    def run(batches):
        walk, at = _Walk(), None
        for batch in batches:
            for part, lang, words, f in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (part, lang) != at:
                    known, rows = shared.value.get(part, (None, [])) if at is None or at[0] != part else (None, [])
                    walk.enter(lang, rows if known == lang else [])
                    at = (part, lang)
                walk.push(words, f)
            if walk.out:
                yield _streamed(walk.out)
                walk.out = []
        if at is not None:
            walk.close(0)
            yield _streamed(walk.out)

    ordered = stored.select("part", "lang", "words", "f").repartition(parts, "part").sortWithinPartitions("part", "lang", "words")
    return ordered.mapInArrow(run, "lang string, words array<string>, f long, shorter array<long>, extension long")


_STREAMED = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("shorter", pa.list_(pa.int64())), ("extension", pa.int64())])


def _streamed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind.type) for i, kind in enumerate(_STREAMED)], schema=_STREAMED)


def scored_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, words, a, l, r, n, score, longer) of each candidate at its weakest cut; ``longer``: its most frequent extension's count."""
    phrases, totals = frequent_phrases(docs, longest, least)
    left = lockstep(phrases).select("lang", "words", "f", F.col("shorter").alias("lefts"), F.lit(None).cast("array<long>").alias("rights"), "extension")
    backward = lockstep(phrases.withColumn("words", F.reverse("words")))
    right = backward.select("lang", F.reverse("words").alias("words"), F.lit(None).cast("long").alias("f"), F.lit(None).cast("array<long>").alias("lefts"), F.col("shorter").alias("rights"), "extension")
    both = left.unionByName(right).groupBy("lang", "words").agg(
        F.max("f").alias("a"), F.max("lefts").alias("lefts"), F.max("rights").alias("rights"), F.max("extension").alias("longer")
    )
    size = F.size("words")
    both = both.filter(size > 1).join(totals, "lang")
    product = lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(18,0)")

    def cut(k: Column) -> Column:
        l, r = F.element_at("lefts", k), F.element_at("rights", size - k)
        wide = product(F.col("a"), F.col("n")) * F.lit(SCALE).cast("decimal(4,0)")
        return F.struct(F.call_function("div", wide, product(l, r)).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    weakest = F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))
    cuts = both.withColumn("_cut", weakest)
    return cuts.select("lang", "words", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"), "longer")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST_COUNT, top: int = TOP, inside_percent: int = INSIDE_PERCENT
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Pieces end at ``.,;:!?`` and line breaks, words at blanks and tabs; A-Z are lower-cased. A phrase
    counts from ``least`` occurrences on, at any place of a piece, overlaps included. Its score is that of its
    weakest cut in two, 1000 a n / (l r) rounded down. A phrase goes if a longer one that holds it has
    ``inside_percent`` per cent of its count or more; as counts fall with length, the longer ones by one word tell. Ties: the
    smaller k of the cut; then more occurrences, then the phrase by its bytes. A null language is 'und', a null or
    blank text holds nothing, repeated rows count as often as they stand. Other columns are left out.
    """
    chosen = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kept = scored_phrases(chosen, longest, least).filter(F.col("longer") * 100 < F.col("a") * inside_percent)
    kept = kept.withColumn("phrase", F.array_join("words", " "))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = kept.withColumn("_part", part).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
