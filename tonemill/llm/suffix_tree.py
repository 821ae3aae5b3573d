"""Language-model scores by a probabilistic suffix tree over words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import scalars, starts_of, text_slices
from tonemill.runtime import work_table

#: Runs of words that the training texts hold this often are in the tree, whatever the corpus's size.
LEAST_COUNT = 8
#: Longest context, in words.
DEPTH = 3
DISCOUNT = 0.75
#: A task looks the most frequent words and runs up in memory (24 bytes each); all others meet their values in a join.
CACHED = 5 << 19
#: Words and runs rarer than this are met in the join at any size: to hand one to every task costs more than the rows that it saves.
LEAST_CACHED = 8
#: Bits of a key that lead to its place among them, in a table of 16 MB.
PLACE_BITS = 22
#: Bits of the filters of runs that a task holds: fixed, so is their size (8 MB). Where one fills up, more runs are
#: exchanged than need be; counts and scores stay right.
FILTER_BITS = 1 << 26
#: Keys that a counting task remembers so as not to send the same row twice.
SENT = 1 << 19
END = b""

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(values: np.ndarray, bits: int) -> np.ndarray:
    return (values << np.uint64(bits)) | (values >> np.uint64(64 - bits))


def word_hashes(words: pa.Array) -> np.ndarray:
    """XXH64 (seed 0) of each word: those under 32 bytes all at once, eight, four and one byte at a time; others one by one."""
    words = pa.concat_arrays([words.cast(pa.binary())])  # starts at its buffers' start
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)
    begin, sizes = offsets[:-1].astype(np.int64), np.diff(offsets)
    held = words.buffers()[2]
    data = np.r_[np.frombuffer(held, np.uint8, int(offsets[-1])) if held else np.zeros(0, np.uint8), np.zeros(8, np.uint8)]
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    p1, p2, p3, p4, p5 = _PRIMES
    out = p5 + sizes.astype(np.uint64)
    short = sizes < 32
    for step in range(3):
        at = np.flatnonzero(short & (sizes >= 8 * step + 8))
        part = _rotated(eight[begin[at] + 8 * step].view("<u8")[:, 0] * p2, 31) * p1
        out[at] = _rotated(out[at] ^ part, 27) * p1 + p4
    at = np.flatnonzero(short & (sizes & 4 > 0))
    part = eight[begin[at] + (sizes[at] & ~7)].view("<u4")[:, 0].astype(np.uint64) * p1
    out[at] = _rotated(out[at] ^ part, 23) * p2 + p3
    for step in range(3):
        at = np.flatnonzero(short & (sizes & 3 > step))
        out[at] = _rotated(out[at] ^ data[begin[at] + (sizes[at] & ~3) + step].astype(np.uint64) * p5, 11) * p1
    out = (out ^ (out >> np.uint64(33))) * p2
    out = (out ^ (out >> np.uint64(29))) * p3
    out ^= out >> np.uint64(32)
    long = np.flatnonzero(~short)
    out[long] = [xxhash.xxh64_intdigest(words[i].as_buffer()) for i in long.tolist()]
    return out


class _Slice:
    """Texts as words between two end tokens each; runs of words are told apart by 64-bit hashes."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = lists.flatten()
        real = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0  # a blank at a text's end leaves an empty word
        row = pc.list_parent_indices(lists).to_numpy()[real]
        coded = found.dictionary_encode()
        self.distinct = np.r_[word_hashes(coded.dictionary), np.uint64(xxhash.xxh64_intdigest(END))]
        self.sizes = np.bincount(row, minlength=len(texts)) + 2
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.codes = np.full(int(self.sizes.sum()), len(self.distinct) - 1, dtype=np.int32)
        self.codes[np.arange(len(row)) + 2 * row + 1] = coded.indices.to_numpy(zero_copy_only=False)[real]
        self.hashes = self.distinct[self.codes]
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(self.codes)) - self.begin[self.row]

    def longer(self, runs: np.ndarray) -> np.ndarray:
        """From the hashes of the runs that end at each token, those of the runs one word longer."""
        return shifted(runs) * _MULTIPLIER + self.hashes


def shifted(values: np.ndarray) -> np.ndarray:
    """The value of the place before."""
    return np.r_[np.zeros(1, values.dtype), values[:-1]]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys in order, once each, with any place and the number of their places."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = starts_of(keys)
    return keys[starts], order[starts], np.diff(np.r_[starts, len(keys)])


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), dtype=bool)
    for place in (keys & np.uint64(FILTER_BITS - 1), (keys >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)):
        found &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def _filter(keys: DataFrame) -> np.ndarray:
    """The bits that stand for the column key; at most FILTER_BITS / 64 rows come to the driver."""
    low, high = f"key & {FILTER_BITS - 1}", f"shiftrightunsigned(key, 32) & {FILTER_BITS - 1}"
    places = keys.select(F.explode(F.expr(f"array({low}, {high})")).alias("place"))
    places = places.select(F.expr("shiftright(place, 6)").alias("at"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    table = places.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few megabytes of text, so that few words are held as Python values at a time."""
    for batch in batches:
        for low, high in text_slices(batch, name, 2 << 20):
            yield batch.slice(low, high - low)


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def _count_words(train: DataFrame) -> DataFrame:
    """(key, n) of all training words and the end token."""

    def run(batches):
        for batch in _slices(batches, "text"):
            words = _Slice(batch.column("text"))
            n = np.bincount(words.codes[words.place > 0], minlength=len(words.distinct))  # 0 for the empty word
            yield pa.RecordBatch.from_arrays([_signed(words.distinct), pa.array(n.astype(np.int64))], names=["key", "n"])

    return train.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 0")


def _count_runs(train: DataFrame, length: int, known: np.ndarray, last: bool, least: int) -> DataFrame:
    """(length, key, n, context, suffix), or the first three: runs of ``length`` words that stand ``least`` times or more in the training texts.

    ``known`` is the filter of the runs one word shorter. Only keys and counts are exchanged for all candidates; the keys of
    a run's context and suffix follow in the pass of the next length (rows with n = 0), when few runs are left, or at once
    in the ``last`` pass.
    """
    shared = train.sparkSession.sparkContext.broadcast(known)
    narrow = length == 2 and not last

    def run(batches):
        sent = np.zeros(SENT, dtype=np.uint64)  # keys whose context and suffix this task has sent, each at its own place
        for batch in _slices(batches, "text"):
            words = _Slice(batch.column("text"))
            shorter, runs = None, words.hashes
            for _ in range(length - 2):
                shorter, runs = runs, words.longer(runs)
            if shorter is None:
                frequent = in_filter(shared.value, words.distinct)[words.codes]
            else:
                frequent = words.place >= length - 2
                frequent[frequent] = in_filter(shared.value, runs[frequent])
            chosen = np.flatnonzero(frequent & shifted(frequent) & (words.place >= length - 1))
            longer = words.longer(runs)[chosen]
            if last:
                keys, at, n = distinct(longer)
                at = chosen[at]
                out = [(length, keys, n, runs[at - 1], runs[at])]
            else:
                keys, n = np.unique(longer, return_counts=True)
                none = np.zeros(len(keys), dtype=np.uint64)
                out = [(length, keys, n, none, none)]
            if shorter is not None:
                chosen = np.flatnonzero(frequent)
                chosen = chosen[sent[runs[chosen] & np.uint64(SENT - 1)] != runs[chosen]]
                keys, at, _ = distinct(runs[chosen])
                at = chosen[at]
                sent[keys & np.uint64(SENT - 1)] = keys
                out.append((length - 1, keys, np.zeros(len(at)), shorter[at - 1], shorter[at]))
            if narrow:
                yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(n.astype(np.int64))], names=["key", "n"])
                continue
            for size, keys, n, context, suffix in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), size, np.int32)), _signed(keys), pa.array(n.astype(np.int64)), _signed(context), _signed(suffix)],
                    names=["length", "key", "n", "context", "suffix"],
                )

    if narrow:
        sums = train.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        return sums.select(F.lit(length).alias("length"), "key", "n")
    rows = train.mapInArrow(run, "length int, key long, n long, context long, suffix long")
    sums = rows.groupBy("length", "key").agg(F.sum("n").alias("n"), F.max("context").alias("context"), F.max("suffix").alias("suffix"))
    return sums.filter((F.col("length") < length) | (F.col("n") >= least))


def _level(runs: DataFrame, shorter: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The contexts of one length that pass the divergence test, with their smoothed laws, from the ``runs`` that are one
    word longer and the laws of the runs of their own length, ``shorter`` (key, n, logp, open).

    An entry's share, less a discount, stays with it; the rest of the context's mass is dealt by the suffix. A context is
    retained if its suffix is (``open``) and the divergence of its distribution from its suffix's, times its count, pays
    for its entries (half the logarithm of the count each, as in the Bayesian information criterion). Returns the law of
    the runs, the retained (context, log_rest) and the values that runs add to a score, (key, weight, value).
    """
    own = shorter.select(F.col("key").alias("context"), F.col("n").alias("total"), "open")
    below = shorter.select(F.col("key").alias("suffix"), F.col("logp").alias("parent"))
    entries = runs.join(own, "context").join(below, "suffix")
    sums = entries.groupBy("context").agg(F.sum("n").alias("explicit"), F.count("*").alias("entries"))
    entries = entries.join(sums, "context").withColumn("rest", (F.col("total") - F.col("explicit") + DISCOUNT * F.col("entries")) / F.col("total"))
    share = F.greatest(F.col("n") - DISCOUNT, F.lit(1e-9)) / F.col("total")
    entries = work_table(entries.withColumn("explicit_logp", F.log(share + F.col("rest") * F.exp("parent"))), name)
    log_rest = F.log(F.greatest("rest", F.lit(1e-300)))
    tested = entries.groupBy("context", "total", "open", "explicit", "entries", "rest").agg(F.sum(F.col("n") * (F.col("explicit_logp") - F.col("parent"))).alias("gain"))
    gain = F.col("gain") + F.greatest(F.col("total") - F.col("explicit"), F.lit(0)) * log_rest
    pays = gain > 0.5 * F.col("entries") * F.log(F.greatest("total", F.lit(2)).cast("double"))
    retained = work_table(tested.filter(F.col("open") & pays).select("context", "total", log_rest.alias("log_rest")), f"{name}-contexts")
    contexts = retained.select("context", "log_rest")
    law = entries.join(contexts, "context", "left").join(retained.select(F.col("context").alias("suffix"), F.lit(True).alias("suffix_in")), "suffix", "left")
    kept = F.col("log_rest").isNotNull()
    law = work_table(
        law.select(
            "key", "n", F.when(kept, F.col("explicit_logp")).otherwise(F.col("parent")).alias("logp"), F.coalesce("suffix_in", F.lit(False)).alias("open"),
            F.when(kept, F.col("explicit_logp") - F.col("parent") - F.col("log_rest")).alias("value"),
        ),
        f"{name}-law",
    )
    values = retained.select(F.col("context").alias("key"), F.col("total").alias("weight"), F.col("log_rest").alias("value"))
    return law, contexts, values.unionByName(law.filter(F.col("value").isNotNull()).select("key", F.col("n").alias("weight"), "value"))


def grow(train: DataFrame, depth: int = DEPTH, least: int = LEAST_COUNT) -> tuple[DataFrame, dict, list[tuple[DataFrame, DataFrame]]]:
    """The tree of ``train``'s column text: its values, the corpus's ``tokens`` and ``types``, and (law, contexts) by length.

    Candidate contexts are runs of up to ``depth`` words; they and their next words enter from ``least`` occurrences on, so
    the tree grows with the corpus. Counts, divergence tests and laws are tables keyed by run; no task or driver holds a level.

    A text's log probability is a sum over its runs: a retained context adds the log share that it leaves to its suffix, and
    an entry what its own law gives beyond that. The table of values (key, count, value, weight, longer) holds these sums
    for runs (``longer``) and words, and the words' counts.
    """
    words = work_table(_count_words(train), "words")
    sums = scalars(words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")))
    base = F.log((F.col("n") + 0.5) / (sums["tokens"] + 0.5 * (sums["types"] + 1)))
    law = words.filter(F.col("n") >= least).select("key", "n", base.alias("logp"), F.lit(True).alias("open"))
    keys = law.select("key")
    counted = {}
    for length in range(2, depth + 2):
        found = work_table(_count_runs(train, length, _filter(keys), length == depth + 1, least), f"runs-{length}")
        counted[length] = found
        keys = found.filter(F.col("length") == length).select("key")
    levels, values = [], words.select("key", F.col("n").alias("count"), F.lit(0.0).alias("value"), F.col("n").alias("weight"), F.lit(False).alias("longer"))
    for length in range(2, depth + 2):
        own = counted[length].filter(F.col("length") == length)
        if length <= depth:
            parts = counted[length + 1].filter(F.col("length") == length).select("key", "context", "suffix")
            own = own.select("key", "n").join(parts, "key")
        law, contexts, added = _level(own.select("key", "n", "context", "suffix"), law, f"level-{length - 1}")
        levels.append((law, contexts))
        values = values.unionByName(added.select("key", F.lit(0).cast("long").alias("count"), "value", "weight", F.lit(True).alias("longer")))
    values = values.groupBy("key").agg(
        F.sum("count").alias("count"), F.sum("value").alias("value"), F.max("weight").alias("weight"), F.every("longer").alias("longer")
    )
    return work_table(values, "tree"), sums, levels


def _least_cached(values: DataFrame, most: int) -> int:
    """The smallest of a row of weights, each a sixteenth of an octave above the last, that at most ``most`` rows reach;
    LEAST_CACHED at least."""
    sizes = values.filter(F.col("weight") >= LEAST_CACHED).groupBy(F.floor(16 * F.log2("weight")).cast("int").alias("size")).count().collect()  # 992 rows at most
    held, least = 0, 992
    for size, rows in sorted(sizes, reverse=True):
        held += rows
        if held > most:
            break
        least = size
    return math.ceil(2 ** (least / 16) - 1e-9)


def _table(key: np.ndarray, count: np.ndarray, value: np.ndarray) -> tuple:
    """Entries in order of their keys, an empty entry at the end, and where the keys begin that share their first PLACE_BITS."""
    key = key.view(np.uint64)
    order = np.argsort(key)
    keys = key[order]
    starts = np.empty(1 << PLACE_BITS, dtype=np.int32)
    for low in range(0, len(starts), 1 << 16):  # in parts, to hold little on the driver
        first = np.arange(low, min(low + (1 << 16), len(starts)), dtype=np.uint64) << np.uint64(64 - PLACE_BITS)
        starts[low : low + len(first)] = np.searchsorted(keys, first)
    return np.r_[keys, np.uint64(2**64 - 1)], np.r_[count[order], 0], np.r_[value[order], 0.0], starts


def _look_up(keys: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are held, or the place of the empty last entry, whose value is 0."""
    at = starts[wanted >> np.uint64(64 - PLACE_BITS)]
    lower = np.flatnonzero(keys[at] < wanted)
    while len(lower):
        at[lower] += 1
        lower = lower[keys[at[lower]] < wanted[lower]]
    missing = (keys[at] != wanted) | (at == len(keys) - 1)
    at[missing] = len(keys) - 1
    return at, missing


def scored(docs: DataFrame, values: DataFrame, sums: dict, carried: list[str], text_col: str = "text", depth: int = DEPTH, cached: int = CACHED) -> DataFrame:
    """The ``carried`` columns of each row with n_tokens, n_known, base_score and score (log10 of the whole text).

    A task adds up the values of the words and runs that it holds, ``cached`` at most, and takes other words as unseen. These, and
    the runs that the filter of the other values lets through, meet all values in a join, which brings back what is in the tree. A run's value can only be there if its suffix's
    is, so longer runs are looked for behind known ones alone. A null text is an empty one: the end token alone.
    """
    from_weight = _least_cached(values, cached)
    held = values.filter(F.col("weight") >= from_weight).select("key", "count", "value").toArrow()
    table = _table(*[held.column(c).to_numpy() for c in ("key", "count", "value")])
    rest = _filter(values.filter((F.col("weight") < from_weight) & F.col("longer")).select("key"))
    shared = docs.sparkSession.sparkContext.broadcast((table, rest))
    log_all = float(np.log(sums["tokens"] + 0.5 * (sums["types"] + 1)))
    names = [f"_carried_{i}" for i in range(len(carried))]
    chosen = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))

    def run(batches):
        (keys, counts, values, starts), rest = shared.value
        task, number = TaskContext.get().partitionId(), 0
        for batch in _slices(batches, "_text"):
            words = _Slice(batch.column("_text"))
            texts = len(words.sizes)
            if not texts:
                continue
            at, absent = _look_up(keys, starts, words.distinct)
            token = words.place > 0
            plain = (np.log(counts[at] + 0.5) - log_all)[words.codes] * token  # an unheld word counts as unseen until it meets its count
            known = token & (counts[at] > 0)[words.codes]
            log = values[at][words.codes] * (words.place < words.sizes[words.row] - 1)
            missing = np.flatnonzero(token & absent[words.codes])
            open_rows, open_keys, open_words = [words.row[missing]], [words.hashes[missing]], [np.ones(len(missing), dtype=bool)]
            runs, alive = words.hashes, np.ones(len(words.place), dtype=bool)
            for length in range(2, depth + 2):
                runs = words.longer(runs)
                places = np.flatnonzero(alive & (words.place >= length - 1))
                own = runs[places]
                at, absent = _look_up(keys, starts, own)
                log[places] += values[at]
                absent = np.flatnonzero(absent)
                other = in_filter(rest, own[absent])
                found = places[absent[other]]
                open_rows.append(words.row[found])
                open_keys.append(runs[found])
                open_words.append(np.zeros(len(found), dtype=bool))
                alive = np.zeros(len(words.place), dtype=bool)
                alive[places] = True
                alive[places[absent[~other]]] = False
            row, key, word = np.concatenate(open_rows), np.concatenate(open_keys), np.concatenate(open_words)
            order = np.lexsort((key, row))
            row, key, word = row[order], key[order], word[order]
            first = starts_of(row, key)
            times = np.diff(np.r_[first, len(row)])
            rows = (np.int64(task) << 33) + number + np.arange(texts)
            number += texts
            index = np.r_[np.arange(texts), row[first]]
            own = pa.array(index, mask=np.arange(len(index)) >= texts)  # carried columns go with the text's own row alone
            none = np.zeros(len(first))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[index]), *[batch.column(n).take(own) for n in names], _signed(np.r_[rows.view(np.uint64), key[first]]),
                    pa.array(np.r_[np.zeros(texts, np.int64), times]), pa.array(np.r_[np.zeros(texts, bool), word[first]]),
                    *[pa.array(np.r_[s, none].astype(np.int64)) for s in (words.sizes - 1, np.add.reduceat(known.astype(np.int64), words.begin))],
                    *[pa.array(np.r_[np.add.reduceat(s, words.begin), none]) for s in (plain, log)],
                ],
                names=["row", *names, "key", "times", "word", "n_tokens", "n_known", "base", "log"],
            )

    kinds = ", ".join(f"{n} {chosen.schema[n].dataType.simpleString()}" for n in names)
    parts = chosen.mapInArrow(run, f"row long, {kinds}, key long, times long, word boolean, n_tokens long, n_known long, base double, log double")
    found = values.select("key", "count", "value", F.lit(True).alias("found"))
    met = parts.join(found, "key", "left").filter("found or times = 0")  # what is not in the tree adds nothing
    seen = F.col("word") & F.coalesce(F.col("count") > 0, F.lit(False))
    plain = F.when(seen, F.col("times") * (F.log(F.col("count") + 0.5) - math.log(0.5))).otherwise(0.0)
    met = met.select(
        "row", *names, "n_tokens", (F.col("n_known") + F.when(seen, F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base") + plain).alias("base"), (F.col("log") + F.col("times") * F.coalesce("value", F.lit(0.0))).alias("more"),
    )
    ten = float(np.log(10))
    sums_by_row = met.groupBy("row").agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in names], F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        (F.sum("base") / ten).alias("base_score"), ((F.sum("base") + F.sum("more")) / ten).alias("score"),
    )
    return sums_by_row.select(*[F.col(n).alias(c) for n, c in zip(names, carried)], "n_tokens", "n_known", "base_score", "score")


def score_texts(train: DataFrame, docs: DataFrame, carried: list[str], text_col: str = "text", depth: int = DEPTH, least: int = LEAST_COUNT) -> DataFrame:
    """Scores of ``docs`` by the tree of ``train``; see ``grow`` and ``scored``. train_tokens is added.

    Words are what stands between ASCII blanks, A-Z lower-cased; each text ends with one end token. Words and
    runs are told apart by 64-bit hashes. The base law gives a word (c + 0.5) / (N + 0.5 (V + 1)); the tree's laws sum to one
    over the training words and one unknown word. Repeated rows count and are scored as often as they occur. Without
    training rows all words are unknown. Carried columns may have any names but those of the scores.
    """
    values, sums, _ = grow(train.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")), depth, least)
    return scored(docs, values, sums, carried, text_col, depth).withColumn("train_tokens", F.lit(sums["tokens"]).cast("long"))
