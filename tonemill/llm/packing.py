"""Packing of documents into sequences of fixed length, with certified numbers of bins."""

from __future__ import annotations

import zlib
from functools import reduce
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm.bins import best_fit_decreasing
from tonemill.llm.common import sliced
from tonemill.runtime import work_table

PER_PART = 50_000
ROUNDS = 8
#: Bins of a round and of a partition get numbers of their own: 2 * ((round * 2**32 + partition) * 2**18 + bin) + 1.
BIN_BITS, PART_BITS = 18, 32
CACHED_WORDS = 400_000

_WORKER: dict = {}


class _Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; one in each Python worker.

    With ``words_apart`` the tokenizer is known to treat a text between blanks and
    line feeds by itself, letters apart from points and commas, and to lower its case,
    so that ids of a text are those of its pieces, of which the frequent ones are
    kept. Pieces of Latin letters go to the model directly, in its byte alphabet.
    """

    def __init__(self, definition: str, words_apart: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.words_apart, self.known, self.letters = words_apart, {}, {}
        self.alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def piece(self, text: str) -> bytes:
        word = text.rstrip(".,")
        if word != text and word[-1:].lower().isalpha() and word[-1] < "\u0250":
            return self.kept(word) + self.kept(text[len(word) :])
        lower = text.lower()
        if text.isalpha() and (text.isascii() or max(text) < "\u0250" and lower.isalpha() and is_normalized("NFC", text)):
            ids = [t.id for t in self.tokenizer.model.tokenize(lower if text.isascii() else "".join(map(self.letter, lower)))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def letter(self, letter: str) -> str:
        if letter not in self.letters:
            self.letters[letter] = self.alphabet.pre_tokenize_str(letter)[0][0]
        return self.letters[letter]

    def kept(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.piece(word)
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            if len(word) <= 40:
                self.known[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.words_apart:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        out, known = [], self.known
        for word in text.replace("\n", " ").split(" "):
            ids = known.get(word)
            out.append(self.kept(word) if ids is None else ids)
        return b"".join(out)


def _encoder(definition: str, words_apart: bool) -> _Encoder:
    key = (zlib.crc32(definition.encode()), len(definition), words_apart)
    if key not in _WORKER:
        _WORKER[key] = _Encoder(definition, words_apart)
    return _WORKER[key]


def token_pieces(
    docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, words_apart: bool = False, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut every ``capacity`` ids."""

    def run(batches):
        encode, end = _encoder(shared.value, words_apart), np.array([end_id], dtype="<u4").tobytes()
        for batch in sliced(batches, 1):
            out: dict[str, list] = {name: [] for name in schema.names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    shared = docs.sparkSession.sparkContext.broadcast(definition)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, kinds)


def bin_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible functions.

    A dual-feasible function maps sizes so that what fits a bin still does; the mapped
    sizes then need as many bins as their sum fills. The first family drops sizes under
    a limit and rounds sizes over capacity less limit up to a whole bin (limit 0: the
    plain sum); the second one rounds to multiples of capacity / k.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return 0
    number = np.bincount(sizes, minlength=capacity + 1)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    total, count = np.cumsum(number * x), np.cumsum(number)
    for limit in range(capacity // 2 + 1):
        low = total[limit - 1] if limit else 0
        whole = count[capacity] - count[capacity - limit]
        best = max(best, -(-int(whole * capacity + total[capacity - limit] - low) // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * x
        rounded = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, -(-int((number * rounded).sum()) // (k * capacity)))
    return best


def _pack_round(items: DataFrame, number: int, parts: int, capacity: int) -> DataFrame:
    """(key, length, sequence_id, offset, fill, gap, least) with each part packed by itself.

    ``gap``: bins of the part above its certified bound; ``least``: the bin is its part's emptiest.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True], kind="stable")
        sizes = pdf["length"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, np.diff(bins[order]) != 0]
        offset = np.empty(len(sizes), dtype=np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        part = int(pdf["part"].iloc[0])
        sequence = 2 * ((np.int64(number) << PART_BITS | part) << BIN_BITS | bins) + 1
        return pd.DataFrame(
            {
                "key": pdf["key"], "length": sizes, "sequence_id": sequence, "offset": offset, "fill": fill[bins],
                "gap": len(fill) - bin_bound(sizes, capacity), "least": bins == int(np.argmin(fill)),
            }
        )

    part = F.pmod(F.xxhash64("key", F.lit(number)), F.lit(parts)).cast("long")
    kinds = "key long, length long, sequence_id long, offset long, fill long, gap long, least boolean"
    return items.select("key", "length", part.alias("part")).groupBy("part").applyInPandas(pack, kinds)


def pack_lengths(items: DataFrame, capacity: int, per_part: int = PER_PART, rounds: int = ROUNDS) -> DataFrame:
    """(key, sequence_id, offset) of (key long, length), into few sequences of ``capacity``.

    Each part is packed best-fit-decreasing, and a dual-feasible bound certifies its
    number of bins. Where it has more, all its bins that aren't full are opened again,
    elsewhere only its emptiest one: what they hold meets in fewer, newly dealt parts and
    is packed again, until one part is left that meets its bound, or ``rounds`` are over.
    Lengths are 1 to ``capacity``; keys differ.
    """
    n, done = items.count(), []
    for number in range(rounds):
        parts = max(1, -(-n // per_part))
        packed = work_table(_pack_round(items, number, parts, capacity), "packed")
        again = (F.col("fill") < capacity) & ((F.col("gap") > 0) | F.col("least"))
        open_ = packed.filter(again)
        left = open_.count() if parts > 1 else 0
        if not left or number == rounds - 1:
            done.append(packed)
            break
        done.append(packed.filter(~again))
        items, n = open_.select("key", "length"), left
    return reduce(DataFrame.union, [d.select("key", "sequence_id", "offset") for d in done])


def pack_documents(
    docs: DataFrame, definition: str, capacity: int = 2048, end_id: int = 0, words_apart: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    ``definition`` is the text of a tokenizer file. A document's ids end with ``end_id``; a
    null or empty text is that id alone. Only documents longer than ``capacity`` are cut,
    and their full pieces are sequences by themselves. ``words_apart``: see _Encoder;
    true of tokenizers that drop white space, and the fast way for them. Repeated
    rows are packed as often as they occur, an empty table gives no rows, and other
    columns are left out.
    """
    pieces = token_pieces(docs, definition, id_col, text_col, capacity, end_id, words_apart)
    pieces = work_table(pieces.withColumn("key", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": 2 * F.col("key"), "offset": F.lit(0).cast("long")})
    rest = pieces.filter(F.col("length") < capacity)
    placed = rest.join(pack_lengths(rest.select("key", "length"), capacity), "key")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(columns).union(placed.select(columns))


def sequences(spark: SparkSession, docs: DataFrame, placed: DataFrame, definition: str, **options) -> DataFrame:
    """(sequence_id, ids): the packed ids themselves; doc_id has to be unique here."""
    ids = token_pieces(docs, definition, with_ids=True, **options).select("doc_id", "piece", "ids")
    parts = placed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
