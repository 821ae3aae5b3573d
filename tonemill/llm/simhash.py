"""SimHash fingerprints and their near-duplicate groups, found through a Gray-order hierarchical index."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import sliced, spaced_words, starts_of, utf8, whole_runs
from tonemill.llm.components import components
from tonemill.runtime import work_table

SHINGLE = 4
MAX_BITS = 4
#: Fingerprints below one upper node that a task compares at once; larger nodes are cut into such tiles.
TILE = 2048
#: Children of an inner node.
FAN = 8
#: Pairs of nodes looked at together.
CHUNK = 1 << 18

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if more than half of the shingles' hashes (XXH64, seed 42) have it; no word: zero."""
    words = spaced_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size).tolist()
    end = end.tolist()
    n = max(1, len(words) - shingle + 1)
    spans = zip(begin[:n], end[min(shingle, len(words)) - 1 :])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    places = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
    bits = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * bits.ravel() > n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, digest, fp): the md5 of the text ('' for null) and the fingerprint as a signed long."""

    def run(batches):
        for batch in sliced(batches, "text"):
            codes = np.array([fingerprint(t, shingle) for t in utf8(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.view(np.int64))], names=["id", "digest", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "id long, digest string, fp long")


def _shared_masks(max_bits: int) -> list[int]:
    """Masks of two blocks of bits out of ``max_bits`` + 2: any two codes within ``max_bits`` agree on one of them."""
    edges = np.linspace(0, 64, max_bits + 3).astype(int)
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _gray_rank(code):
    """The rank of a code in Gray order: each bit becomes the parity of itself and the bits above."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _tree(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (mask, pattern), leaves first: the bits that all codes below a node share."""
    masks, patterns = np.full(len(codes), ~np.uint64(0)), codes
    levels = [(masks, patterns)]
    while len(patterns) > 1:
        at = np.arange(0, len(patterns), FAN)
        all_masks = np.bitwise_and.reduceat(masks, at)
        low, high = np.bitwise_and.reduceat(patterns, at), np.bitwise_or.reduceat(patterns, at)
        masks = all_masks & ~(low ^ high)
        patterns = low & masks
        levels.append((masks, patterns))
    return levels


def _linked(codes: np.ndarray, others: np.ndarray | None, max_bits: int):
    """Arrays (i, j) of pairs within ``max_bits``, from two trees whose codes are in Gray order.

    Pairs of nodes are followed from the roots. The bits on which both nodes' patterns
    are fixed and differ are differences of all pairs below: with more than
    ``max_bits`` of them the two groups are left as a whole.
    """
    one = _tree(codes)
    two = one if others is None else _tree(others)
    depth = max(len(one), len(two))
    one, two = ([*t, *[t[-1]] * (depth - len(t))] for t in (one, two))
    stack = [(depth - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        level, i, j = stack.pop()
        (m1, p1), (m2, p2) = one[level], two[level]
        near = np.bitwise_count((p1[i] ^ p2[j]) & m1[i] & m2[j]) <= max_bits
        i, j = i[near], j[near]
        if not len(i):
            continue
        if not level:
            apart = i < j if others is None else np.ones(len(i), dtype=bool)
            yield i[apart], j[apart]
            continue

        def children(nodes, levels):
            if len(levels[level - 1][0]) == len(levels[level][0]):
                return nodes[:, None]
            return nodes[:, None] * FAN + np.arange(FAN)

        a, b = children(i, one), children(j, two)
        shape = (len(i), a.shape[1], b.shape[1])
        a, b = np.broadcast_to(a[:, :, None], shape).ravel(), np.broadcast_to(b[:, None, :], shape).ravel()
        inside = (a < len(one[level - 1][0])) & (b < len(two[level - 1][0]))
        if others is None:
            inside &= a <= b
        a, b = a[inside], b[inside]
        stack.extend((level - 1, a[k : k + CHUNK], b[k : k + CHUNK]) for k in range(0, len(a), CHUNK))


def _forest(codes: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each code and the first one it hangs together with."""
    label = np.arange(len(codes))
    for i, j in pairs:
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (label == before).all() and (label[i] == label[j]).all():
                break
    tied = np.flatnonzero(label != np.arange(len(codes)))
    return codes[tied], codes[label[tied]]


def fingerprint_links(codes: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """(a, b) links of the distinct longs ``fp`` whose components are those of all pairs within ``max_bits``.

    The upper nodes of the index are shared masked patterns: two of ``max_bits`` + 2 blocks of
    bits. By the pigeonhole principle each pair in question lies below one of them, so
    nodes are compared within, never with each other. Below an upper node the codes stand in
    Gray order, in which neighbours share long patterns, and inner nodes are built over
    them. A node of more than ``tile`` codes is cut into tiles by a hash, and each pair of tiles
    is a piece of work by itself, so that one large group of near copies spreads over
    tasks. All pairs are examined; of a dense group only a spanning forest is returned.
    """
    masks = [_signed(m) for m in _shared_masks(max_bits)]
    nodes = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("pattern")) for k, m in enumerate(masks)]))
    below = codes.select("fp", _gray_rank(F.col("fp")).alias("rank")).select("fp", "rank", nodes.alias("node")).select("fp", "rank", "node.*")
    sizes = below.groupBy("mask", "pattern").count().filter(F.col("count") > 1)
    tiles = F.ceil(F.col("count") / tile).cast("long")
    dealt = below.join(sizes, ["mask", "pattern"]).select("mask", "pattern", "fp", "rank", tiles.alias("tiles"), F.pmod(F.xxhash64("fp"), tiles).alias("own"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")).select(
        "mask", "pattern", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rank", "fp"
    )
    keys = ["mask", "pattern", "low", "high"]

    def run(batches):
        for table in whole_runs(batches, keys):
            column = {k: table.column(k).to_numpy() for k in [*keys, "side", "fp"]}
            code = column["fp"].view(np.uint64)
            first = starts_of(*[column[k] for k in keys])
            size = np.diff(np.r_[first, len(code)])
            found_a, found_b = [], []
            pairs = first[size == 2]
            pairs = pairs[np.bitwise_count(code[pairs] ^ code[pairs + 1]) <= max_bits]
            found_a.append(code[pairs])
            found_b.append(code[pairs + 1])
            for at, n in zip(first[size > 2], size[size > 2]):
                own = code[at : at + n]
                if column["low"][at] == column["high"][at]:
                    a, b = _forest(own, _linked(own, None, max_bits))
                else:
                    left = int((column["side"][at : at + n] == 0).sum())
                    if not 0 < left < n:
                        continue
                    a, b = _forest(own, ((i, j + left) for i, j in _linked(own[:left], own[left:], max_bits)))
                found_a.append(a)
                found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (found_a, found_b)], names=["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "side", "rank").mapInArrow(run, "a long, b long")


def grouped_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """(id, digest, fp, root): the root is a fingerprint of the row's group, the same for the whole group."""
    rows = work_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    links = fingerprint_links(rows.select("fp").distinct(), max_bits)
    roots = components(links, "fingerprint-links")
    return rows.join(roots, rows["fp"] == roots["node"], "left").select("id", "digest", "fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row a document: its id, fingerprint (16 hex digits) and component_id.

    Documents link at ``max_bits`` differing bits or fewer, and component_id is the smallest id that
    links reach. A null or blank text has fingerprint zero and links like any other. Equal
    fingerprints are compared once; repeated rows and ids each keep their row, and a null id
    is never a component_id unless its whole group has none. Other columns are left out.
    """
    rows = work_table(grouped_fingerprints(docs, id_col, text_col, shingle, max_bits), "fingerprint-groups")
    least = rows.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(least, "root").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``docs`` less all but one of each group: the smallest id stays, then the smallest md5."""
    rows = work_table(grouped_fingerprints(docs, id_col, text_col, shingle, max_bits), "fingerprint-groups")
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("chosen"))
    chosen = chosen.select(F.col("chosen.id").alias("_chosen_id"), F.col("chosen.digest").alias("_chosen_digest"))
    marked = docs.withColumns({"_chosen_key": F.col(id_col).cast("long"), "_digest": F.md5(F.coalesce(text_col, F.lit("")))})
    same = F.col("_chosen_key").eqNullSafe(F.col("_chosen_id")) & (F.col("_digest") == F.col("_chosen_digest"))
    return marked.join(chosen, same, "left_semi").dropDuplicates(["_chosen_key", "_digest"]).drop("_chosen_key", "_digest")
