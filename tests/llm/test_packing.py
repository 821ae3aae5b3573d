"""Bounds, packings and token pieces."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tonemill.llm import packing
from tonemill.llm.bins import best_fit_decreasing
from tonemill.llm.queries import tokenizer_definition

SCHEMA = "doc_id long, text string, length string"
ODD = ["", " ", "It's HE'LL don't ", "a.b... c,, .,., x5 12.5%", "École STRASSE ß İstanbul Σίσυφος ΑΣ", "é ﬁ ŉ ͅ  x\x85y\x1cz", "<|endoftext|> a<|startoftext|>b", "日本語 テキスト", "\t\r\n  tab"]


def fewest(sizes, capacity):
    """The least number of bins, by trying all sets of sizes for the first bin."""
    if not sizes:
        return 0
    first, rest, best = sizes[0], sizes[1:], len(sizes)
    for n in range(len(rest) + 1):
        for more in combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in more) <= capacity:
                best = min(best, 1 + fewest([s for i, s in enumerate(rest) if i not in more], capacity))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=6), st.just(12) | st.integers(12, 20))
def test_bound_lies_below_the_optimum_and_the_packing_above(sizes, capacity):
    optimum = fewest(sizes, capacity)
    assert -(-sum(sizes) // capacity) <= packing.bin_bound(np.array(sizes), capacity) <= optimum
    assert not sizes or len(set(best_fit_decreasing(np.array(sizes), capacity).tolist())) >= optimum


def test_bound_sees_more_than_the_sum():
    assert packing.bin_bound(np.array([7, 7, 7, 2]), 12) == 3  # two sevens don't share a bin
    assert packing.bin_bound(np.full(9, 5), 12) == 5


def test_pieces_of_words_are_those_of_the_text():
    definition = tokenizer_definition()
    apart, whole = packing._Encoder(definition, True), packing._Encoder(definition, False)
    for text in ODD:
        assert apart(text) == whole(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aÉßé.,' \nsİ5", max_size=40))
def test_any_text_in_pieces(text):
    text = text.encode("utf-8", "ignore").decode()
    definition = _DEFINITION
    assert packing._encoder(definition, True)(text) == packing._encoder(definition, False)(text)


_DEFINITION = tokenizer_definition()


def check(rows, got, capacity, known):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(places[-1]) <= capacity
    copies = defaultdict(int)
    for i, _, _ in rows:
        copies[i] += 1
    assert by_doc.keys() == copies.keys()
    tokenizer = Tokenizer.from_str(_DEFINITION)
    for i, text, _ in rows:
        if copies[i] == 1:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
            pieces = sorted(by_doc[i], key=lambda r: r.piece)
            assert [(r.piece, r.start, r.length) for r in pieces] == [(k, a, min(capacity, len(ids) - a)) for k, a in enumerate(range(0, len(ids), capacity))]
            assert [r.ids_crc32 for r in pieces] == [zlib.crc32(ids[a : a + capacity].tobytes()) for a in range(0, len(ids), capacity)]
    sizes = np.array([r.length for r in got])
    assert len(bins) <= packing.bin_bound(sizes, capacity) + known
    return bins


def test_documents_are_packed_close_to_the_bound(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "Émile,", "x", "running."]) for _ in range(rng.choice((3, 30, 90, 700)))), "x") for i in range(500)]
    rows += [(900 + k, text, None) for k, text in enumerate(ODD)] + [(1000, None, None), (1001, "dup", None), (1001, "dup", None), (None, "no id", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack_documents(docs, _DEFINITION, 256, words_apart=True).collect()
    check(rows, got, 256, 1)
    monkeypatch.setattr(packing.pack_lengths, "__defaults__", (60, packing.ROUNDS))  # many parts that exchange documents
    check(rows, packing.pack_documents(docs, _DEFINITION, 256, words_apart=True).collect(), 256, 3)


def test_sequences_hold_the_ids(spark):
    rows = [(i, f"text number {i} " * (i % 60), "x") for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    placed = packing.pack_documents(docs, _DEFINITION, 64, words_apart=True)
    whole = {r.sequence_id: list(r.ids) for r in packing.sequences(spark, docs, placed, _DEFINITION, capacity=64, words_apart=True).collect()}
    tokenizer = Tokenizer.from_str(_DEFINITION)
    texts = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t, _ in rows}
    for r in placed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == texts[r.doc_id][r.start : r.start + r.length]
    assert sum(map(len, whole.values())) == sum(map(len, texts.values()))


def test_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), _DEFINITION).count() == 0
