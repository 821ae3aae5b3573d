"""Greedy string tiling and contaminated documents against brute force."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tonemill.llm import decontamination as d


def plain_tiles(item, doc, least):
    """Greedy string tiling by looking for the longest free common run again and again."""
    least = max(1, min(least, len(item)))
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_i[i + n] and free_d[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least or not n:
            return tiles
        for k in range(n):
            free_i[i + k] = free_d[j + k] = False
        tiles.append((i, j, n))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=24), st.integers(1, 4))
def test_tiles_are_greedy(item, doc, least):
    a, b = (np.array(x, dtype=np.uint64) for x in (item, doc))
    got = d.tile(a, b, least)
    lengths = sorted((n for _, _, n in got), reverse=True)
    assert all(item[i : i + n] == doc[j : j + n] for i, j, n in got)
    assert len({i + k for i, _, n in got for k in range(n)}) == sum(lengths) == len({j + k for _, j, n in got for k in range(n)})
    want = sorted((n for _, _, n in plain_tiles(item, doc, least)), reverse=True)
    assert lengths[:1] == want[:1]
    # nothing of the least length is left untiled on both sides
    left_i, left_d = set(range(len(item))) - {i + k for i, _, n in got for k in range(n)}, set(range(len(doc))) - {j + k for _, j, n in got for k in range(n)}
    least = max(1, min(least, len(item)))
    assert not any(
        all(i + k in left_i and j + k in left_d and item[i + k] == doc[j + k] for k in range(least))
        for i in range(len(item) - least + 1) for j in range(len(doc) - least + 1)
    ) or not item


DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string"


def test_passages_are_found_in_any_order(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(rng.randint(14, 60))) for k in range(12)] + [(50, "Only Three words"), (51, ""), (52, None), (53, "!!!")]
    docs, want = [], set()
    for i in range(150):
        text = prose(rng.randint(0, 300))
        if i % 5 == 0:
            k, passage = items[i // 5 % 12]
            own = passage.split()
            if i % 10 == 0:  # halves change places
                own = own[len(own) // 2 :] + own[: len(own) // 2]
            text = f"{text}. {' '.join(own).upper()}, {prose(20)}"
            want.add((i, k))
        if i % 5 == 1:  # a third of an item is not enough
            own = items[i % 12][1].split()
            text += " " + " ".join(own[: max(5, len(own) // 3)])
        docs.append((i, text, "x"))
    docs += [(500, None, None), (501, "", None), (None, f"so {items[0][1]} there", None), (502, "and only, THREE words!", None)] + [docs[0]] * 2
    want |= {(None, 0), (502, 50)}
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = d.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert sum(r.doc_id == 0 for r in got) == 3 and all(r.coverage >= d.COVERAGE for r in got)
    clean = d.decontaminate(df, bench)
    assert clean.columns == ["doc_id", "text", "item_id"]
    bad = {i for i, _ in want}
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(i) for i, _, _ in docs if i not in bad)


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d e f g")], ITEMS)
    assert d.contaminated(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g", None)], DOCS)
    assert d.contaminated(docs, spark.createDataFrame([], ITEMS)).count() == 0 and d.decontaminate(docs, spark.createDataFrame([], ITEMS)).count() == 1
    assert d.contaminated(docs, items).count() == 1


def test_items_are_told_apart_by_text(spark):
    """Equal ids with different texts, repeated items and null ids: every text is tried."""
    short, long = "alpha beta gamma delta epsilon zeta", " ".join(f"w{i}" for i in range(200))
    items = spark.createDataFrame([(1, short), (1, long), (1, short), (None, "one two three four five six seven"), (None, None), (2, short)], ITEMS)
    docs = [(1, f"so {short} and w0 w1 w2 w3 w4 w5 too", "x"), (2, "here one two three four five six seven there", None), (3, long, None), (4, "none of them", None)]
    got = d.contaminated(spark.createDataFrame(docs, DOCS), items).collect()
    assert sorted((r.doc_id, r.item_id or 0, r.covered, r.length) for r in got) == [(1, 1, 6, 6), (1, 2, 6, 6), (2, 0, 7, 7), (3, 1, 200, 200)]
    assert [r.doc_id for r in d.decontaminate(spark.createDataFrame(docs, DOCS), items).collect()] == [4]
