"""Fingerprints, links and groups against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tonemill.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes, bits):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= bits:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in root}


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB é\t\n\x0b\x1c\x85\u00a0xyZ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.integers(0, 40), st.randoms(), st.integers(0, 6))
def test_tree_finds_all_pairs(centres, more, rng, bits):
    codes = set(centres)
    for _ in range(more):
        code = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            code ^= 1 << rng.randrange(64)
        codes.add(code)
    ordered = np.array(sorted(codes, key=gray), dtype=np.uint64)
    got = {(int(i), int(j)) for a, b in simhash._linked(ordered, None, bits) for i, j in zip(a, b)}
    assert got == {(i, j) for i, j in combinations(range(len(ordered)), 2) if (int(ordered[i]) ^ int(ordered[j])).bit_count() <= bits}


def gray(code):
    for shift in (1, 2, 4, 8, 16, 32):
        code ^= code >> shift
    return code


def near(rng, code, most):
    for _ in range(rng.randint(0, most)):
        code ^= 1 << rng.randrange(64)
    return code


def test_groups_of_codes_with_hot_nodes(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(300)]
    codes = {near(rng, rng.choice(centres[:40]), 6) for _ in range(500)} | set(centres) | {near(rng, centres[0], 3) for _ in range(400)} | {0, 2**64 - 1, 2**63}
    signed = [(c - 2**64 if c >> 63 else c,) for c in codes]
    want = plain_groups(codes, 4)
    for tile in (simhash.TILE, 32):
        links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), 4, tile).collect()
        root = {c: c for c in codes}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        for r in links:
            a, b = r.a % 2**64, r.b % 2**64
            root[max(find(a), find(b))] = min(find(a), find(b))
        assert {c: find(c) for c in codes} == {c: find(want[c]) for c in codes}
        assert len({find(c) for c in codes}) == len(set(want.values()))


SCHEMA = "doc_id long, text string, component_id string"


def texts(rng):
    words = [f"w{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 200))] for _ in range(30)]
    rows = []
    for i in range(200):
        own = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 40))):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((1000 - i, " ".join(own), "x"))
    return rows + [(3, "", None), (7, None, None), (2, " \t", None), (7, "two words", None), (7, "two words", None), (None, "two words", None)]


def test_documents_match_brute_force(spark):
    rows = texts(random.Random(2))
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    groups = plain_groups({plain_fingerprint(t) for _, t, _ in rows}, 4)
    least = {}
    for i, t, _ in rows:
        root = groups[plain_fingerprint(t)]
        if i is not None:
            least[root] = min(i, least.get(root, i))
    want = sorted(repr((i, f"{plain_fingerprint(t):016x}", least.get(groups[plain_fingerprint(t)]))) for i, t, _ in rows)
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_empty_and_all_null(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(None, None, None)] * 3, SCHEMA)).collect()
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in rows] == [(None, "0" * 16, None)] * 3
    assert simhash.keep_one(spark.createDataFrame([(None, None, None)] * 3, SCHEMA)).count() == 1


def test_chains_of_components(spark):
    from tonemill.llm.components import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (100, 300), (300, 300), (5, 4)] + [(1000, 1000 + i) for i in range(1, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100, **{1000 + i: 1000 for i in range(400)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
