"""Hashes against zlib, the draw against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tonemill.llm.importance import resample, run_crcs, words_of

SCHEMA = "doc_id long, text string, n_words string, bucket int"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=40), max_size=6), max_size=4), st.integers(1, 4))
def test_runs_have_their_own_crc(texts, longest):
    words = [w for t in texts for w in t]
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    text, crc = run_crcs(words, text_of, longest)
    expected = [(k, zlib.crc32(b" ".join(t[i : i + n]))) for n in range(1, longest + 1) for k, t in enumerate(texts) for i in range(len(t) - n + 1)]
    assert list(zip(text.tolist(), crc.tolist())) == expected


def test_long_words_shift_far():
    words = [b"a" * 70_000, b"b", b"c" * 130_001]
    _, crc = run_crcs(words, np.zeros(3, dtype=int), 3)
    assert crc[-1] == zlib.crc32(b" ".join(words))


def test_words_are_letters_digits_and_all_above_ascii():
    assert words_of("Ab_1\x00é·É 9".encode()) == ["ab".encode(), b"1", "é·É".encode(), b"9"]


def features(text, longest):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, longest, buckets, least, percent):
    of = lambda runs: [zlib.crc32(f.encode()) % buckets for f in runs]
    own = [(i, *features(t, longest)) for i, t in rows]
    source, aimed = Counter(b for _, _, f in own for b in of(f)), Counter(b for t in target for b in of(features(t, longest)[1]))
    s_all, t_all = sum(source.values()), sum(aimed.values())
    gain = {b: math.floor(1000 * math.log((aimed[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in of(f))
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = rank
    return sorted(map(repr, map(tuple, out)))


def got(spark, rows, target, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    aimed = spark.createDataFrame([(t, 3) for t in target], "text string, buckets int")
    return sorted(repr(tuple(r)) for r in resample(docs, aimed, **options).collect())


def test_draw(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "Zoë9", "a_b", "-"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, say(rng.randint(0, 60))) for i in range(150)]
    rows += [(7, rows[7][1])] * 2 + [(None, say(40)), (500, None), (501, ""), (502, " .,;"), (503, "long " * 30_000)]
    target = [say(30) for _ in range(4)] + [None, ""]
    for longest, buckets in ((1, 10_000), (3, 97)):
        expected = plain(rows, target, longest, buckets, 20, 25)
        assert got(spark, rows, target, longest=longest, buckets=buckets, percent=25) == expected


def test_empty_tables(spark):
    assert got(spark, [], ["a"]) == []
    assert got(spark, [(1, "a b")], [], least_words=1, percent=100) == plain([(1, "a b")], [], 1, 10_000, 1, 100)
