"""Phrases and their cuts against a plain count."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tonemill.llm import collocations as module
from tonemill.llm.collocations import collocations

SCHEMA = "text string, lang string, phrase string, n long, words string"


def plain(rows, least, top, longest, percent=100):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        frequent = {p: f for p, f in c.items() if f >= least}
        inside = {q[i : i + k] for q, f in frequent.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * f >= percent * c[q[i : i + k]]}
        scored = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus(size, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "a\x01b", "a", "A", "b\x1cc", "x"]
    rows = []
    for _ in range(size):
        said = [rng.choice(words) if rng.random() < 0.6 else "new york stock exchange" for _ in range(rng.randint(0, 25))]
        rows.append((rng.choice([" ", "\t", "  "]).join(w + rng.choice(["", "", "", ",", ".\r\n"]) for w in said), rng.choice(["en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", "xx"), (" ,. ", None), ("hot pair " * 20_000, "en")] + rows[:3] * 4


@pytest.mark.parametrize("least, top, percent, longest", [(3, 50, 100, 5), (8, 5, 60, 4), (100, 2000, 100, 5)])
def test_phrases(spark, least, top, percent, longest):
    rows = corpus(200)
    df = spark.createDataFrame([(t, g, "p", 1, "w") for t, g in rows], SCHEMA)
    got = collocations(df, least=least, top=top, inside_percent=percent, longest=longest)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, top, longest, percent)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = corpus(60)
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(module, "_filter_words", lambda phrases, size: module.np.full(module.FILTER_BITS // 64, 2**64 - 1, dtype=module.np.uint64))
    assert sorted(tuple(r) for r in collocations(df, least=4).collect()) == plain(rows, 4, 2000, 5)


def test_scores_past_64_bits(spark):
    df = spark.createDataFrame([("a b",)] * 3, "text string").selectExpr("text", "'l' AS lang")
    frequent = df.selectExpr("'l' AS lang", "explode(array(array('a'), array('b'), array('a', 'b'))) AS words", "4000000000000 AS f").distinct()
    original = module.frequent_phrases
    try:
        module.frequent_phrases = lambda docs, longest, least: (frequent, df.selectExpr("'l' AS lang", "9000000000000 AS n").distinct())
        (row,) = module.scored_phrases(df).collect()
    finally:
        module.frequent_phrases = original
    assert row.score == 1000 * 4 * 10**12 * 9 * 10**12 // (16 * 10**24)


def test_no_rows(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
