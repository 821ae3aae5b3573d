"""Likeness by subtracted sketches against plain sets of paragraphs."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from tonemill.llm.fingerprints import differing, fingerprints

SCHEMA = "doc_id long, text string, row string, part int, own string"


def paragraphs(text):
    found = re.findall(r"[^\n]{60,}?[.!?](?=[ \t\n\x0b\f\r]|$)|[^\n]+", text)
    return {p.strip(" ") for p in found} - {""}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(ordered):
        following, half = ordered[(k + 1) % len(ordered)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = paragraphs(text)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(own, paragraphs(edited)), alike(own, paragraphs(following))))
    return sorted(map(repr, out))


def got(spark, rows):
    df = fingerprints(spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA))
    return df.collect(), sorted(repr((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next)) for r in df.collect())


def test_likeness(spark):
    rng = random.Random(4)
    pool = [f"Sentence {k} says {'very ' * rng.randint(0, 20)}much." for k in range(300)]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))]
        rows.append((i * 3, "\n".join(lines)))
    rows += [(9, rows[3][1])] * 2 + [(12, rows[5][1] + "\nmore"), (None, "no id. é\nü"), (None, None), (900, None), (901, "  \n\n"), (902, "x")]
    rows.append((903, "\n".join(f"line {k}" for k in range(5000))))
    found, said = got(spark, rows)
    assert said == plain(rows)
    by_text = {}
    for r in found:
        by_text.setdefault((r.doc_id, r.edited_sha256), r)
    texts = {i: t for i, t in rows if i is not None}
    same = [r.fingerprint for r in found if r.doc_id in (9, 9)] + [r.fingerprint for r in found if r.doc_id == 15]
    assert texts[9] == rows[3][1] and len({r.fingerprint for r in found if r.doc_id == 9}) == 1 and same
    assert all(r.fingerprint.startswith("0:") for r in found if r.doc_id in (900, 901))


def test_one_row_and_none(spark):
    assert got(spark, [])[0] == []
    assert got(spark, [(5, "One.\nTwo.")])[1] == plain([(5, "One.\nTwo.")])


def test_wider_sketches_recover_all(spark):
    rng = random.Random(2)
    sets = [(set(rng.sample(range(10**9), a)), set(rng.sample(range(10**9), b)), set(rng.sample(range(10**9), c))) for a, b, c in [(0, 0, 0), (3, 0, 0), (50, 1, 0), (200, 40, 60), (2000, 900, 2500), (0, 1, 0)]]
    rows = [(i, sorted(s | x), sorted(s | y)) for i, (s, x, y) in enumerate(sets)]
    told = differing(spark.createDataFrame(rows, "row long, a array<long>, b array<long>"), [("a", "b")]).orderBy("row").collect()
    assert [(r.n_left, r.n_right, r.differing) for r in told] == [(len(a), len(b), len(set(a) ^ set(b))) for _, a, b in rows]


def test_no_python_in_the_plan(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a. b\nc").alias("text"))
    plan = fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|MapIn", plan)
