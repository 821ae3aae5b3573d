"""Line spread against a plain count."""

from __future__ import annotations

import random
from collections import defaultdict

from tonemill.llm.line_dedup import remove_boilerplate, spread_lines

SCHEMA = "doc_id long, text string, source string, n_lines string"


def plain(rows, least):
    sites, texts = defaultdict(set), defaultdict(set)
    for _, text, source, _ in rows:
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            sites[line].add(source)
            texts[line].add(text)
    bad = {x for x in sites if len(sites[x] - {None}) >= least and len(texts[x]) >= least}
    return sorted(
        repr((i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad), 0 if t is None else len(t.split("\n")),
              sum(x.strip(" ") in bad for x in (t or "").split("\n"))))
        for i, t, _, _ in rows
    )


def got(spark, rows, least):
    df = remove_boilerplate(spark.createDataFrame(rows, SCHEMA), min_sites=least)
    return sorted(repr((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in df.collect())


def test_spread_lines_go(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lines = [f"own {i} {k}" for k in range(rng.randint(0, 4))] + [f"  shared {k} " for k in range(20) if rng.random() < k / 60]
        rng.shuffle(lines)
        rows.append((i, "\n".join([*lines, ""]), f"s{rng.randint(0, 11)}" if rng.random() < 0.95 else None, "x"))
    for least in (2, 5, 9):
        assert got(spark, rows, least) == plain(rows, least)


def test_copies_of_one_document_are_no_boilerplate(spark):
    rows = [(i, "all the same\nlines", f"s{i % 20}", None) for i in range(200)]
    assert got(spark, rows, 10) == plain(rows, 10)
    assert spread_lines(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_nulls_blanks_repeats_and_long_texts(spark):
    long = "\n".join(f"line {i} " + "y" * 50 for i in range(20_000))
    rows = [(None, None, "a", None), (1, "", "a", None), (1, "", "b", None), (2, "\n \n", "c", None), (3, long, "d", None)]
    rows += [(10 + i, f"common\nown {i}", f"s{i}", None) for i in range(12)] * 2
    assert got(spark, rows, 10) == plain(rows, 10)
    assert got(spark, [], 10) == []


def test_no_python_in_the_plan(spark):
    plan = remove_boilerplate(spark.createDataFrame([(1, "a", "b", None)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
