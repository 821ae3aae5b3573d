"""The pipeline's stages against plain versions, and its edges."""

from __future__ import annotations

import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_decontamination import plain_tiles
from test_line_dedup import plain as plain_lines
from test_simhash import plain_fingerprint
from tonemill.llm import decontamination, packing
from tonemill.llm.queries import tokenizer_definition
from tonemill.runtime import work_table

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(work_table(stage(spark, docs[-1], FOLDER), "stage"))
    return docs


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    assert all(df.columns == COLUMNS for df in stages[:5])


def test_toxic_documents_go_and_others_stay(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    before, after = ({r.doc_id for r in df.collect()} for df in stages[:2])
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    assert after <= before and len((before - after) - toxic) <= 0.1 * len(before)


def test_lines_follow_the_plain_count(stages):
    data = [(r.doc_id, r.text, r.source, None) for r in stages[1].collect()]
    want = sorted((eval(x)[:2] for x in plain_lines(data, 10)), key=lambda r: r[0])
    assert want == sorted(((r.doc_id, r.text) for r in stages[2].collect()), key=lambda r: r[0])


def test_one_of_each_group_stays(stages):
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in stages[2].collect()]
    codes = sorted({c for _, c in docs})
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for i, c in docs:
        least[find(c)].append(i)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(map(min, least.values()))


def test_leaks_go(spark, stages):
    items = [decontamination.tokens(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in stages[4].collect()}
    for r in stages[3].collect():
        own = decontamination.tokens(r.text)
        seeds = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        leak = False
        for item in items:
            if sum(tuple(item[i : i + 5]) in seeds for i in range(len(item) - 4)) * 5 >= decontamination.COVERAGE * len(item):
                near = [t if t in set(item) else "" for t in own]
                leak |= sum(n for _, _, n in plain_tiles(item, near, 5)) >= decontamination.COVERAGE * len(item)
        assert leak == (r.doc_id not in kept), r.doc_id


def test_packed_pieces_are_the_documents(stages):
    tokenizer, got = Tokenizer.from_str(tokenizer_definition()), defaultdict(list)
    for r in stages[5].collect():
        got[r.doc_id].append(r)
    sizes = []
    for r in stages[4].collect():
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
        sizes += [min(2048, n - a) for a in range(0, n, 2048)]
        assert sorted(p.length for p in got.pop(r.doc_id)) == sorted(min(2048, n - a) for a in range(0, n, 2048))
    assert not got
    assert len({r.sequence_id for r in stages[5].collect()}) <= packing.bin_bound(np.array(sizes), 2048) + 1


def test_run_gives_the_last_stage(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(corpus_pipeline.run(spark, FOLDER).select(columns)) == rows(stages[5].select(columns))


def test_every_stage_takes_odd_rows_and_none(spark):
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, None, "b", None), (3, "x " * 30_000, "en", None, 60_000), (3, "y", "en", "c", 1)]
    for data in (odd, []):
        docs = spark.createDataFrame(data, SCHEMA).withColumn("score", F.lit("extra"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = work_table(stage(spark, docs, FOLDER), "odd")
            assert docs.columns == [*COLUMNS, "score"]
        placed = work_table(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER), "odd")
        assert {r.doc_id for r in placed.collect()} == {r.doc_id for r in docs.collect()}
