"""What stages hold in Python workers, which stay and serve the stages after them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tonemill.llm import decontamination, packing, simhash, toxicity
from tonemill.llm.queries import tokenizer_definition


def words_held(spark):
    """Words that decontamination still holds in any worker."""

    def run(batches):
        for batch in batches:
            caches = [v for k, v in vars(decontamination).items() if isinstance(v, dict) and not k.startswith("__")]
            yield pa.RecordBatch.from_pydict({"held": [sum(map(len, caches))]})

    return max(r.held for r in spark.range(0, 64, 1, 8).mapInArrow(run, "held long").collect())


def test_workers_hold_no_words_after_decontamination(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{i * 50 + k}" for k in range(50)), "x") for i in range(64)], "doc_id long, text string, source string").repartition(8)
    benchmark = spark.createDataFrame([(1, "word0 word1 word2 word3 word4 word5 word6")], "item_id long, text string")
    assert decontamination.decontaminate(docs, benchmark).count() == 63
    assert words_held(spark) == 0


def test_texts_of_a_large_batch_are_taken_in_slices(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    size = len(toxicity.Gains(b"", b"").features(b""))
    model = toxicity.Model(b"a " * 99, b"b " * 99, np.zeros(size), np.ones(size), np.zeros(size + 1))
    caught = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, kinds: caught.append(run))
    toxicity.scored(docs, model)
    packing.token_pieces(docs, tokenizer_definition(), words_apart=True)
    simhash.fingerprints(docs)
    monkeypatch.undo()
    texts = ["some words " * 100_000] * 8 + [None, ""]
    ids = list(range(len(texts)))
    for run, first in zip(caught, (["doc_id", "text"], ["doc_id", "text"], ["id", "digest", "text"])):
        columns = [pa.array(ids), *[pa.array(["x"] * len(ids))] * ("digest" in first), pa.array(texts)]
        out = list(run(iter([pa.RecordBatch.from_arrays(columns, names=first)])))
        assert len(out) >= 3  # 8.8 MB of text
        assert list(dict.fromkeys(i for batch in out for i in batch.column(0).to_pylist())) == ids
