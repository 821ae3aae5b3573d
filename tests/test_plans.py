"""Whole jobs from files to artefacts."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.functions.text import clean_text
from tonemill.operators import encoding, lexicon, manifest
from tonemill.plans import experiments, prepare, pretraining, profile, reporting
from tonemill.sources.raw import load_delimited, load_split_csvs
from tonemill.sources.runs import load_runs

UP, FLAT, DOWN = "profits rose and shares gained", "the outlook was unchanged today", "losses grew and shares fell"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    train = [f"{t} {i}" for i in range(6) for t in (UP, FLAT, DOWN)]
    labels = ["positive", "neutral", "negative"] * 6
    (root / "a").mkdir()
    (root / "b").mkdir()
    (root / "a" / "train.csv").write_text("text,label\n" + "".join(f"{t},{x}\n" for t, x in zip(train, labels)))
    (root / "a" / "test.csv").write_text(f"text,label\n{UP} again,positive\n{DOWN} again,negative\n{FLAT},neutral\n")
    (root / "b" / "test.csv").write_text("text,label\nshares gained,bullish\nshares fell and losses,bearish\nunchanged,neutral\n")
    (root / "lex.csv").write_text("Word,Positive,Negative\nrose,1,0\ngained,1,0\nfell,0,1\nlosses,0,1\n")
    return root


def config(files, out, **model):
    return {
        "experiment": {"name": "smoke"},
        "data": {
            "train_path": str(files / "a" / "train.csv"),
            "label_map": {"bullish": "positive", "bearish": "negative"},
            "eval_sets": [{"name": "a_test", "path": str(files / "a" / "test.csv")}, {"name": "b_test", "path": str(files / "b" / "test.csv")}],
        },
        "model": {"max_features": 200, "min_df": 1, **model},
        "output": {f"{k}_dir": str(out / k) for k in ("metrics", "predictions", "logs", "checkpoints")},
    }


@pytest.mark.parametrize("kind", ["logreg", "linear_svm", "naive_bayes"])
def test_statistical_run(spark, files, tmp_path, kind):
    summary = experiments.run_statistical(spark, config(files, tmp_path, type=kind), f"smoke_{kind}")
    rows = {r.eval_name: r for r in summary.collect()}
    assert rows["a_test"].accuracy == 1.0 and rows["b_test"]["size"] == 3
    predictions = spark.read.parquet(str(tmp_path / "predictions" / f"smoke_{kind}"))
    prefix = "score" if kind == "linear_svm" else "prob"
    assert {"text", "label", "prediction", f"{prefix}_positive", f"{prefix}_neutral", f"{prefix}_negative"} <= set(predictions.columns)
    assert predictions.count() == 6
    table = manifest.manifest(manifest.explode_runs(load_runs(spark, str(tmp_path / "metrics"))))
    found = {r.eval_name: r for r in table.collect()}
    assert found["a_test"].setting == "in_domain" and found["b_test"].setting == "cross_domain"
    assert found["a_test"].model == kind and found["a_test"].macro_f1 == 1.0
    assert manifest.generalisation_drop(table).count() == 1
    document = json.loads(next(Path(tmp_path / "metrics" / f"smoke_{kind}").glob("*.json")).read_text())
    assert document["train_size"] == 18 and document["eval_sets"]["a_test"]["report"]["positive"]["support"] == 1
    confusion = spark.read.csv(str(tmp_path / "metrics" / f"smoke_{kind}_confusion_matrix"), header=True)
    assert confusion.count() == 6 and confusion.columns == ["eval_name", "label", "positive", "neutral", "negative"]


def test_grid_and_reports(spark, files, tmp_path):
    specs = [{"type": "naive_bayes", "alpha": 1.0}, {"type": "logreg"}]
    summary = experiments.run_statistical_grid(spark, [config(files, tmp_path)], specs, str(tmp_path / "summary"))
    assert {(r.run_name, r.eval_name) for r in summary.collect()} == {
        (f"smoke_{m}", e) for m in ("naive_bayes", "logreg") for e in ("a_test", "b_test")}
    table = reporting.write_reports(spark, str(tmp_path / "metrics"), str(tmp_path / "reports"))
    assert table.count() == 4
    assert spark.read.csv(str(tmp_path / "reports" / "generalisation_drop"), header=True).count() == 2
    assert spark.read.csv(str(tmp_path / "summary"), header=True).count() == 4


def test_lexicon_run(spark, files, tmp_path):
    summary = experiments.run_lexicon(spark, config(files, tmp_path, lexicon_path=str(files / "lex.csv")), "lex")
    assert {r.eval_name: r.accuracy for r in summary.collect()} == {"a_test": 1.0, "b_test": 1.0}
    table = manifest.manifest(manifest.explode_runs(load_runs(spark, str(tmp_path / "metrics"))))
    assert {r.setting for r in table.collect()} == {"lexicon_eval"}


def test_supplied_model_run(spark, files, tmp_path):
    words = encoding.fit_word_ids(spark.read.csv(str(files / "a" / "train.csv"), header=True), 50)
    ids = {r.word: r.id for r in words.collect()}
    good, bad = [ids["rose"], ids["gained"]], [ids["fell"], ids["losses"]]

    def make():
        def predict(input_ids, attention_mask):
            hits = lambda xs: np.isin(input_ids, xs).sum(axis=1).astype(float)
            return np.stack([hits(good), np.full(len(input_ids), 0.5), hits(bad)], axis=1)

        return predict

    summary = experiments.run_supplied_model(spark, config(files, tmp_path, name="tiny", max_length=16), words, make, "neural")
    assert {r.eval_name: r.accuracy for r in summary.collect()} == {"a_test": 1.0, "b_test": 1.0}
    with pytest.raises(ValueError, match="eval_sets"):
        experiments.load_eval_sets(spark, {})


def test_preparation(spark, tmp_path):
    lines = [f"text {i} here@{x}" for i in range(20) for x in ("positive", " Neutral", "negative")] + ["text 0 here@positive", "", "broken"]
    (tmp_path / "fpb.txt").write_text("\n".join(lines) + "\n", encoding="latin-1")
    train = "".join(f"t{i} https://u.v/{i},{i % 3}\n" for i in range(60)) + "t1,1\nt1,1\n"
    (tmp_path / "train.csv").write_text("text,label\n" + train)
    (tmp_path / "val.csv").write_text("text,label\nt1,1\nv,2\nhttps://only.url,0\n")
    words = prepare.prepare_word_labelled(load_delimited(spark, str(tmp_path / "fpb.txt"), "fpb", "all"), "fpb")
    raw = load_split_csvs(spark, {"train": str(tmp_path / "train.csv"), "validation": str(tmp_path / "val.csv")}, "tfns")
    codes = prepare.prepare_coded(raw, "tfns")
    stats = words.stats.first()
    assert (stats.rows_before, stats.duplicates_removed, stats.rows_after) == (61, 1, 60)
    by_part = {r.part: r for r in codes.stats.collect()}
    assert by_part["train"].duplicates_removed == 2 and by_part["validation"].empty_after_clean == 1
    prepare.write_prepared([words, codes], str(tmp_path / "data"), str(tmp_path / "report"))
    sizes = {r.split: r["count"] for r in spark.read.parquet(str(tmp_path / "data" / "fpb")).groupBy("split").count().collect()}
    assert sizes == {"train": 42, "val": 9, "test": 9}
    sizes = {r.split: r["count"] for r in spark.read.parquet(str(tmp_path / "data" / "tfns")).groupBy("split").count().collect()}
    assert sizes == {"train": 51, "val": 2, "test": 9}
    documents = {d["dataset"]: d for f in Path(tmp_path / "report").glob("*.json") for d in [json.loads(f.read_text())]}
    assert documents["fpb"]["splits"]["val"]["rows"] == 9 and documents["tfns"]["cleaning"]["train"]["rows_before"] == 62
    bad = raw.withColumn("label", F.lit("9"))
    with pytest.raises(ValueError, match="65 unmapped"):
        prepare.prepare_coded(bad, "tfns")


def test_profile(spark, tmp_path):
    a = spark.createDataFrame([(1, "up $ABC 5% www.x.y", "pos"), (2, "  ", None), (3, "up up", "pos")], "k long, text string, label string")
    b = spark.createDataFrame([(1, "down", "neg"), (2, "down ", "neg")], "k long, text string, label string")
    result = profile.profile_corpora({"a": a, "b": b}, "k", top_k=3)
    duplicates = {r.dataset: (r.duplicate_rows, r.duplicate_texts) for r in result.duplicates.collect()}
    assert duplicates == {"a": (0, 0), "b": (0, 1)}
    profile.write_profile(result, str(tmp_path / "eda"))
    report = "".join(p.read_text() for p in Path(tmp_path / "eda" / "report" / "dataset=a").glob("part-*"))
    assert report.startswith("# a\n") and "- num rows: 3" in report and "- pos: 2 rows, 66.67%" in report and "- rows with ticker: 1" in report
    told = "".join(p.read_text() for p in Path(tmp_path / "eda" / "comparison_report").rglob("part-*"))
    assert told.startswith("# a and b\n") and "- num rows: a 3, b 2; most in a" in told
    assert "- columns: k, text, label, text_stripped" in report and "- duplicate texts: 0" in report
    comparison = {r.stat: (r.a, r.b) for r in spark.read.csv(str(tmp_path / "eda" / "comparison"), header=True).collect()}
    assert comparison["num_rows"] == ("3.0", "2.0") and comparison["char_length_max"] == ("18.0", "4.0")
    top = spark.read.csv(str(tmp_path / "eda" / "top_ngrams" / "a"), header=True).where("size = 1").first()
    assert (top.ngram, top["count"]) == ("up", "3")


def test_pretraining_corpus(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"word{i % 7} common text") for i in range(1, 101)], "row_number long, text string")
    examples = pretraining.masked_corpus(texts, max_length=12)
    pretraining.write_corpus(examples, str(tmp_path / "mlm"))
    stored = spark.read.parquet(str(tmp_path / "mlm"))
    assert {r.split: r["count"] for r in stored.groupBy("split").count().collect()} == {"train": 95, "val": 5}
    assert stored.where((F.size("input_ids") != 12) | (F.size("targets") != 12)).count() == 0
    assert {r.row_number for r in stored.where("split = 'val'").collect()} == set(range(96, 101))


def test_corpus_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label\n" + "".join(f"first {i},x\n" for i in range(30)) + "  ,x\n")
    (tmp_path / "b.csv").write_text("text,label\n" + "".join(f"second {i},x\n" for i in range(10)))
    config = {"data": {"corpus_paths": [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "val_ratio": 0.1}, "model": {"max_length": 8}}
    assert pretraining.run_corpus(spark, config, str(tmp_path / "out")) == {"train": 36, "val": 4}


def test_projections_apply_to_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, " good  https://u.v "), (2, "bad")], "id long, text string").write.parquet(str(source))
    stream = spark.readStream.schema("id long, text string").parquet(str(source))
    scored = lexicon.score_with_sets(stream.withColumn("text", clean_text(F.col("text"))), ["GOOD"], ["BAD"])
    query = scored.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.id, r.text, r.prediction) for r in spark.table("scored").collect()} == {(1, "good", "positive"), (2, "bad", "negative")}
