import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.operators import cleaning, encoding, history, inference, lexicon, manifest, metrics, ngrams, profile, splits


def test_lexicon_paths_agree(spark):
    words = spark.createDataFrame([("GOOD", True, False), ("BAD", False, True), ("BOTH", True, True)],
                                  "word string, positive boolean, negative boolean")
    docs = spark.createDataFrame(
        [(1, "good Good bad"), (2, "both"), (3, ""), (4, "nothing here"), (5, "bad-good bad"), (6, None), (None, "good")], "id long, text string")
    in_row = {r.id: r for r in lexicon.score_with_sets(docs, ["GOOD", "BOTH"], ["BAD", "BOTH"]).collect()}
    joined = {r.id: r for r in lexicon.score(docs, ["id"], words).collect()}
    assert (joined[None].positive_hits, joined[6].positive_hits) == (1, 0)
    assert in_row.keys() == joined.keys()
    for k, r in in_row.items():
        assert (r.positive_hits, r.negative_hits, r.prediction) == (
            joined[k].positive_hits, joined[k].negative_hits, joined[k].prediction)
    assert (in_row[1].positive_hits, in_row[1].negative_hits, in_row[1].prediction) == (2, 1, "positive")
    assert (in_row[2].positive_hits, in_row[2].negative_hits, in_row[2].prediction) == (1, 1, "neutral")
    assert in_row[5].prediction == "negative"
    zero = lexicon.score(docs, ["id"], words, min_count_diff=0).where("id = 3").first()
    assert zero.prediction == "positive"


def test_dedup_keeps_the_first(spark):
    rows = [(5, "a  b", "x"), (2, " a b ", "x"), (9, "a b", "y"), (7, "http://u.v", "x"), (8, None, None), (1, "a b", None), (3, "a b", None)]
    df = spark.createDataFrame(rows, "k long, text string, label string")
    distinct = cleaning.distinct_texts(df, "k").persist()
    kept = {(r.k, r.text, r.label) for r in cleaning.kept_rows(distinct).collect()}
    assert kept == {(2, "a b", "x"), (9, "a b", "y"), (1, "a b", None)}
    assert cleaning.clean_stats(distinct).first().asDict() == {
        "rows_before": 7, "empty_after_clean": 2, "duplicates_removed": 2, "rows_after": 3}
    literal = cleaning.kept_rows(cleaning.distinct_texts(df, "k", null_text="literal"))
    assert literal.where("text = 'nan'").count() == 1


def test_stratified_split_sizes(spark):
    sizes = {"a": 51, "b": 299, "c": 49}
    rows = [(i, label) for i, label in enumerate(x for x, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "k long, label string").repartition(5)
    out = splits.stratified_split(df, "k", "label", ["train", "val", "test"], [0.30, 0.50])
    got = Counter((r.split, r.label) for r in out.collect())
    totals = Counter()
    for (split, _), n in got.items():
        totals[split] += n
    assert totals == {"train": 279, "val": 60, "test": 60}
    assert [got["train", x] for x in "abc"] == [36, 209, 34]
    again = splits.stratified_split(df.repartition(3), "k", "label", ["train", "val", "test"], [0.30, 0.50])
    assert sorted(out.collect()) == sorted(again.collect())
    other = splits.stratified_split(df, "k", "label", ["train", "val", "test"], [0.30, 0.50], seed=7)
    assert sorted(out.collect()) != sorted(other.collect())


def test_split_with_a_dominant_class_and_empty_side(spark):
    rows = [(i, "big") for i in range(5000)] + [(10_000 + i, "small") for i in range(2)]
    df = spark.createDataFrame(rows, "k long, label string")
    out = splits.stratified_split(df, "k", "label", ["train", "test"], [0.15])
    got = Counter((r.split, r.label) for r in out.collect())
    assert got["test", "big"] + got["test", "small"] == math.ceil(0.15 * 5002)
    assert sum(got.values()) == 5002


def test_strata_checks(spark):
    def counts(**sizes):
        return spark.createDataFrame(list(sizes.items()), "label string, n long")

    splits.check_strata(counts(a=10, b=10), "label", [0.3, 0.5])
    with pytest.raises(ValueError, match="two rows"):
        splits.check_strata(counts(a=10, b=1), "label", [0.3])
    with pytest.raises(ValueError, match="one row per class"):
        splits.check_strata(counts(a=2, b=2, c=2), "label", [0.1])


def test_head_tail_split_on_uneven_keys(spark):
    keys = [i if i < 900 else 10**15 + i for i in range(1003)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    out = {r.k: r.split for r in splits.head_tail_split(df, "k", 0.05, buckets=16).collect()}
    cut = int(1003 * (1 - 0.05))
    assert [out[k] for k in keys] == ["train"] * cut + ["val"] * (1003 - cut)


def test_top_ngrams_break_ties_by_first_seen(spark):
    texts = ["zz yy zz", "yy xx", "a zz-xx yy", "the one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    import re

    for n in (1, 2, 3):
        counter = Counter()
        for t in texts:
            found = [w for w in re.findall(r"[A-Za-z]+(?:'[A-Za-z]+)?", t) if len(w) >= 2 and w != "the"]
            counter.update(" ".join(found[i:i + n]) for i in range(len(found) - n + 1))
        expected = counter.most_common(4)
        assert [tuple(r) for r in ngrams.top_ngrams(df, "id", n, 4, ["the"]).collect()] == expected
        table = ngrams.top_ngram_table(df, "id", [1, 2, 3], 4, ["the"]).where(F.col("size") == n).orderBy("rank")
        assert [(r.ngram, r["count"]) for r in table.collect()] == expected


def _lengths(spark, values, label="x"):
    rows = [("char_length", int(v), int(n), label) for v, n in Counter(values).items()]
    return spark.createDataFrame(rows, "feature string, value long, n long, label string")


@pytest.mark.parametrize("values", [[1, 2, 3, 100, 7, 7, 31], [5, 5, 5], list(range(61)), [0, 9]])
def test_histogram_and_box_match_numpy(spark, values):
    counts, edges = np.histogram(values, bins=30)
    rows = profile.histogram(_lengths(spark, values)).orderBy("bin").collect()
    assert [r["count"] for r in rows] == counts.tolist()
    assert np.allclose([r.low for r in rows], edges[:-1]) and math.isclose(rows[-1].high, edges[-1])
    q1, median, q3 = np.percentile(values, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in values if low <= v <= high]
    row = profile.box_plot(_lengths(spark, values), ["label"]).first()
    assert np.allclose([row.q1, row.median, row.q3], [q1, median, q3])
    assert (row.whisker_low, row.whisker_high) == (min(min(inside), q1), max(max(inside), q3))
    assert row.outliers == len(values) - len(inside)


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "null")], "k int, t string")
    assert profile.duplicate_count(df, ["t"]).first().duplicates == 2
    assert profile.duplicate_count(df).first().duplicates == 0


def _metrics_by_hand(pairs):
    out = {}
    for c in C.LABELS:
        hit = sum(t == p == c for t, p in pairs)
        predicted, support = sum(p == c for _, p in pairs), sum(t == c for t, _ in pairs)
        out[c] = (hit / predicted if predicted else 0, hit / support if support else 0,
                  2 * hit / (predicted + support) if predicted + support else 0, support)
    return out


@pytest.mark.parametrize("pairs", [
    [("positive", "positive"), ("neutral", "positive"), ("neutral", "neutral")],
    [("positive", "negative")] * 3,
    [("positive", "positive"), ("neutral", "neutral"), ("negative", "negative"), ("negative", "neutral")],
])
def test_metrics_by_hand(spark, pairs):
    df = spark.createDataFrame([("e", *p) for p in pairs], "eval_name string, label string, prediction string")
    hand = _metrics_by_hand(pairs)
    total = sum(v[3] for v in hand.values())
    row = metrics.evaluation_summary(df, ["eval_name"]).first()
    assert row.accuracy == pytest.approx(sum(t == p for t, p in pairs) / len(pairs))
    for i, name in enumerate(("precision", "recall", "f1")):
        assert row[f"macro_{name}"] == pytest.approx(sum(v[i] for v in hand.values()) / 3)
        assert row[f"weighted_{name}"] == pytest.approx(sum(v[i] * v[3] for v in hand.values()) / total)
    matrix = {r.label: (r.positive, r.neutral, r.negative) for r in metrics.confusion_matrix(df, ["eval_name"]).collect()}
    assert matrix == {a: tuple(sum((t, p) == (a, b) for t, p in pairs) for b in C.LABELS) for a in C.LABELS}
    report = {r.entry: r for r in metrics.class_report(df, ["eval_name"]).collect()}
    for c in C.LABELS:
        assert (report[c].precision, report[c].recall, report[c].f1, report[c].support) == pytest.approx(hand[c])
    assert report["accuracy"].f1 == pytest.approx(row.accuracy) and report["accuracy"].precision is None
    payload = metrics.metric_payload(df, ["eval_name"]).first()
    assert payload.report["macro avg"]["f1-score"] == pytest.approx(row.macro_f1)


def test_encoding_is_fixed_length(spark):
    texts = ["b a b!", "", "zz " * 200, "a unseen"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = encoding.fit_word_ids(df.where("id = 0"), 3)
    ids = {r.word: r.id for r in words.collect()}
    assert ids == {"b": 5, "!": 6, "a": 7}
    out = {r.id: r for r in encoding.encode(df, ["id"], words, 8).collect()}
    assert out[0].input_ids == [C.CLS_ID, 5, 7, 5, 6, C.SEP_ID, 0, 0] and out[0].attention_mask == [1] * 6 + [0, 0]
    assert out[1].input_ids == [C.CLS_ID, C.SEP_ID] + [0] * 6
    assert out[2].input_ids == [C.CLS_ID] + [C.UNK_ID] * 6 + [C.SEP_ID] and out[2].attention_mask == [1] * 8
    assert out[3].input_ids[:4] == [C.CLS_ID, 7, C.UNK_ID, C.SEP_ID]


def test_mask_rates(spark):
    df = spark.range(400).select("id", F.array_repeat(F.lit(50), 100).alias("w")).select(
        "id", F.concat(F.array(F.lit(C.CLS_ID)), "w", F.array(F.lit(C.SEP_ID), F.lit(C.PAD_ID))).alias("input_ids"))
    rows = encoding.mask_tokens(df, "id", 1000).collect()
    picked = [(x, t) for r in rows for x, t in zip(r.input_ids, r.targets) if t != C.IGNORED_TARGET]
    assert all(t == 50 for _, t in picked)
    assert abs(len(picked) / 40_000 - 0.15) < 0.01
    masked = sum(x == C.MASK_ID for x, _ in picked) / len(picked)
    kept = sum(x == 50 for x, _ in picked) / len(picked)
    assert abs(masked - 0.8) < 0.03 and abs(kept - 0.1) < 0.02
    for r in rows:
        assert (r.input_ids[0], r.input_ids[-2], r.input_ids[-1]) == (C.CLS_ID, C.SEP_ID, C.PAD_ID)
    assert rows == encoding.mask_tokens(df, "id", 1000).collect()


def test_logits(spark):
    def make():
        return lambda a: np.stack([a[:, 0], a[:, 1], a[:, 0] * 0], axis=1)

    df = spark.createDataFrame([(0, [2.0, 2.0]), (1, [-1.0, -2.0]), (2, [700.0, 900.0])], "id long, v array<double>")
    out = inference.classify_logits(inference.batch_logits(df, make, ["v"], [[2]], batch_size=2)).orderBy("id").collect()
    assert [r.prediction for r in out] == ["positive", "negative", "neutral"]
    for r in out:
        exps = np.exp(np.array(r.logits) - max(r.logits))
        assert np.allclose([r.prob_positive, r.prob_neutral, r.prob_negative], exps / exps.sum())


def test_history(spark):
    rows = [("r", 1, 0.9, None, None), ("r", 1, None, 0.8, 0.2), ("r", 2, None, 0.7, 0.5), ("r", 3, None, 0.7, 0.5), ("r", 3, 0.1, None, None)]
    log = spark.createDataFrame(rows, "run_name string, step long, loss double, eval_loss double, eval_macro_f1 double")
    series = {(r.step, r.series): r.value for r in history.loss_series(log, ["run_name"]).collect()}
    assert series == {(1, "Train Loss"): 0.9, (3, "Train Loss"): 0.1, (1, "Eval Loss"): 0.8, (2, "Eval Loss"): 0.7, (3, "Eval Loss"): 0.7}
    assert {r.series for r in history.metric_series(log, ["run_name"]).collect()} == {"Eval Macro-F1"}
    best = history.best_steps(log, ["run_name"]).first()
    assert (best.best_f1_step, best.best_loss_step) == (2, 2)


def test_generalisation_drop(spark):
    rows = [
        ("r1", "m", "data/a/train.csv", "a_test", "data/a/test.csv", 0.9),
        ("r1", "m", "data/a/train.csv", "a2_test", "x/a/test.csv", 0.8),
        ("r1", "m", "data/a/train.csv", "b_test", "data/b/test.csv", 0.5),
        ("r1", "m", "data/a/train.csv", "b_val", "data/b/val.csv", 0.1),
        ("lex", "", None, "a_test", "data/a/test.csv", 0.3),
        ("r2", None, "data/a/train.csv", "b_test", "data/b/test.csv", 0.5),
    ]
    df = spark.createDataFrame(rows, "run_name string, model_name string, train_path string, eval_name string, path string, macro_f1 double")
    df = df.withColumns({"accuracy": F.lit(0.0), "weighted_f1": F.lit(0.0)})
    table = manifest.manifest(df)
    assert {r.model for r in table.collect()} == {"m", "unknown"}
    assert {r.setting for r in table.where("run_name = 'lex'").collect()} == {"lexicon_eval"}
    drop = manifest.generalisation_drop(table).collect()
    assert len(drop) == 1 and drop[0].generalisation_drop == pytest.approx(0.4) and drop[0].cross_eval_domain == "b"
    best = manifest.leaderboard(table).collect()
    assert [r.macro_f1 for r in best if r.run_name == "r1"] == [0.9, 0.8, 0.5]


def test_many_ngrams_are_ranked_in_parts(spark):
    """Above the size that Spark limits within a window, parts still pass on no more than top_k rows."""
    from tonemill.operators import ngrams

    df = spark.createDataFrame([(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}" for j in range(26))) for i in range(60)], "id long, text string")
    table = ngrams.top_ngram_table(df, "id", [1, 2], 5000)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan
    rows = {n: [r for r in table.collect() if r.size == n] for n in (1, 2)}
    assert [r.rank for r in sorted(rows[1], key=lambda r: r.rank)] == list(range(1, len(rows[1]) + 1)) and len(rows[1]) == 26 * 26
    words = [(r.ngram, r["count"]) for r in ngrams.top_ngrams(df, "id", 1, 7).collect()]
    assert words == [(r.ngram, r["count"]) for r in sorted(rows[1], key=lambda r: r.rank)[:7]]


def test_stopword_tables_and_lists_agree(spark):
    from tonemill.functions.tokens import stopword_table
    from tonemill.operators import ngrams

    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "a cat, the dog"), (3, None)], "id long, text string")
    extra = spark.createDataFrame([(" The ",), ("and",)], "word string")
    by_table = ngrams.top_ngrams(df, "id", 2, 10, stopword_table(spark, False, extra)).collect()
    assert by_table == ngrams.top_ngrams(df, "id", 2, 10, ["the", "and"]).collect()
    assert ("cat dog", 2) in [tuple(r) for r in by_table]
    assert stopword_table(spark, True).where("word = 'the'").count() == 1


def test_cleaning_runs_once(spark):
    from tonemill.operators import cleaning

    df = spark.createDataFrame([(1, "a  b", "x"), (2, " ", "x")], "k long, text string, label string")
    kept = cleaning.kept_rows(cleaning.distinct_texts(df, "k"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?") == 1 and kept.count() == 1


def test_label_codes(spark):
    from tonemill.functions.labels import decode_label

    codes = ["0", "1", "2", "1.0", "1.7", "x", "3", None]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    got = [r[0] for r in df.select(decode_label(F.col("code"))).collect()]
    assert got == ["negative", "positive", "neutral", "positive", None, None, None, None]


def test_file_rows_are_numbered_across_splits(spark, tmp_path):
    from tonemill.sources.numbering import number_file_rows, with_file_position

    lines = [f"line {i} " + "x" * 200 for i in range(4000)]
    for part in range(2):
        (tmp_path / f"part-{part}.txt").write_text("\n".join(lines[part * 2000 : part * 2000 + 2000]) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = number_file_rows(with_file_position(spark.read.text(str(tmp_path))), "n")
        assert df.rdd.getNumPartitions() >= 1
        assert [r.value for r in df.orderBy("n").collect()] == lines and df.agg(F.max("n")).first()[0] == 4000
        assert "BroadcastHint" not in df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ngrams_of_full_buckets_are_the_most_frequent(spark, monkeypatch):
    """Counting by bucket first leaves out n-grams, and none of the best with their ties."""
    word = lambda n: "".join("abcdefghij"[int(d)] for d in f"{n:03}")
    rows = [(i, " ".join(word((i * j * j) % 23 if j % 3 else i * 7 + j) for j in range(1, 14))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    whole = ngrams.top_ngram_table(df, "id", [1, 2, 3], 9).collect()
    monkeypatch.setattr(ngrams, "FEW", 0)
    monkeypatch.setattr(ngrams, "BUCKETS", 64)
    assert sorted(ngrams.top_ngram_table(df, "id", [1, 2, 3], 9).collect()) == sorted(whole) and len(whole) == 27
    monkeypatch.setattr(ngrams, "BUCKETS", 1 << 16)
    assert sorted(ngrams.top_ngram_table(df, "id", [1, 2, 3], 9).collect()) == sorted(whole)
    assert ngrams.frequent_counts(df, "id", [1, 2, 3], 9).count() < ngrams.ngram_counts(df, "id", [1, 2, 3]).count() / 2
    assert ngrams.top_ngrams(df, "id", 2, 9).collect() == [(r.ngram, r["count"]) for r in sorted(whole, key=lambda r: r["rank"]) if r.size == 2]
    assert len(ngrams.top_ngram_table(df, "id", [2], 10**4).collect()) == ngrams.ngram_counts(df, "id", [2]).count()


def test_lexicon_words_are_counted_within_their_text(spark):
    """Hits are summed by key alone: no table of (text, word) pairs is aggregated, and rows that share a key share their hits."""
    rows = [(1, "good good bad"), (1, "good"), (2, None), (None, "bad Bad none"), (3, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    words = spark.createDataFrame([("GOOD", True, False), ("BAD", False, True)], "word string, positive boolean, negative boolean")
    scored = lexicon.score(df, ["id"], words)
    aggregates = [line.split("functions=")[0] for line in scored._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in line]
    assert aggregates and "_word" not in "".join(aggregates)
    found = sorted((str(r.id), r.text or "", r.positive_hits, r.negative_hits, r.prediction) for r in scored.collect())
    assert found == [("1", "good", 3, 1, "positive"), ("1", "good good bad", 3, 1, "positive"), ("2", "", 0, 0, "neutral"), ("3", "", 0, 0, "neutral"), ("None", "bad Bad none", 0, 2, "negative")]
