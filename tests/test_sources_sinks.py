import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from tonemill.operators import manifest
from tonemill.sinks import writers
from tonemill.sources.corpus import load_stopwords, load_texts
from tonemill.sources.labeled import labeled_frame, load_labeled_csv, read_csv
from tonemill.sources.lexicon import load_lexicon
from tonemill.sources.numbering import number_rows
from tonemill.sources.records import holds_line_breaks
from tonemill.sources.raw import load_delimited, load_registry, load_split_csvs
from tonemill.sources.runs import load_history, load_runs


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        'id,text,label\n1,"two\nlines, ""quoted""", Positive \n2,NA,positive\n3,plain,null\n4,  ,neutral\n5,ok,bearish\n',
        encoding="utf-8",
    )
    rows = load_labeled_csv(spark, str(path)).orderBy("row_id").collect()
    assert [(r.text, r.label) for r in rows] == [('two\nlines, "quoted"', "positive"), ("ok", "negative")]


def test_labelled_csv_rejects(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    # The unknown label sits on a row whose text is blank.
    bad.write_text("text,label\nfine,positive\n   ,nonsense\n", encoding="utf-8")
    with pytest.raises(ValueError, match="nonsense"):
        load_labeled_csv(spark, str(bad))
    with pytest.raises(ValueError, match="lacks"):
        load_labeled_csv(spark, str(bad), text_column="body")
    empty = tmp_path / "empty.csv"
    empty.write_text("text,label\n   ,positive\n", encoding="utf-8")
    with pytest.raises(ValueError, match="empty"):
        load_labeled_csv(spark, str(empty))


def test_labelled_frame_from_any_table(spark):
    df = spark.createDataFrame([(7, " x ", 1), (8, None, 0)], "k int, body string, code int")
    rows = labeled_frame(df, "body", "code", keep=["k"]).collect()
    assert [(r.k, r.text, r.label) for r in rows] == [(7, "x", "positive")]


def test_delimited_lines(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_bytes("first@a@positive\r\n\n \t\nno delimiter\nna\xefve caf\xe9@neutral\n@\n".encode("latin-1"))
    rows = load_delimited(spark, str(path), "fpb", "all").orderBy("line_number").collect()
    got = [(r.line_number, r.text, r.label, r.parse_ok) for r in rows]
    assert got == [
        (1, "first@a", "positive", True), (2, "", None, False), (3, "", None, False),
        (4, "no delimiter", None, False), (5, "na\xefve caf\xe9", "neutral", True), (6, "", "", True),
    ]
    assert rows[2].raw_line == " \t" and rows[0].dataset == "fpb" and rows[0].split == "all"


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line {i}@x\n" for i in range(1, 5001)), encoding="latin-1")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = load_delimited(spark, str(path), "d", "s").persist()
        assert df.where(F.col("text") != F.concat(F.lit("line "), F.col("line_number").cast("string"))).count() == 0
        assert df.agg(F.max("line_number"), F.count("*")).first()[:] == (5000, 5000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_split_csvs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label\na1,0\na2,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("text,label,extra\nb1,2,x\n", encoding="utf-8")
    paths = {"train": str(tmp_path / "a.csv"), "validation": str(tmp_path / "b.csv")}
    df = load_registry(spark, {"tfns": lambda s: load_split_csvs(s, paths, "tfns")})["tfns"]
    rows = df.orderBy("row_number").collect()
    assert [(r.row_number, r.text, r.split, r.extra) for r in rows] == [
        (1, "a1", "train", None), (2, "a2", "train", None), (3, "b1", "validation", "x")]
    assert rows[2].source_file == paths["validation"] and rows[0].dataset == "tfns"


def test_texts_and_stopwords(spark, tmp_path):
    (tmp_path / "z.csv").write_text("text,label\nz1,0\nnull,1\n  ,1\nz2,1\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text("label,text\n0, a1 \n", encoding="utf-8")
    rows = load_texts(spark, [str(tmp_path / "z.csv"), str(tmp_path / "a.csv")]).orderBy("row_number").collect()
    assert [(r.row_number, r.text) for r in rows] == [(1, "z1"), (2, "z2"), (3, "a1")]
    (tmp_path / "stop.txt").write_text(" the \n\nof\n", encoding="utf-8")
    assert {r.word for r in load_stopwords(spark, str(tmp_path / "stop.txt")).collect()} == {"of", "the"}


def test_lexicon_thresholds(spark, tmp_path):
    path = tmp_path / "lex.csv"
    path.write_text("Word,Positive,Negative\ngood,2009,0\nGood,0,-2011\nbad,0,2009\nmixed,1,1\ngone,-2009,0\nNA,1,0\n", encoding="utf-8")
    rows = {r.word: (r.positive, r.negative) for r in load_lexicon(spark, str(path)).collect()}
    assert rows == {"GOOD": (True, False), "BAD": (False, True), "MIXED": (True, True)}
    rows = {r.word for r in load_lexicon(spark, str(path), threshold=1).collect()}
    assert rows == {"GOOD", "BAD"}


def test_number_rows_by_key(spark):
    keys = [10**12 + i * i for i in range(3000)] + list(range(50))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.n for r in number_rows(df, "k", "n", buckets=32).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), start=1)}


def test_runs_from_json(spark, tmp_path):
    folder = tmp_path / "metrics" / "deep"
    folder.mkdir(parents=True)
    run = {"run_name": "r1", "model_type": "logreg", "model_name": "", "train_path": "data/fpb/train.csv",
           "eval_sets": {"fpb_test": {"accuracy": 0.5, "macro_f1": 0.4, "weighted_f1": 0.45, "path": "data/fpb/test.csv"},
                         "x": {"accuracy": 0.1, "macro_f1": 0.1, "weighted_f1": 0.1}}}
    (folder / "run.json").write_text(json.dumps(run, indent=2), encoding="utf-8")
    (tmp_path / "metrics" / "summary.json").write_text(json.dumps([run, run]), encoding="utf-8")
    (tmp_path / "metrics" / "broken.json").write_text("{not json", encoding="utf-8")
    (tmp_path / "metrics" / "other.json").write_text('{"a": 1}', encoding="utf-8")
    table = manifest.ordered(manifest.manifest(manifest.explode_runs(load_runs(spark, str(tmp_path / "metrics")))))
    rows = table.collect()
    assert [(r.model, r.train_domain, r.eval_name, r.eval_domain, r.eval_split, r.setting) for r in rows] == [
        ("logreg", "fpb", "fpb_test", "fpb", "test", "in_domain"), ("logreg", "fpb", "x", "unknown", "x", "cross_domain")]
    assert rows[0].metrics_path.endswith("deep/run.json")


def test_history_from_json(spark, tmp_path):
    log = {"log_history": [{"step": 10, "epoch": 1.0, "loss": 0.9}, {"step": 10, "epoch": 1.0, "eval_loss": 0.8, "eval_macro_f1": 0.3}]}
    (tmp_path / "h.json").write_text(json.dumps(log), encoding="utf-8")
    rows = load_history(spark, str(tmp_path)).collect()
    assert [(r.step, r.loss, r.eval_loss) for r in rows] == [(10, 0.9, None), (10, None, 0.8)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_split_writer_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([('a "q", b', "positive", "train"), ("c", "neutral", "test")], "text string, label string, split string")
    writers.write_splits(df, str(tmp_path / "s"), fmt)
    back = spark.read.parquet(str(tmp_path / "s" / "split=train")) if fmt == "parquet" else read_csv(spark, str(tmp_path / "s" / "split=train"))
    assert [(r.text, r.label) for r in back.collect()] == [('a "q", b', "positive")]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, end):
    """Records that run over lines and splits, stray quotes and blank lines: as a reader of the whole file has them."""
    rng, rows = random.Random(7), []
    bits = ["plain", "two\nlines", 'a "quoted" word', "\n\n", "comma, here", 'line\n"and, quote"\n', "x" * 300, "\n" * 20 + "end", 'ends in ""', "caf\xe9"]
    for i in range(1500):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 4)))
        if i == 700:
            text = "over many splits\n" + "long line, \"in quotes\"\n" * 900
        rows.append((str(i), text, rng.choice(["positive", "negative"])))
    for name, part in (("a", rows[:1000]), ("b", rows[1000:])):
        with open(tmp_path / f"{name}.csv", "w", encoding="utf-8", newline="") as file:
            writer = csv.writer(file, lineterminator=end)
            writer.writerow(["id", "text", "label"])
            for k, row in enumerate(part):
                writer.writerow(row)
                if k % 50 == 0:  # a blank line, and a quote in a bare cell that opens nothing
                    file.write(f'{end}x{row[0]},5" pipe,positive{end}')
    expected = []
    for name in "ab":
        with open(tmp_path / f"{name}.csv", encoding="utf-8", newline="") as file:
            expected.append([tuple(r) for r in list(csv.reader(file))[1:] if r])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        paths = {"train": str(tmp_path / "a.csv"), "validation": str(tmp_path / "b.csv")}
        assert spark.read.text(paths["train"]).rdd.getNumPartitions() > 8
        df = load_split_csvs(spark, paths, "d")
        got = [(r.row_number, r.id, r.text, r.label, r.split) for r in df.collect()]
        want = [(i + 1, *r) for i, r in enumerate(expected[0] + expected[1])]
        assert [g[:4] for g in sorted(got)] == want
        assert {g[4] for g in got[:]} == {"train", "validation"}
        labelled = load_labeled_csv(spark, paths["validation"]).orderBy("row_id").collect()
        assert [r.text for r in labelled] == [r[1].strip() for r in expected[1] if r[1].strip()]
        texts = load_texts(spark, list(paths.values())).orderBy("row_number").collect()
        assert [(r.row_number, r.text) for r in texts] == [(i + 1, t) for i, t in enumerate(r[1].strip() for r in expected[0] + expected[1] if r[1].strip())]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stray_quotes_leave_files_split(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('text,label\n5" pipe,positive\n"closed ""quote""",negative\n6",neutral\n', encoding="utf-8")
    assert not holds_line_breaks(spark, str(path))
    assert [r.text for r in read_csv(spark, str(path)).collect()] == ['5" pipe', 'closed "quote"', '6"']


def test_a_quote_that_stays_open_takes_the_rest(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text('text,label\nfine,positive\n"open,negative\nmore,neutral\n', encoding="utf-8")
    rows = read_csv(spark, str(path)).collect()
    assert sorted(r.text for r in rows)[0] == "fine" and len(rows) == 2
