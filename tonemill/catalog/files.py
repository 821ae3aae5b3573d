"""Sources and sinks: tables are written into the work folder as a source would hold them, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.catalog import inputs as I
from tonemill.catalog import lexicon as L
from tonemill.catalog import models as M
from tonemill.catalog import snippets as S
from tonemill.functions.tokens import build_stopwords, stopword_table
from tonemill.operators import lexicon, linear, manifest, metrics, ngrams, profile
from tonemill.runtime import shared_dir, work_table
from tonemill.sinks import writers
from tonemill.sources.corpus import load_stopwords, load_texts
from tonemill.sources.labeled import load_labeled_csv, read_csv
from tonemill.sources.lexicon import load_lexicon
from tonemill.sources.raw import load_delimited, load_registry, load_split_csvs
from tonemill.sources.runs import load_history, load_runs


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


def _in_order(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to files by key, so that the order of files and lines is that of the keys."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


def _csv(df: DataFrame, path: str) -> str:
    quoted = {"header": True, "escape": '"', "quoteAll": True, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**quoted).csv(path)
    return path


def _counted(df: DataFrame, *names: str) -> DataFrame:
    """Rows by content; texts by their md5."""
    return df.groupBy(*[F.md5("text").alias("text_md5") if n == "text" else n for n in names]).agg(F.count("*").alias("rows"))


def _word(label: Column) -> Column:
    """Other spellings of the labels."""
    return F.when(label == "positive", " Bullish").when(label == "negative", "NEG").otherwise("0")


def labeled_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.labelled_documents(spark, sf).select("text", _word(F.col("label")).alias("label"))
    path = _csv(docs, _folder(spark, "labeled"))
    return _counted(load_labeled_csv(spark, path), "text", "label")


def _line(text: str) -> Column:
    """A text as one line, without the delimiter."""
    return F.translate(text, "\r\n@", "  #")


def delimited_files(spark: SparkSession, sf: str) -> DataFrame:
    """Latin-1 lines of text and label; documents without a label have no delimiter."""
    docs = I.table(spark, sf, "documents").join(I.labelled_documents(spark, sf).select("doc_id", "label"), "doc_id", "left")
    line = F.concat(_line("text"), F.coalesce(F.concat(F.lit("@"), "label"), F.lit("")))
    latin = F.encode(line, "ISO-8859-1").cast("string").alias("value")
    path = _folder(spark, "delimited")
    _in_order(docs.select("doc_id", latin), "doc_id").select("value").write.text(path)
    lines = load_delimited(spark, path, "docs", "all")
    return lines.select("line_number", F.md5("text").alias("text_md5"), "label", "parse_ok", "dataset", "split")


def split_files(spark: SparkSession, sf: str) -> DataFrame:
    """Two CSV files of a registry's corpus, numbered through."""
    docs = I.labelled_documents(spark, sf).select("doc_id", "text", "label", I.domain(F.col("lang")).alias("domain"))
    paths = {}
    for name in I.DOMAINS:
        part = _in_order(docs.where(F.col("domain") == name), "doc_id").select("text", "label")
        paths[name] = _csv(part, _folder(spark, name))
    corpus = load_registry(spark, {"pair": lambda s: load_split_csvs(s, paths, "pair")})["pair"]
    return corpus.select("row_number", F.md5("text").alias("text_md5"), "label", "split", "dataset")


def corpus_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 11 != 3, F.col("text")).alias("text"))
    path = _csv(_in_order(docs, "doc_id").select("text"), _folder(spark, "corpus"))
    return load_texts(spark, [path]).select("row_number", F.md5("text").alias("text_md5"))


STOP = ["The", "of", "and", "de", "la"]


def stopword_files(spark: SparkSession, sf: str) -> DataFrame:
    """Top bigrams without the stop-words of a file."""
    path = _folder(spark, "stopwords")
    spark.createDataFrame([(f" {w} ",) for w in STOP], "value string").write.text(path)
    stop = stopword_table(spark, False, load_stopwords(spark, path))
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return ngrams.top_ngrams(docs, "doc_id", 2, 50, stop)


def lexicon_files(spark: SparkSession, sf: str) -> DataFrame:
    return load_lexicon(spark, _csv(L._learned(spark, sf), _folder(spark, "lexicon")), threshold=3)


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """(run_name, eval_name, doc_id, label, prediction) of the lexicon on both domains, through the prediction sink."""
    path = _folder(spark, "predictions")
    rows = L._scored(spark, sf).select(F.lit("lexicon").alias("run_name"), "eval_name", "doc_id", "label", "prediction")
    writers.write_predictions(rows, path)
    return spark.read.parquet(path)


def prediction_files(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf).select("run_name", "eval_name", "doc_id", "label", "prediction")


def run_files(spark: SparkSession, sf: str) -> DataFrame:
    """A run's document, written, found and exploded."""
    summary = metrics.evaluation_summary(_evaluated(spark, sf), ["eval_name"])
    summary = summary.withColumn("path", F.format_string("data/%s/test.csv", "eval_name"))
    fields = F.struct(*[c for c in summary.columns if c != "eval_name"])
    document = summary.agg(F.map_from_entries(F.collect_list(F.struct("eval_name", fields))).alias("eval_sets")).select(
        F.lit("lexicon").alias("run_name"), F.lit("words").alias("model_type"), F.lit("data/en/train.csv").alias("train_path"), "eval_sets"
    )
    path = _folder(spark, "runs")
    writers.write_json(document, path)
    table = manifest.manifest(manifest.explode_runs(load_runs(spark, path)))
    rounded = {c: F.round(c, 6) for c in ("accuracy", "macro_f1", "weighted_f1")}
    return table.withColumns(rounded).select("run_name", "model", "train_domain", "eval_name", "eval_domain", "setting", *rounded)


def history_files(spark: SparkSession, sf: str) -> DataFrame:
    """A training log with a row for each label class, step and mean loss of the vectors."""
    steps = I.table(spark, sf, "embeddings").groupBy((F.col("label") * 10).cast("long").alias("step")).agg(
        F.round(F.avg(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))), 6).alias("loss")
    )
    log = steps.agg(F.array_sort(F.collect_list(F.struct("step", "loss"))).alias("log_history"))
    path = _folder(spark, "history")
    writers.write_json(log, path)
    return load_history(spark, path).select("step", "loss", "eval_loss")


def table_files(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion matrix and summary of the evaluation as CSV: one row a file row."""
    scored = _evaluated(spark, sf)
    confusion, summary = _folder(spark, "confusion"), _folder(spark, "summary")
    writers.write_confusion(metrics.confusion_matrix(scored, ["eval_name"]), confusion)
    writers.write_csv(metrics.evaluation_summary(scored, ["eval_name"]).select("eval_name", "size", "accuracy"), summary)
    cells = read_csv(spark, confusion).select("eval_name", "label", *[F.col(c).cast("long").alias(c) for c in S.LABELS])
    sizes = read_csv(spark, summary).select("eval_name", F.col("size").cast("long").alias("size"), F.round(F.col("accuracy").cast("double"), 6).alias("accuracy"))
    return cells.join(sizes, "eval_name")


def division_files(spark: SparkSession, sf: str) -> DataFrame:
    """The split writer: each split's folder read by itself."""
    path = _folder(spark, "splits")
    writers.write_splits(M.divided(spark, sf).select("doc_id", "text", "label", "split"), path)
    parts = [spark.read.parquet(f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", F.md5("text").alias("text_md5"), "label", "split")


def model_files(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a model that was saved and loaded, with all its scores."""
    train, evals = M._train_and_evals(spark, sf)
    path = _folder(spark, "model")
    writers.save_model(linear.fit(linear.build_features(train, M.KEYS, M.CONFIG), {"type": "naive_bayes"}), path)
    scored = linear.score(evals, writers.load_model(spark, path), ["eval_name", "doc_id"], carry=["label"])
    return scored.withColumns({n: F.round(n, 6) for n, t in scored.dtypes if t == "double"})


def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and labels of both domains in their reports, and rows in the comparison, written and read as text."""
    docs = I.labelled_documents(spark, sf).select(I.domain(F.col("lang")).alias("dataset"), "text", "label")
    lengths = work_table(profile.length_table(docs, ["dataset", "label"]), "lengths")
    totals = lengths.where(F.col("feature") == profile.LENGTHS[0]).groupBy("dataset", "label").agg(F.sum("n").alias("count"))
    everything = totals.groupBy("dataset").agg(F.sum("count").alias("all"))
    shares = totals.join(everything, "dataset").select("dataset", "label", "count", F.round(F.col("count") / F.col("all"), 4).alias("ratio"))
    summary = profile.summary_rows(lengths, ["dataset"])
    reports, comparison = _folder(spark, "report"), _folder(spark, "comparison")
    writers.write_report(writers.report_lines(summary, shares, "dataset"), "dataset", reports)
    writers.write_report(writers.comparison_lines(summary, "dataset", list(I.DOMAINS)), "dataset", comparison)
    lines = spark.read.text(reports).unionByName(spark.read.text(comparison)).select("dataset", F.col("value").alias("line"))
    return lines.where("line LIKE '#%' OR line LIKE '- num rows: %' OR line LIKE '- positive: %' OR line LIKE '- neutral: %' OR line LIKE '- negative: %'")


QUERIES = {f.__name__: f for f in (
    labeled_files, delimited_files, split_files, corpus_files, stopword_files, lexicon_files, prediction_files, run_files,
    history_files, table_files, division_files, model_files, report_files,
)}

_STOP = build_stopwords(False, STOP)
_GRAMS = f"""t AS (SELECT doc_id, {S.count_tokens('text', _STOP)} AS t FROM documents),
g AS (SELECT doc_id, i, t[i] || ' ' || t[i + 1] AS ngram FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM t))"""
_SIZES = "SELECT eval_name, count(*) AS size, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END)::DOUBLE, 6) AS accuracy FROM ev GROUP BY eval_name"
_THREE = S.rounded_metrics(("accuracy", "macro_f1", "weighted_f1"))

ORACLES = {
    "labeled_files": f"WITH {I.LABELLED} SELECT md5({S.strip('text')}) AS text_md5, label, count(*) AS rows FROM labelled GROUP BY ALL",
    "delimited_files": f"""
        WITH {I.LABELLED}, l AS (
          SELECT row_number() OVER (ORDER BY d.doc_id) AS line_number, translate(d.text, chr(13) || chr(10) || '@', '  #') AS text, label
          FROM documents d LEFT JOIN labelled USING (doc_id))
        SELECT line_number, md5(text) AS text_md5, label, label IS NOT NULL AS parse_ok, 'docs' AS dataset, 'all' AS split FROM l""",
    "split_files": f"""
        WITH {I.LABELLED}
        SELECT row_number() OVER (ORDER BY {I.DOMAIN}, doc_id) AS row_number, md5(text) AS text_md5, label, {I.DOMAIN} AS split, 'pair' AS dataset
        FROM labelled""",
    "corpus_files": f"SELECT row_number() OVER (ORDER BY doc_id) AS row_number, md5({S.strip('text')}) AS text_md5 FROM documents WHERE doc_id % 11 <> 3",
    "stopword_files": f"""
        WITH {_GRAMS} SELECT ngram, count(*) AS count FROM g GROUP BY ngram
        ORDER BY count(*) DESC, min(doc_id::HUGEINT * 2147483648 + i) LIMIT 50""",
    "lexicon_files": f"WITH {I.LABELLED}, {L._LEARNED} SELECT word, positive, negative FROM learned",
    "prediction_files": f"WITH {I.LABELLED}, {L.LEX}, {L.scored_cte('labelled', 'lex')} SELECT 'lexicon' AS run_name, {I.DOMAIN} AS eval_name, doc_id, label, prediction FROM scored",
    "run_files": f"""
        {L._EVAL}
        SELECT 'lexicon' AS run_name, 'words' AS model, 'en' AS train_domain, eval_name, eval_name AS eval_domain,
               CASE WHEN eval_name = 'en' THEN 'in_domain' ELSE 'cross_domain' END AS setting, {_THREE} FROM ({S.evaluation('ev', 'eval_name')})""",
    "history_files": """
        SELECT (label * 10)::BIGINT AS step, round(avg(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE)))), 6) AS loss, NULL::DOUBLE AS eval_loss
        FROM embeddings GROUP BY label""",
    "table_files": f"""
        {L._EVAL}, c AS ({L.ORACLES['confusion_matrix'].replace(L._EVAL, '')}), s AS ({_SIZES})
        SELECT * FROM c JOIN s USING (eval_name)""",
    "division_files": f"WITH {I.LABELLED}, {M._SPLIT} SELECT doc_id, md5(text) AS text_md5, label, split FROM divided",
    "model_files": M.ORACLES["nb_predict"],
    "report_files": f"""
        WITH {I.LABELLED}, n AS (SELECT {I.DOMAIN} AS dataset, label, count(*) AS n FROM labelled GROUP BY ALL),
        t AS (SELECT dataset, sum(n)::BIGINT AS total FROM n GROUP BY dataset)
        SELECT dataset, '- num rows: ' || total AS line FROM t
        UNION ALL SELECT dataset, printf('- %s: %d rows, %.2f%%', label, n, round(n / total, 4) * 100) FROM n JOIN t USING (dataset)
        UNION ALL SELECT dataset, unnest(['# ' || dataset, '## Statistics', '## Labels']) FROM t
        UNION ALL SELECT 'en and other', '# en and other'
        UNION ALL SELECT 'en and other', printf('- num rows: en %d, other %d; most in %s', e.total, o.total,
                         CASE WHEN e.total = o.total THEN 'en, other' WHEN e.total > o.total THEN 'en' ELSE 'other' END)
        FROM t e, t o WHERE e.dataset = 'en' AND o.dataset = 'other'""",
}
