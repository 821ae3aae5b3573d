"""Corpus profiles and their comparison, for any number of corpora at once."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.functions.text import add_text_features, strip
from tonemill.functions.tokens import build_stopwords, stopword_table
from tonemill.operators import ngrams, profile
from tonemill.runtime import work_table
from tonemill.sinks import writers

CORPUS = "dataset"


@dataclass(frozen=True)
class Profile:
    columns: dict[str, list[str]]  # dataset -> its columns with the text features
    summary: DataFrame  # (dataset, stat, value)
    distribution: DataFrame  # (dataset, label, count, ratio)
    by_label: DataFrame  # (dataset, label, feature, rows, mean, median, min, max)
    histogram: DataFrame
    box_plot: DataFrame
    top_ngrams: dict[str, DataFrame]  # dataset -> (size, rank, ngram, count)
    missing: dict[str, DataFrame]
    duplicates: DataFrame  # (dataset, duplicate_rows, duplicate_texts)


def profile_corpora(
    corpora: dict[str, DataFrame],
    key: str,
    top_k: int = 20,
    remove_stopwords: bool = False,
    extra_stopwords: Iterable[str] | DataFrame = (),
) -> Profile:
    """Profile corpora with (key, text, label). One scan fills the length table all statistics come from."""
    if isinstance(extra_stopwords, DataFrame):
        stop = stopword_table(extra_stopwords.sparkSession, remove_stopwords, extra_stopwords)
    else:
        stop = build_stopwords(remove_stopwords, extra_stopwords)
    lengths, texts = None, None
    for name, df in corpora.items():
        filled = F.coalesce("text", F.lit(""))
        labelled = df.withColumns({CORPUS: F.lit(name), "text": filled, "label": F.col("label").cast("string")})
        part = profile.length_table(labelled, [CORPUS, "label"])
        lengths = part if lengths is None else lengths.unionByName(part)
        stripped = labelled.select(CORPUS, strip(F.col("text")).alias("text"))
        whole_rows = profile.duplicate_count(labelled, df.columns, [CORPUS])
        same_text = profile.duplicate_count(stripped, ["text"], [CORPUS])
        duplicates = whole_rows.withColumnRenamed("duplicates", "duplicate_rows").join(
            same_text.withColumnRenamed("duplicates", "duplicate_texts"), CORPUS
        )
        texts = duplicates if texts is None else texts.unionByName(duplicates)
    lengths = work_table(lengths, "lengths")
    rows = lengths.where(F.col("feature") == profile.LENGTHS[0])
    totals = rows.groupBy(CORPUS, "label").agg(F.sum("n").alias("count"))
    everything = totals.groupBy(CORPUS).agg(F.sum("count").alias("_total"))
    distribution = (
        totals.join(F.broadcast(everything), CORPUS)
        .withColumn("ratio", F.round(F.col("count") / F.col("_total"), 4))
        .drop("_total")
    )
    texts = work_table(texts, "duplicates")
    copies = texts.unpivot([CORPUS], ["duplicate_rows", "duplicate_texts"], "stat", "value")
    widths = [F.struct(F.lit(n).alias(CORPUS), F.lit(len(features_of(df))).alias("value")) for n, df in corpora.items()]
    columns = texts.agg(F.lit("num_columns").alias("stat")).select(F.inline(F.array(*widths)), "stat")
    extra = copies.unionByName(columns).withColumn("value", F.col("value").cast("double"))
    return Profile(
        columns={n: features_of(df) for n, df in corpora.items()},
        summary=profile.summary_rows(lengths, [CORPUS]).unionByName(extra),
        distribution=distribution,
        by_label=profile.length_stats(lengths, [CORPUS, "label"]),
        histogram=profile.histogram(lengths, [CORPUS]),
        box_plot=profile.box_plot(lengths, [CORPUS, "label"]),
        top_ngrams={n: ngrams.top_ngram_table(df, key, [1, 2, 3], top_k, stop) for n, df in corpora.items()},
        missing={
            n: profile.missing_values(df.withColumn("text", F.coalesce("text", F.lit("")))) for n, df in corpora.items()
        },
        duplicates=texts,
    )


def features_of(df: DataFrame) -> list[str]:
    return add_text_features(df).columns


def write_profile(result: Profile, path: str) -> None:
    """Tables as CSV, report lines as Markdown, the comparison as one wide CSV and as Markdown."""
    writers.write_csv(result.distribution.orderBy(CORPUS, F.desc("count")), f"{path}/label_distribution")
    writers.write_csv(result.by_label.orderBy(CORPUS, "label", "feature"), f"{path}/length_by_label")
    writers.write_csv(result.histogram.orderBy(CORPUS, "feature", "bin"), f"{path}/histogram")
    writers.write_csv(result.box_plot.orderBy(CORPUS, "label", "feature"), f"{path}/box_plot")
    writers.write_csv(result.duplicates, f"{path}/duplicates")
    for name, table in result.top_ngrams.items():
        writers.write_csv(table.orderBy("size", "rank"), f"{path}/top_ngrams/{name}")
    for name, table in result.missing.items():
        writers.write_csv(table, f"{path}/missing/{name}")
    writers.write_json(result.summary.groupBy(CORPUS).agg(
        F.map_from_entries(F.collect_list(F.struct("stat", "value"))).alias("stats")), f"{path}/summary")
    writers.write_report(writers.report_lines(result.summary, result.distribution, CORPUS, result.columns), CORPUS, f"{path}/report")
    names = list(result.top_ngrams)
    writers.write_csv(profile.compare(result.summary, CORPUS, names).orderBy("stat"), f"{path}/comparison")
    writers.write_report(writers.comparison_lines(result.summary, CORPUS, names), CORPUS, f"{path}/comparison_report")
