"""Label and text projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.catalog import inputs as I
from tonemill.catalog import snippets as S
from tonemill.functions import labels, text, tokens


def label_normalize(spark: SparkSession, sf: str) -> DataFrame:
    df = I.table(spark, sf, "labels")
    number = F.concat(F.lit(" "), (F.col("quality") - F.col("toxic")).cast("string"), F.lit("\xa0"))
    word = F.when(F.col("toxic") == 1, " BEARISH").when(F.col("quality") == 1, "Pos").otherwise("mixed\t")
    return df.select(
        "doc_id",
        labels.normalize_label(number).alias("from_number"),
        labels.normalize_label(word).alias("from_word"),
        labels.word_label(word).alias("word"),
    )


def label_decode_int(spark: SparkSession, sf: str) -> DataFrame:
    return I.labelled_documents(spark, sf).select("doc_id", "label")


def label_override(spark: SparkSession, sf: str) -> DataFrame:
    overrides = {" EN ": "Positive", "fr": "neutral", "de": "negative", "1": "neutral"}
    mapped = I.table(spark, sf, "documents").select(
        "lang", labels.normalize_label(F.upper("lang"), overrides).alias("label")
    )
    return mapped.groupBy("lang", "label").agg(F.count("*").alias("n"))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    df = I.noisy_documents(spark, sf)
    return df.select(
        "doc_id",
        text.clean_text(F.col("text")).alias("cleaned"),
        F.md5(text.clean_text(F.col("text"), remove_urls=False)).alias("with_urls"),
    )


def fix_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return I.noisy_documents(spark, sf).select("doc_id", text.fix_encoding(F.col("text")).alias("repaired"))


def text_features(spark: SparkSession, sf: str) -> DataFrame:
    return text.add_text_features(I.noisy_documents(spark, sf)).drop("text", "lang")


def count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = I.noisy_documents(spark, sf).select("doc_id", tokens.count_tokens(F.col("text"), ["the", "of", "la"]).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


QUERIES = {f.__name__: f for f in (
    label_normalize, label_decode_int, label_override, clean_text, fix_encoding, text_features, count_tokens,
)}

_F = ", ".join(f"{sql} AS {name}" for name, sql in S.features("text_stripped").items())

ORACLES = {
    "label_normalize": """
        SELECT doc_id,
               CASE quality - toxic WHEN 1 THEN 'positive' WHEN 0 THEN 'neutral' WHEN -1 THEN 'negative' END AS from_number,
               CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS from_word,
               CASE WHEN toxic = 1 THEN 'bearish' WHEN quality = 1 THEN 'pos' ELSE 'mixed' END AS word
        FROM labels""",
    "label_decode_int": f"WITH {I.LABELLED} SELECT doc_id, label FROM labelled",
    "label_override": """
        SELECT lang, CASE lang WHEN 'en' THEN 'positive' WHEN 'fr' THEN 'neutral' WHEN 'de' THEN 'negative' END AS label,
               count(*) AS n
        FROM documents GROUP BY 1, 2""",
    "clean_text": f"""
        WITH {I.NOISY}
        SELECT doc_id, {S.clean('text')} AS cleaned,
               md5({S.strip(f"regexp_replace({S.strip('text')}, '[{S.WS}]{{2,}}', ' ', 'g')")}) AS with_urls
        FROM noisy""",
    "fix_encoding": f"WITH {I.NOISY} SELECT doc_id, {S.repair('text')} AS repaired FROM noisy",
    "text_features": f"""
        WITH {I.NOISY}, s AS (SELECT doc_id, {S.strip('text')} AS text_stripped FROM noisy)
        SELECT * REPLACE (char_length::INT AS char_length, word_count::INT AS word_count)
        FROM (SELECT doc_id, text_stripped, {_F} FROM s)""",
    "count_tokens": f"""
        WITH {I.NOISY}, t AS (SELECT doc_id, {S.count_tokens('text', ['the', 'of', 'la'])} AS t FROM noisy)
        SELECT doc_id, len(t) AS n, coalesce(array_to_string(t, ' '), '') AS tokens FROM t""",
}
