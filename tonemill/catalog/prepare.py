"""Cleaning, deduplication, splits and row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.catalog import inputs as I
from tonemill.catalog import snippets as S
from tonemill.functions.labels import decode_label
from tonemill.operators import cleaning, splits
from tonemill.plans.prepare import Prepared, prepare_coded, prepare_word_labelled
from tonemill.sources.numbering import number_rows
from tonemill.sources.raw import parse_delimited


def clean_dedup(spark: SparkSession, sf: str) -> DataFrame:
    distinct = cleaning.distinct_texts(I.mixed_rows(spark, sf), "row_id", repair=True)
    return cleaning.kept_rows(distinct).select("row_id", "label", F.md5("text").alias("text_md5"))


def clean_stats(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_stats(cleaning.distinct_texts(I.mixed_rows(spark, sf), "row_id", repair=True))


def parse_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = I.mixed_rows(spark, sf).select(
        "row_id", F.concat("text", F.coalesce(F.concat(F.lit("@"), "label"), F.lit(""))).alias("raw_line")
    )
    parsed = parse_delimited(lines)
    return parsed.select("row_id", F.md5("text").alias("text_md5"), "label", "parse_ok")


CODES = ["0", "1", "2", "1.0", " 2", "1.7", "x", "-1", "3", None]


def decode_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, fractions, words and gaps as label codes, one to each document."""
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("doc_id") % len(CODES) + 1).cast("int"))
    docs = I.table(spark, sf, "documents").select("doc_id", code.alias("code"))
    return docs.select("doc_id", "code", decode_label(F.col("code")).alias("label"))


def row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return number_rows(I.mixed_rows(spark, sf).select("row_id"), "row_id", "row_number")


def stratified_split_70_15_15(spark: SparkSession, sf: str) -> DataFrame:
    df = I.labelled_documents(spark, sf).select("doc_id", "label")
    return splits.stratified_split(df, "doc_id", "label", ["train", "val", "test"], [0.30, 0.50])


def _official(spark: SparkSession, sf: str) -> DataFrame:
    df = I.labelled_documents(spark, sf)
    part = F.when(F.col("lang").isin("en", "fr"), "train").otherwise("validation")
    return df.select("doc_id", "label", part.alias("split"))


def holdout_split_15(spark: SparkSession, sf: str) -> DataFrame:
    return splits.holdout_split(_official(spark, sf), "doc_id", "label")


def head_tail_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.head_tail_split(I.table(spark, sf, "documents").select("doc_id"), "doc_id", 0.05)


def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.split_summary(stratified_split_70_15_15(spark, sf))
    return rows.withColumn("level", F.col("level").cast("int"))


def prepared_corpora(spark: SparkSession, sf: str) -> list[Prepared]:
    """Both corpora of the preparation job, from the documents and their labels."""
    docs = I.noisy_documents(spark, sf).join(I.table(spark, sf, "labels"), "doc_id")
    word = F.when(F.col("toxic") == 1, " Negative").when(F.col("quality") == 1, "POSITIVE ").otherwise("neutral")
    lines = parse_delimited(
        docs.select(F.col("doc_id").alias("line_number"), F.concat("text", F.lit("@"), word).alias("raw_line"))
    )
    coded = docs.select(
        F.col("doc_id").alias("row_number"),
        "text",
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1).otherwise(2).alias("label"),
        F.when(F.col("lang").isin("en", "fr"), "train").otherwise("validation").alias("split"),
    )
    return [prepare_word_labelled(lines, "words"), prepare_coded(coded, "codes")]


def prepare_report(spark: SparkSession, sf: str) -> DataFrame:
    """(dataset, part, name, value): cleaning counts per part, then label counts per split."""
    parts = []
    for corpus in prepared_corpora(spark, sf):
        named = F.lit(corpus.dataset).alias("dataset")
        counts = [c for c in corpus.stats.columns if c != "part"]
        stats = corpus.stats.unpivot(["part"], counts, "name", "value")
        labels = corpus.rows.groupBy(F.col("split").alias("part"), F.col("label").alias("name")).agg(
            F.count("*").alias("value")
        )
        parts.append(stats.unionByName(labels).select(named, "part", "name", "value"))
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (
    clean_dedup, clean_stats, parse_lines, decode_codes, row_numbers, stratified_split_70_15_15, holdout_split_15,
    head_tail_split, split_summary, prepare_report,
)}

_CLEANED = f"{I.MIXED}, cleaned AS (SELECT row_id, label, {S.clean(S.repair('text'))} AS text FROM mixed)"
_RANKED = f"""{_CLEANED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY row_id) AS rn FROM cleaned)"""
_SPLIT = S.split_ctes("labelled", "divided", "doc_id", ["train", "val", "test"], [0.30, 0.50])
_HOLD = S.split_ctes("labelled", "cut", "doc_id", ["train", "test"], [0.15], where="lang IN ('en', 'fr')")


def _stats(source: str, part: str) -> str:
    return f"""
      SELECT {part} AS part, count(*) AS rows_before, count(*) FILTER (WHERE text = '') AS empty_after_clean,
             count(*) FILTER (WHERE text <> '' AND rn > 1) AS duplicates_removed,
             count(*) FILTER (WHERE text <> '' AND rn = 1) AS rows_after
      FROM {source} GROUP BY 1"""


_REPORT = f"""
WITH {I.NOISY}, base AS (
  SELECT doc_id, lang, text,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
         CASE WHEN lang IN ('en', 'fr') THEN 'train' ELSE 'validation' END AS official
  FROM noisy JOIN labels USING (doc_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY doc_id) AS rn
      FROM (SELECT doc_id, label, {S.clean(S.repair('text'))} AS text FROM base)),
c AS (SELECT *, row_number() OVER (PARTITION BY text, label, official ORDER BY doc_id) AS rn
      FROM (SELECT doc_id, label, official, {S.clean('text')} AS text FROM base)),
wk AS (SELECT doc_id, label FROM w WHERE rn = 1 AND text <> ''),
ck AS (SELECT doc_id, label, official FROM c WHERE rn = 1 AND text <> ''),
{S.split_ctes('wk', 'ws', 'doc_id', ['train', 'val', 'test'], [0.30, 0.50])},
{S.split_ctes('ck', 'cs', 'doc_id', ['train', 'test'], [0.15], where="official = 'train'")},
stats AS (
  SELECT 'words' AS dataset, * FROM ({_stats('w', "'all'")})
  UNION ALL SELECT 'codes', * FROM ({_stats('c', 'official')}))
SELECT dataset, part, name, value FROM (UNPIVOT stats ON rows_before, empty_after_clean, duplicates_removed, rows_after
                                        INTO NAME name VALUE value)
UNION ALL SELECT 'words', split, label, count(*) FROM ws GROUP BY split, label
UNION ALL SELECT 'codes', split, label, count(*) FROM cs GROUP BY split, label
UNION ALL SELECT 'codes', 'val', label, count(*) FROM ck WHERE official = 'validation' GROUP BY label
"""

ORACLES = {
    "clean_dedup": f"WITH {_RANKED} SELECT row_id, label, md5(text) AS text_md5 FROM ranked WHERE rn = 1 AND text <> ''",
    "clean_stats": f"WITH {_RANKED} SELECT * EXCLUDE (part) FROM ({_stats('ranked', '1')})",
    "parse_lines": f"""
        WITH {I.MIXED}, l AS (
          SELECT row_id, text || coalesce('@' || label, '') AS line FROM mixed),
        p AS (SELECT *, {S.strip('line')} <> '' AND contains(line, '@') AS ok,
                     len(string_split(line, '@')) AS pieces FROM l)
        SELECT row_id, md5(CASE WHEN {S.strip('line')} = '' THEN ''
                                WHEN ok THEN array_to_string(string_split(line, '@')[:pieces - 1], '@') ELSE line END) AS text_md5,
               CASE WHEN ok THEN string_split(line, '@')[pieces] END AS label, ok AS parse_ok
        FROM p""",
    "decode_codes": """
        WITH c AS (SELECT doc_id, (['0', '1', '2', '1.0', ' 2', '1.7', 'x', '-1', '3', NULL])[doc_id % 10 + 1] AS code FROM documents)
        SELECT doc_id, code, CASE try_cast(code AS DOUBLE) WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'neutral' END AS label FROM c""",
    "row_numbers": f"WITH {I.MIXED} SELECT row_id, row_number() OVER (ORDER BY row_id) AS row_number FROM mixed",
    "stratified_split_70_15_15": f"WITH {I.LABELLED}, {_SPLIT} SELECT doc_id, label, split FROM divided",
    "holdout_split_15": f"""
        WITH {I.LABELLED}, {_HOLD}
        SELECT doc_id, label, split FROM cut
        UNION ALL SELECT doc_id, label, 'val' FROM labelled WHERE lang NOT IN ('en', 'fr')""",
    "head_tail_split": """
        SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <=
                                 floor((SELECT count(*) FROM documents)::DOUBLE * (1::DOUBLE - 0.05::DOUBLE))
                            THEN 'train' ELSE 'val' END AS split
        FROM documents""",
    "split_summary": f"""
        WITH {I.LABELLED}, {_SPLIT}
        SELECT split, label, count(*) AS rows, grouping(split, label)::INT AS level
        FROM divided GROUP BY ROLLUP (split, label)""",
    "prepare_report": _REPORT,
}
