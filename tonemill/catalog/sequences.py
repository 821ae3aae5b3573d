"""Logits, batch inference, fixed-length encoding and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.catalog import inputs as I
from tonemill.catalog import snippets as S
from tonemill.operators import encoding, inference, metrics
from tonemill.plans.pretraining import masked_corpus
from tonemill.runtime import work_table

WORDS = 5000
LENGTH = 128


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    vectors = I.table(spark, sf, "embeddings")
    return vectors.select("vec_id", (F.col("label") % 3).alias("truth"), I.logits().alias("logits"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n, t in df.dtypes if t == "double"})


def logits_to_probs(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(inference.classify_logits(_logits(spark, sf)).drop("logits", "truth"))


def logit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.logit_metrics(_logits(spark, sf), [], "truth", "logits"))


def batch_inference(spark: SparkSession, sf: str) -> DataFrame:
    """A linear model: class c sums the vector's dimensions c, c + 3, c + 6, ..."""

    # Nested, so that it is shipped by value and executors need no copy of this package.
    def make_scorer():
        def predict(vectors):
            import numpy as np

            wide = vectors.astype(np.float64)
            return np.stack([wide[:, c::3].sum(axis=1) for c in range(3)], axis=1)

        return predict

    vectors = I.table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = inference.batch_logits(vectors, make_scorer, ["embedding"], [[64]])
    return _rounded(inference.classify_logits(scored).drop("embedding", "logits"))


def word_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.fit_word_ids(I.table(spark, sf, "documents"), WORDS).withColumn("id", F.col("id").cast("long"))


def _joined(array: str) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), " ").alias(array)


def encode_fixed_length(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.labelled_documents(spark, sf)
    words = encoding.fit_word_ids(I.table(spark, sf, "documents"), WORDS)
    encoded = encoding.encode(docs, ["doc_id"], words, LENGTH, carry=["label"], max_words=WORDS)
    return encoded.select(
        "doc_id", encoding.label_ids(F.col("label")).alias("label_id"), _joined("input_ids"), _joined("attention_mask")
    )


def mask_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.table(spark, sf, "documents")
    words = work_table(encoding.fit_word_ids(docs, WORDS), "words")
    encoded = encoding.encode(docs, ["doc_id"], words, LENGTH, max_words=WORDS)
    masked = encoding.mask_tokens(encoded, "doc_id", words.count() + C.FIRST_WORD_ID)
    return masked.select("doc_id", _joined("input_ids"), _joined("targets"))


def mlm_corpus(spark: SparkSession, sf: str) -> DataFrame:
    texts = I.table(spark, sf, "documents").select(F.col("doc_id").alias("row_number"), "text")
    examples = masked_corpus(texts, max_words=WORDS, max_length=LENGTH)
    masked = F.size(F.filter("targets", lambda t: t != C.IGNORED_TARGET))
    return examples.groupBy("split").agg(
        F.count("*").alias("texts"),
        F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("tokens"),
        F.sum(masked).alias("masked"),
        F.sum(F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("id_sum"),
    )


QUERIES = {f.__name__: f for f in (
    logits_to_probs, logit_metrics, batch_inference, word_ids, encode_fixed_length, mask_tokens, mlm_corpus,
)}

_LOGITS = f"logits AS (SELECT vec_id, {I.LOGITS}, label % 3 AS truth FROM embeddings)"
_CLASS = "CASE WHEN a >= b AND a >= c THEN 'positive' WHEN b >= c THEN 'neutral' ELSE 'negative' END"
_TOP = "greatest(a, b, c)"
_SUM = f"(exp(a - {_TOP}) + exp(b - {_TOP}) + exp(c - {_TOP}))"
_PROBS = ", ".join(f"round(exp({x} - {_TOP}) / {_SUM}, 6) AS prob_{n}" for x, n in zip("abc", S.LABELS))

TOKEN = rf"[{S.WORD}]+|[^{S.WORD}{S.WS}]"
_IDS = f"""ids AS (
  SELECT word, row_number() OVER (ORDER BY n DESC, word) + 4 AS id
  FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM documents)
        GROUP BY word ORDER BY n DESC, word LIMIT {WORDS}))"""


def _encoded(source: str, keep: str) -> str:
    return f"""tok AS (SELECT {keep}, regexp_extract_all(lower(text), '{TOKEN}')[:{LENGTH - 2}] AS t FROM {source}),
pos AS (SELECT doc_id, i, t[i] AS word FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM tok)),
seq AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY i) AS s FROM pos LEFT JOIN ids USING (word) GROUP BY doc_id),
enc AS (
  SELECT tok.* EXCLUDE (t), list_concat([2], coalesce(s, []), [3], list_transform(range(len(coalesce(s, [])), {LENGTH - 2}), lambda x: 0)) AS input_ids,
         list_transform(range(0, {LENGTH}), lambda x: CASE WHEN x < len(coalesce(s, [])) + 2 THEN 1 ELSE 0 END) AS attention_mask
  FROM tok LEFT JOIN seq USING (doc_id))"""


_MASKED = f"""drawn AS (
  SELECT doc_id, i, input_ids[i + 1] AS x, md5('42|' || doc_id || '|' || i) AS h
  FROM (SELECT doc_id, input_ids, unnest(range(0, {LENGTH})) AS i FROM enc)),
chosen AS (SELECT *, (x >= 5 OR x = 1) AND h[1:8] < '{int(0.15 * 2**32):08x}' AS picked FROM drawn),
masked AS (
  SELECT doc_id, i, CASE WHEN picked THEN x ELSE -100 END AS target,
         CASE WHEN NOT picked THEN x WHEN h[9:16] < '{int(0.8 * 2**32):08x}' THEN 4
              WHEN h[9:16] < '{int(0.9 * 2**32):08x}' THEN ('0x' || h[17:24])::BIGINT % (SELECT count(*) + 5 FROM ids) ELSE x END AS id
  FROM chosen)"""

ORACLES = {
    "logits_to_probs": f"WITH {_LOGITS} SELECT vec_id, {_CLASS} AS prediction, {_PROBS} FROM logits",
    "logit_metrics": f"""
        WITH {_LOGITS}, ev AS (SELECT 1 AS g, CASE truth WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS label,
                                      {_CLASS} AS prediction FROM logits)
        SELECT size, {S.rounded_metrics(("accuracy", "macro_f1", "weighted_f1"))} FROM ({S.evaluation('ev', 'g')})""",
    "batch_inference": f"WITH {_LOGITS} SELECT vec_id, {_CLASS} AS prediction, {_PROBS} FROM logits",
    "word_ids": f"WITH {_IDS} SELECT word, id FROM ids",
    "encode_fixed_length": f"""
        WITH {I.LABELLED}, {_IDS}, {_encoded('labelled', 'doc_id, label')}
        SELECT doc_id, CASE label WHEN 'positive' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS label_id,
               array_to_string(input_ids, ' ') AS input_ids, array_to_string(attention_mask, ' ') AS attention_mask
        FROM enc""",
    "mask_tokens": f"""
        WITH {_IDS}, {_encoded('documents', 'doc_id')}, {_MASKED}
        SELECT doc_id, string_agg(id, ' ' ORDER BY i) AS input_ids, string_agg(target, ' ' ORDER BY i) AS targets
        FROM masked GROUP BY doc_id""",
    "mlm_corpus": f"""
        WITH {_IDS}, {_encoded('documents', 'doc_id')}, {_MASKED},
        part AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <=
                   floor((SELECT count(*) FROM documents)::DOUBLE * (1::DOUBLE - 0.05::DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM documents),
        used AS (SELECT doc_id, list_sum(attention_mask)::BIGINT AS n FROM enc)
        SELECT split, count(DISTINCT doc_id) AS texts, (sum(n) FILTER (WHERE i = 0))::BIGINT AS tokens,
               count(*) FILTER (WHERE target <> -100) AS masked, sum(id)::BIGINT AS id_sum
        FROM masked JOIN part USING (doc_id) JOIN used USING (doc_id) GROUP BY split""",
}
