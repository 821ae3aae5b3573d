"""Lexicon scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.catalog import inputs as I
from tonemill.catalog import snippets as S
from tonemill.functions.tokens import lexicon_tokens
from tonemill.operators import lexicon, metrics
from tonemill.sources.lexicon import lexicon_words as read_words

# Parameter lexicon in the year coding: 0 = not listed, negative = removed.
WORDS = [
    ("the", 2009, 0), ("of", 0, 2009), ("and", 2011, 2011), ("to", 0, -2020), ("in", 0, 2014), ("is", 2009, 0),
    ("that", 0, 0), ("it", 2012, 0), ("for", 0, 2009), ("was", 2009, 0), ("on", -2009, 2009), ("with", 2010, 0),
    ("la", 2010, 0), ("que", 0, 2011), ("der", 2009, 0), ("und", 0, 2009),
]


def _lexicon(spark: SparkSession) -> DataFrame:
    return read_words(spark.createDataFrame(WORDS, "Word string, Positive int, Negative int"))


def _learned(spark: SparkSession, sf: str) -> DataFrame:
    """Word table counted from the labelled documents: in how many of each class a word occurs."""
    docs = I.labelled_documents(spark, sf)
    words = docs.select("label", F.explode(F.array_distinct(lexicon_tokens(F.col("text")))).alias("Word"))
    return words.groupBy("Word").agg(
        F.count_if(F.col("label") == "positive").alias("Positive"),
        (F.count_if(F.col("label") != "positive") * 3).alias("Negative"),
    )


def lexicon_words(spark: SparkSession, sf: str) -> DataFrame:
    return read_words(_learned(spark, sf), threshold=3)


def lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.score(I.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], _lexicon(spark)).drop("text")


def lexicon_score_learned(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon that grows with the corpus."""
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    words = read_words(_learned(spark, sf), threshold=3)
    return lexicon.score(docs, ["doc_id"], words, min_count_diff=2).drop("text")


def lexicon_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with missing texts and a missing key, scored by the join and in the row: the same hits."""
    docs = I.table(spark, sf, "documents").select(
        F.nullif("doc_id", F.lit(0)).alias("doc_id"), F.when(F.col("doc_id") % 5 != 1, F.col("text")).alias("text")
    )
    sets = [[w.upper() for w, *years in WORDS if years[k] > 0] for k in (0, 1)]
    ways = {"join": lexicon.score(docs, ["doc_id"], _lexicon(spark)), "row": lexicon.score_with_sets(docs, *sets)}
    parts = [scored.drop("text").withColumn("way", F.lit(way)) for way, scored in ways.items()]
    return parts[0].unionByName(parts[1])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.labelled_documents(spark, sf).withColumn("eval_name", I.domain(F.col("lang")))
    return lexicon.score(docs, ["doc_id"], _lexicon(spark))


def _round(df: DataFrame) -> DataFrame:
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, 6) for n in doubles})


def lexicon_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.evaluation_summary(_scored(spark, sf), ["eval_name"]))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(_scored(spark, sf), ["eval_name"])


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.class_report(_scored(spark, sf), ["eval_name"]))


QUERIES = {f.__name__: f for f in (
    lexicon_words, lexicon_score, lexicon_score_learned, lexicon_paths, lexicon_metrics, confusion_matrix, class_report,
)}

_VALUES = ", ".join(f"('{w.upper()}', {p} > 0, {n} > 0)" for w, p, n in WORDS)
_LEX = f"lex AS (SELECT * FROM (VALUES {_VALUES}) t(word, positive, negative))"
_LEARNED = f"""learned AS (
  SELECT word, p > 3 AS positive, n > 3 AS negative
  FROM (SELECT word, count(*) FILTER (WHERE label = 'positive') AS p, 3 * count(*) FILTER (WHERE label <> 'positive') AS n
        FROM (SELECT DISTINCT doc_id, label, unnest({S.lexicon_tokens('text')}) AS word FROM labelled) GROUP BY word)
  WHERE p > 3 OR n > 3)"""


def scored_cte(source: str, lex: str, least: int = 1) -> str:
    return f"""hits AS (
  SELECT doc_id, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE negative) AS n
  FROM (SELECT doc_id, unnest({S.lexicon_tokens('text')}) AS word FROM {source}) JOIN {lex} USING (word) GROUP BY doc_id),
scored AS (
  SELECT s.*, coalesce(p, 0)::BIGINT AS positive_hits, coalesce(n, 0)::BIGINT AS negative_hits,
         (coalesce(p, 0) - coalesce(n, 0))::BIGINT AS lexicon_score,
         CASE WHEN coalesce(p, 0) - coalesce(n, 0) >= {least} THEN 'positive'
              WHEN coalesce(p, 0) - coalesce(n, 0) <= -{least} THEN 'negative' ELSE 'neutral' END AS prediction
  FROM {source} s LEFT JOIN hits USING (doc_id))"""


LEX = _LEX
_EVAL = f"WITH {I.LABELLED}, {_LEX}, {scored_cte('labelled', 'lex')}, ev AS (SELECT {I.DOMAIN} AS eval_name, label, prediction FROM scored)"
_HITS = "doc_id, positive_hits, negative_hits, lexicon_score, prediction"
_GRID = "(VALUES ('positive'), ('neutral'), ('negative'))"

_PER = f"""per AS (
  SELECT d.eval_name, l.label AS entry, count(*) FILTER (WHERE e.label = l.label AND e.prediction = l.label)::DOUBLE AS hit,
         count(*) FILTER (WHERE e.label = l.label) AS sup, count(*) FILTER (WHERE e.prediction = l.label) AS prd
  FROM (SELECT DISTINCT eval_name FROM ev) d CROSS JOIN {_GRID} l(label) JOIN ev e ON e.eval_name = d.eval_name
  GROUP BY d.eval_name, l.label),
prf AS (SELECT eval_name, entry, CASE WHEN prd = 0 THEN 0 ELSE hit / prd END AS p, CASE WHEN sup = 0 THEN 0 ELSE hit / sup END AS r,
               CASE WHEN prd + sup = 0 THEN 0 ELSE 2 * hit / (prd + sup) END AS f, sup FROM per)"""

def _listed(place: int) -> str:
    words = ", ".join(f"'{w.upper()}'" for w, *years in WORDS if years[place] > 0)
    return f"len(list_filter(words, lambda w: w IN ({words})))"


_PATHS = f"""WITH t AS (SELECT nullif(doc_id, 0) AS doc_id, {S.lexicon_tokens("coalesce(CASE WHEN doc_id % 5 <> 1 THEN text END, '')")} AS words FROM documents),
h AS (SELECT doc_id, {_listed(0)} AS p, {_listed(1)} AS n FROM t)
SELECT way, doc_id, p AS positive_hits, n AS negative_hits, p - n AS lexicon_score,
       CASE WHEN p - n >= 1 THEN 'positive' WHEN p - n <= -1 THEN 'negative' ELSE 'neutral' END AS prediction
FROM h CROSS JOIN (VALUES ('join'), ('row')) w(way)"""

ORACLES = {
    "lexicon_paths": _PATHS,
    "lexicon_words": f"WITH {I.LABELLED}, {_LEARNED} SELECT word, positive, negative FROM learned",
    "lexicon_score": f"WITH {_LEX}, {scored_cte('documents', 'lex')} SELECT {_HITS} FROM scored",
    "lexicon_score_learned": f"WITH {I.LABELLED}, {_LEARNED}, {scored_cte('documents', 'learned', 2)} SELECT {_HITS} FROM scored",
    "lexicon_metrics": f"{_EVAL} SELECT eval_name, size, {S.rounded_metrics()} FROM ({S.evaluation('ev', 'eval_name')})",
    "confusion_matrix": f"""
        {_EVAL}
        SELECT d.eval_name, l.label, count(*) FILTER (WHERE e.label = l.label AND prediction = 'positive') AS positive,
               count(*) FILTER (WHERE e.label = l.label AND prediction = 'neutral') AS neutral,
               count(*) FILTER (WHERE e.label = l.label AND prediction = 'negative') AS negative
        FROM (SELECT DISTINCT eval_name FROM ev) d CROSS JOIN {_GRID} l(label) JOIN ev e ON e.eval_name = d.eval_name
        GROUP BY d.eval_name, l.label""",
    "class_report": f"""
        {_EVAL}, {_PER}
        SELECT eval_name, entry, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(f, 6)::DOUBLE AS f1, sup AS support FROM prf
        UNION ALL
        SELECT eval_name, 'accuracy', NULL, NULL, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END)::DOUBLE, 6), count(*) FROM ev GROUP BY eval_name
        UNION ALL
        SELECT eval_name, 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(sup)::BIGINT FROM prf GROUP BY eval_name
        UNION ALL
        SELECT eval_name, 'weighted avg', round(sum(p * sup) / sum(sup), 6), round(sum(r * sup) / sum(sup), 6),
               round(sum(f * sup) / sum(sup), 6), sum(sup)::BIGINT FROM prf GROUP BY eval_name""",
}
