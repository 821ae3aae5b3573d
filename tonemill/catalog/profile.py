"""Corpus profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.catalog import inputs as I
from tonemill.catalog import snippets as S
from tonemill.functions.text import strip
from tonemill.functions.tokens import stopword_table
from tonemill.operators import ngrams, profile

STOP = ["the", "of", "and", "to", "in", "la", "le", "de", "der", "die", "und", "el", "que", "is", "it"]


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return profile.length_table(I.profiled_documents(spark, sf), ["label"])


def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    return profile.summary_rows(_lengths(spark, sf))


def pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.pattern_counts(_lengths(spark, sf), ["label"])


def missing_values(spark: SparkSession, sf: str) -> DataFrame:
    return profile.missing_values(I.profiled_documents(spark, sf))


def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = profile.label_distribution(I.profiled_documents(spark, sf).select("label"))
    return rows.withColumn("ratio", F.round("ratio", 6))


def length_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return profile.length_stats(_lengths(spark, sf), ["label"])


def duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.table(spark, sf, "documents")
    texts = docs.select(strip(F.col("text")).alias("text"))
    keyed = docs.select("doc_id", "text", "lang")
    counts = {
        "rows": profile.duplicate_count(keyed),
        "text_lang": profile.duplicate_count(keyed, ["text", "lang"]),
        "texts": profile.duplicate_count(texts),
    }
    parts = [df.select(F.lit(name).alias("over"), "duplicates") for name, df in counts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _top(spark: SparkSession, sf: str, n: int, stopwords: list[str] | None = None) -> DataFrame:
    return ngrams.top_ngrams(I.noisy_documents(spark, sf), "doc_id", n, 20, stopwords or [])


def top_unigrams(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, 1)


def top_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, 2)


def top_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, 3)


def top_bigrams_stop(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, 2, STOP)


def top_english_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Top unigrams to trigrams without the English stop-words and extras, which meet the tokens as a table."""
    extra = spark.createDataFrame([(w,) for w in STOP], "word string")
    return ngrams.top_ngram_table(I.noisy_documents(spark, sf), "doc_id", [1, 2, 3], 50, stopword_table(spark, True, extra))


def top_ngram_table(spark: SparkSession, sf: str) -> DataFrame:
    table = ngrams.top_ngram_table(I.noisy_documents(spark, sf), "doc_id", [1, 2, 3], 50, STOP)
    return table.withColumn("rank", F.col("rank").cast("long"))


def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    bins = profile.histogram(_lengths(spark, sf))
    return bins.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


def length_boxplot(spark: SparkSession, sf: str) -> DataFrame:
    return profile.box_plot(_lengths(spark, sf), ["label"])


def corpus_compare(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.noisy_documents(spark, sf).select(F.lit("documents").alias("corpus"), "text")
    talks = I.table(spark, sf, "conversations").select(F.lit("conversations").alias("corpus"), "text")
    rows = profile.summary_rows(profile.length_table(docs.unionByName(talks), ["corpus"]), ["corpus"])
    return profile.compare(rows, "corpus", ["documents", "conversations"])


QUERIES = {f.__name__: f for f in (
    profile_summary, pattern_counts, missing_values, label_distribution, length_by_label, duplicate_counts,
    top_unigrams, top_bigrams, top_trigrams, top_bigrams_stop, top_english_stop, top_ngram_table,
    length_histogram, length_boxplot, corpus_compare,
)}

_F = ", ".join(f"{sql} AS {name}" for name, sql in S.features("text_stripped").items())


def _featured(source: str, keep: str) -> str:
    return f"""feat AS (SELECT {keep}, text_stripped, {_F}
               FROM (SELECT {keep}, {S.strip('text')} AS text_stripped FROM {source}))"""


_FEAT = f"WITH {I.PROFILED}, {_featured('profiled', 'label')}"
_HITS = "num_rows, empty_text_rows, parse_failures, rows_with_url, rows_with_ticker, rows_with_number, rows_with_percent, rows_with_replacement_char"
_COUNTS = """count(*) AS num_rows, count(*) FILTER (WHERE text_stripped = '') AS empty_text_rows, 0::BIGINT AS parse_failures,
  count(*) FILTER (WHERE has_url) AS rows_with_url, count(*) FILTER (WHERE has_ticker) AS rows_with_ticker,
  count(*) FILTER (WHERE has_number) AS rows_with_number, count(*) FILTER (WHERE has_percent) AS rows_with_percent,
  count(*) FILTER (WHERE has_replacement_char) AS rows_with_replacement_char"""


def _summary(group: str) -> str:
    stats = ", ".join(
        f"round(avg({c}), 4)::DOUBLE AS {c}_mean, round(median({c}), 4)::DOUBLE AS {c}_median, "
        f"min({c})::DOUBLE AS {c}_min, max({c})::DOUBLE AS {c}_max"
        for c in ("char_length", "word_count")
    )
    names = _HITS + ", " + ", ".join(
        f"{c}_{p}" for c in ("char_length", "word_count") for p in ("mean", "median", "min", "max")
    )
    doubles = ", ".join(f"{n}::DOUBLE AS {n}" for n in names.split(", "))
    by, keep = (f"GROUP BY {group}", f"{group}, ") if group else ("", "")
    return f"""SELECT * FROM (UNPIVOT (SELECT {keep}{doubles} FROM (SELECT {keep}{_COUNTS}, {stats} FROM feat {by}))
               ON {names} INTO NAME stat VALUE value)"""


_LONG = "long AS (SELECT label, 'char_length' AS feature, char_length AS v FROM feat UNION ALL SELECT label, 'word_count', word_count FROM feat)"


def _grams(n: int, stopwords: list[str] | None = None) -> str:
    gram = " || ' ' || ".join(f"t[i + {j}]" for j in range(n))
    return f"""SELECT ngram, count(*) AS count, min(doc_id::HUGEINT * 4294967296 + i) AS first
      FROM (SELECT doc_id, i, {gram} AS ngram
            FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n} + 2)) AS i
                  FROM (SELECT doc_id, {S.count_tokens('text', stopwords)} AS t FROM noisy)))
      GROUP BY ngram"""


def _top_sql(n: int, stopwords: list[str] | None = None) -> str:
    return f"WITH {I.NOISY}, g AS ({_grams(n, stopwords)}) SELECT ngram, count FROM g ORDER BY count DESC, first LIMIT 20"


def _table_sql(stopwords: list[str]) -> str:
    sizes = " UNION ALL ".join(f"SELECT {n} AS size, * FROM ({_grams(n, stopwords)})" for n in (1, 2, 3))
    return f"""
        WITH {I.NOISY}, g AS ({sizes}),
        r AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY count DESC, first) AS rank FROM g)
        SELECT size, rank, ngram, count FROM r WHERE rank <= 50"""


ORACLES = {
    "profile_summary": f"""
        WITH {I.PROFILED}, {_featured('profiled', 'label')}
        SELECT stat, value FROM ({_summary('')})""",
    "pattern_counts": f"{_FEAT} SELECT label, {_COUNTS} FROM feat GROUP BY label",
    "missing_values": f"""
        WITH {I.PROFILED}
        SELECT 'doc_id' AS column_name, count(*) FILTER (WHERE doc_id IS NULL) AS missing FROM profiled
        UNION ALL SELECT 'text', count(*) FILTER (WHERE text IS NULL) FROM profiled
        UNION ALL SELECT 'label', count(*) FILTER (WHERE label IS NULL) FROM profiled""",
    "label_distribution": f"""
        WITH {I.PROFILED}
        SELECT label, count(*) AS count, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6)::DOUBLE AS ratio
        FROM profiled GROUP BY label""",
    "length_by_label": f"""
        {_FEAT}, {_LONG}
        SELECT label, feature, count(*) AS rows, round(avg(v), 4)::DOUBLE AS mean, round(median(v), 4)::DOUBLE AS median,
               min(v) AS min, max(v) AS max
        FROM long GROUP BY label, feature""",
    "duplicate_counts": f"""
        SELECT 'rows' AS over, count(*) - (SELECT count(*) FROM (SELECT DISTINCT doc_id, text, lang FROM documents)) AS duplicates
        FROM documents
        UNION ALL SELECT 'text_lang', count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) FROM documents
        UNION ALL SELECT 'texts', count(*) - (SELECT count(*) FROM (SELECT DISTINCT {S.strip('text')} FROM documents)) FROM documents""",
    "top_unigrams": _top_sql(1),
    "top_bigrams": _top_sql(2),
    "top_trigrams": _top_sql(3),
    "top_bigrams_stop": _top_sql(2, STOP),
    "top_english_stop": _table_sql(sorted({*S.ENGLISH, *STOP})),
    "top_ngram_table": _table_sql(STOP),
    "length_histogram": f"""
        {_FEAT}, {_LONG},
        span AS (SELECT feature, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM long GROUP BY feature),
        bins AS (SELECT feature, b::INT AS bin, b * ((hi - lo) / 30) + lo AS low,
                        CASE WHEN b = 29 THEN hi ELSE (b + 1) * ((hi - lo) / 30) + lo END AS high
                 FROM span, range(0, 30) t(b))
        SELECT bins.feature, bin, round(low, 6) AS low, round(high, 6) AS high, count(v) AS count
        FROM bins LEFT JOIN long ON long.feature = bins.feature AND v >= low AND (v < high OR (bin = 29 AND v <= high))
        GROUP BY bins.feature, bin, low, high""",
    "length_boxplot": f"""
        {_FEAT}, {_LONG},
        q AS (SELECT label, feature, quantile_cont(v, 0.25)::DOUBLE AS q1, quantile_cont(v, 0.5)::DOUBLE AS median,
                     quantile_cont(v, 0.75)::DOUBLE AS q3 FROM long WHERE label IS NOT NULL GROUP BY label, feature)
        SELECT q.label, q.feature, q1, median, q3,
               least(coalesce(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1))::DOUBLE, q1), q1) AS whisker_low,
               greatest(coalesce(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1))::DOUBLE, q3), q3) AS whisker_high,
               count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM q JOIN long ON long.label = q.label AND long.feature = q.feature
        GROUP BY q.label, q.feature, q1, median, q3""",
    "corpus_compare": f"""
        WITH {I.NOISY}, both_corpora AS (
          SELECT 'documents' AS corpus, text FROM noisy UNION ALL SELECT 'conversations', text FROM conversations),
        {_featured('both_corpora', 'corpus')}
        SELECT stat, max(value) FILTER (WHERE corpus = 'documents') AS documents,
               max(value) FILTER (WHERE corpus = 'conversations') AS conversations
        FROM ({_summary('corpus')}) GROUP BY stat""",
}
