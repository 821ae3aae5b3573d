"""Input frames shared by the registered queries, each next to the SQL that derives the same rows.

Nothing is sampled or cut: every frame holds all rows and whole texts of its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.functions.labels import decode_label, normalize_label
from tonemill.runtime import spread

# The generated prose holds hardly any URL, ticker, percent sign or stray
# whitespace, so some sources get a prefix and a suffix that do.
NOISE = {
    "src0": ("", " https://news.example/item?id=1"),
    "src1": ("", " $ABC.D"),
    "src2": ("", " 5.2 %"),
    "src3": ("", " \ufffd"),
    "src4": ("", " +\xe9"),
    "src5": ("", " ++x"),
    "src6": ("  ", "  x   y  "),
    "src7": ("\xa0\t", "\u2003"),
    "src8": ("www.site.example/a ", " end"),
    "src9": ("", " 12,5% up"),
    "src10": ("", " x5 5x 7."),
    "src11": ("", " it\u2019s \u2019tis"),
}


TEXT_TABLES = ("documents", "conversations", "pages", "embeddings")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _noisy(text: Column, source: Column) -> Column:
    pairs = list(NOISE.items())
    prefix, suffix = F.lit(""), F.lit("")
    for name, (before, after) in pairs:
        prefix = F.when(source == name, F.lit(before)).otherwise(prefix)
        suffix = F.when(source == name, F.lit(after)).otherwise(suffix)
    return F.concat(prefix, text, suffix)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _noise_case(part: int) -> str:
    whens = " ".join(f"WHEN {sql_text(s)} THEN {sql_text(p[part])}" for s, p in NOISE.items())
    return f"CASE source {whens} ELSE '' END"


def noisy_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, text): every document, decorated by source."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "lang", _noisy(F.col("text"), F.col("source")).alias("text"))


NOISY = f"noisy AS (SELECT doc_id, lang, {_noise_case(0)} || text || {_noise_case(1)} AS text FROM documents)"


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, text, label): documents with a label; positive, neutral or negative by quality and toxicity."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id",
        "lang",
        "text",
        decode_label(F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1).otherwise(2)).alias("label"),
    )


LABELLED = """labelled AS (
  SELECT doc_id, lang, text,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label
  FROM documents JOIN labels USING (doc_id))"""

# The evaluation domains of a labelled document.
DOMAINS = ("en", "other")


def domain(lang: Column) -> Column:
    return F.when(lang == "en", "en").otherwise("other")


DOMAIN = "CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END"


def profiled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, label): every document, decorated; label null where none is known."""
    labels = table(spark, sf, "labels").select(
        "doc_id", normalize_label((F.col("quality") - F.col("toxic")).cast("string")).alias("label")
    )
    return noisy_documents(spark, sf).drop("lang").join(labels, "doc_id", "left")


PROFILED = f"""{NOISY}, profiled AS (
  SELECT doc_id, text,
         CASE quality - toxic WHEN 1 THEN 'positive' WHEN 0 THEN 'neutral' WHEN -1 THEN 'negative' END AS label
  FROM noisy LEFT JOIN labels USING (doc_id))"""

PAGE_KEY = 10**12


def mixed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, text, label): decorated documents, page addresses, which cleaning empties, and whole pages."""
    pages = table(spark, sf, "pages")
    parts = [
        pages.select(
            (F.col("page_id") + place * PAGE_KEY).alias("row_id"), F.col(name).alias("text"), F.lit(None).cast("string").alias("label")
        )
        for place, name in enumerate(("url", "html"), 1)
    ]
    return profiled_documents(spark, sf).withColumnRenamed("doc_id", "row_id").unionByName(parts[0]).unionByName(parts[1])


MIXED = f"""{PROFILED}, mixed AS (
  SELECT doc_id AS row_id, text, label FROM profiled
  UNION ALL SELECT page_id + {PAGE_KEY}, url, NULL FROM pages
  UNION ALL SELECT page_id + {2 * PAGE_KEY}, html, NULL FROM pages)"""

# Vectors stand in for model outputs: class c's logit sums the dimensions c, c + 3, c + 6, ...
CLASSES = 3


def logits(vector: str = "embedding") -> Column:
    def summed(c: int) -> Column:
        own = F.filter(vector, lambda x, i: i % CLASSES == c)
        return F.aggregate(own, F.lit(0.0), lambda total, x: total + x.cast("double"))

    return F.array(*[summed(c) for c in range(CLASSES)])


LOGITS = ", ".join(
    f"list_sum(list_transform(range({c + 1}, len(embedding) + 1, {CLASSES}), lambda i: embedding[i]::DOUBLE)) AS {n}"
    for c, n in enumerate("abc")
)
