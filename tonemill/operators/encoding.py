"""Fixed-length token ids over a word vocabulary, and masked-token examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.operators.tfidf import bounded

# Words are runs of word characters; any other visible character is its own token.
TOKEN = rf"[{C.WORD}]+|[^{C.WORD}{C.WS}]"


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def fit_word_ids(df: DataFrame, max_words: int, text: str = "text") -> DataFrame:
    """(word, id): the ``max_words`` most frequent tokens, ids by count then token after the special ids."""
    words = df.select(F.explode(word_tokens(F.col(text))).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "word").limit(max_words)
    place = F.row_number().over(Window.orderBy(F.desc("_n"), "word"))
    return top.select("word", (place + F.lit(C.FIRST_WORD_ID - 1)).alias("id"))


def encode(
    df: DataFrame,
    keys: list[str],
    words: DataFrame,
    max_length: int = 128,
    carry: list[str] | None = None,
    text: str = "text",
    max_words: int | None = None,
) -> DataFrame:
    """(keys..., carry..., input_ids, attention_mask), both of exactly ``max_length``.

    Start and end markers enclose the text's first ``max_length - 2`` tokens,
    padding fills the rest, unknown words get the unknown id. Token arrays are
    dealt by key once; where ``max_words`` bounds ``words`` they are broadcast, and
    the tokens of a text come together again without a further exchange. Otherwise
    adaptive execution picks the join and splits frequent words.
    """
    carry = carry or []
    head = F.slice(word_tokens(F.col(text)), 1, max_length - 2)
    dealt = df.select(*keys, *carry, head.alias("_head")).repartition(*keys)
    tokens = dealt.select(*keys, *carry, F.posexplode_outer("_head").alias("_pos", "_word"))
    renamed = bounded(words.select(F.col("word").alias("_word"), F.col("id").alias("_id")), max_words)
    looked_up = tokens.join(renamed, "_word", "left")
    entry = F.when(
        F.col("_word").isNotNull(), F.struct("_pos", F.coalesce("_id", F.lit(C.UNK_ID)).alias("id"))
    )
    rows = looked_up.groupBy(*keys, *carry).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    used = F.size("_e") + 2
    ids = F.concat(
        F.array(F.lit(C.CLS_ID)),
        F.transform("_e", lambda e: e["id"]),
        F.array(F.lit(C.SEP_ID)),
        F.array_repeat(F.lit(C.PAD_ID), max_length - used),
    )
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), max_length - used))
    return rows.select(*keys, *carry, ids.alias("input_ids"), mask.alias("attention_mask"))


def label_ids(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in C.LABELS]), label).cast("int") - 1


def _hex(share: float) -> str:
    """Eight hex digits: a uniform 32-bit number is below the share when its digits sort before these."""
    return f"{int(share * 2**32):08x}"


def mask_tokens(
    df: DataFrame, key: str, vocabulary_size: int, probability: float = 0.15, seed: int = 42
) -> DataFrame:
    """Replace ``input_ids`` by masked ones and append ``targets``.

    Words are selected with the given probability; 80 % of those become the mask
    id, 10 % a random id, 10 % stay. Targets hold the original id where selected,
    the ignored value elsewhere; special ids and padding are never selected.
    The draw hashes (seed, key, position), so it is the same on every run.
    """

    def word(x: Column) -> Column:
        return (x >= C.FIRST_WORD_ID) | (x == C.UNK_ID)

    draws = F.transform(
        "input_ids",
        lambda x, i: F.when(word(x), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")))),
    )

    def selected(x: Column, draw: Column) -> Column:
        return word(x) & (F.substring(draw, 1, 8) < _hex(probability))

    def replaced(x: Column, draw: Column) -> Column:
        action = F.substring(draw, 9, 8)
        random_id = F.conv(F.substring(draw, 17, 8), 16, 10).cast("long") % vocabulary_size
        return (
            F.when(action < _hex(0.8), F.lit(C.MASK_ID)).when(action < _hex(0.9), random_id.cast("int")).otherwise(x)
        )

    drawn = df.withColumn("_draws", draws)
    return drawn.withColumns(
        {
            "input_ids": F.zip_with(
                "input_ids", "_draws", lambda x, d: F.when(selected(x, d), replaced(x, d)).otherwise(x)
            ),
            "targets": F.zip_with(
                "input_ids", "_draws", lambda x, d: F.when(selected(x, d), x).otherwise(C.IGNORED_TARGET)
            ),
        }
    ).drop("_draws")
