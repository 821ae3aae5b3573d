"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm import (
    chat, collocations, decontamination, embedding, fingerprints, importance, line_dedup, packing, sharding, simhash, suffix_tree, toxicity, url_filter,
)
from tonemill.llm.common import in_fold

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
N_SHARDS = 24
PROBE = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_definition(name: str = "word_bpe_49k.json") -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, folder, "documents"), N_SHARDS)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, labels.filter(~held_out))
    score = toxicity.scored(docs.select("doc_id", "text"), model)
    return score.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "text", "n_lines", "n_removed")


def op5_embedding(spark: SparkSession, folder: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, folder, "embeddings"))


def op6_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), in_fold(F.col("doc_id"), 5, 1)
    scores = suffix_tree.score_texts(docs.filter(~held_out), docs, ["doc_id"])
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the rendered conversations say: turns and loss text, unescaped, as digests."""

    def run(batches):
        for batch in batches:
            rows, out = batch.to_pydict(), {name: [] for name in schema.names}
            for conv_id, text, spans in zip(rows["conv_id"], rows["formatted"], rows["loss_spans"]):
                turns = chat.parse(text)
                loss = "".join(chat.unescape(text[s["start"] : s["end"]]) for s in spans)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                digest = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in (told, loss)]
                for name, value in zip(out, (conv_id, len(turns), digest[0], len(loss), digest[1], len(text))):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    long, string = pa.int64(), pa.string()
    schema = pa.schema([("conv_id", long), ("n_turns", long), ("turns_sha256", string), ("loss_chars", long), ("loss_sha256", string), ("formatted_chars", long)])
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    events = turns.select("conv_id", F.col("turn").alias("seq"), F.col("turn").cast("string").alias("message"), F.lit("message").alias("kind"), "role", "text")
    return read_back(chat.format_conversations(events))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_definition(), words_apart=True)


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_sharding, op3_toxicity, op4_line_dedup, op5_embedding, op6_suffix_tree, op7_simhash, op8_chat, op9_decontamination, op10_packing,
    op11_importance, op12_fingerprints, op13_collocations,
)}

ORACLES = {
    "op1_url_filter": r"""
        WITH r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rh, rp, rv)),
        p AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        q AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        m AS (SELECT q.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC NULLS LAST) AS k
              FROM q LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1
    """,
    "op4_line_dedup": r"""
        WITH l AS (SELECT md5(text) AS digest, source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL),
        b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10 AND count(DISTINCT digest) >= 10),
        s AS (SELECT coalesce(list(line), []) AS spread FROM b),
        k AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(spread, trim(x))) AS kept FROM documents, s)
        SELECT doc_id, array_to_string(kept, chr(10)) AS text, coalesce(len(lines), 0)::INTEGER AS n_lines, coalesce(len(lines) - len(kept), 0)::INTEGER AS n_removed FROM k
    """,
    "op8_chat": r"""
        WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(\||/?s>|</?SYS>>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS escaped FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
               sum(length('<|im_start|>' || role || chr(10) || escaped || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op11_importance": r"""
        WITH i AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
        w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM i),
        f AS (SELECT side, id, unnest(words) AS word FROM w),
        z AS (SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) t(b)),
        zs AS (SELECT list(crc ORDER BY b) AS crcs FROM z),
        d AS (SELECT DISTINCT word FROM f),
        h AS (SELECT word, list_transform(range(1, length(hex(word)), 2), lambda k: ('0x' || substr(hex(word), k, 2))::BIGINT) AS bytes FROM d),
        c AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda x, y: xor(x >> 8, crcs[(xor(x, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, zs),
        n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN c USING (word) GROUP BY bucket),
        o AS (SELECT sum(s) AS ss, sum(t) AS tt FROM n),
        g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM n, o),
        v AS (SELECT id, sum(gain)::BIGINT AS weight FROM f JOIN c USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
        u AS (SELECT id AS doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                     coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
              FROM w LEFT JOIN v USING (id) WHERE side = 0),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM u WHERE n_features >= 20)
        SELECT u.*, CASE WHEN place <= floor(10 * fit / 100) THEN place END AS rank FROM u LEFT JOIN r USING (doc_id)
    """,
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
        t AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k) WHERE len(words) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        x AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS words FROM f),
        inside AS (SELECT DISTINCT y.lang, y.phrase FROM x JOIN f y ON x.lang = y.lang AND y.k < x.k AND contains(' ' || x.phrase || ' ', ' ' || y.phrase || ' ') WHERE 100 * x.a >= 100 * y.a),
        cuts AS (SELECT x.lang, x.phrase, x.a, c.j, array_to_string(words[1:c.j], ' ') AS head, array_to_string(words[c.j + 1:], ' ') AS tail FROM x, range(1, 5) c(j) WHERE x.k > 1 AND c.j < x.k),
        s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, l.a AS l, r.a AS r, n, (1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a) AS score
              FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail JOIN t ON t.lang = cuts.lang),
        m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM m ANTI JOIN inside USING (lang, phrase))
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
    """,
}
