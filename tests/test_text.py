import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tonemill import constants as C
from tonemill.functions import accents, labels, text, tokens
from tonemill.functions.paths import parent_name, stem

EDGE_TEXTS = [
    "  a b  ", "\xa0x\t\x1c", "see https://x.y/z now", "www.a.b c", "http://only.url", "a  b\tc\n\nd", "one\nline",
    "5.2 %", "x5", "5x", "5.2x", "a 12,5% b", "٣٤ %", "7.", "$ABC.D", "$5", "p+\xe9 q++x r+++y ++1", "�z",
    "", "\xbd ﬁne \xc9a", "1\xb2", "áb", "it’s ’tis o'neil's", "A-b c'd -e", "　wide　 space",
]


@pytest.fixture(scope="module")
def edge_rows(spark):
    df = spark.createDataFrame(list(enumerate(EDGE_TEXTS)), "id int, text string")
    t = F.col("text")
    df = df.select(
        "id", "text",
        text.clean_text(t).alias("clean"),
        text.clean_text(t, remove_urls=False).alias("clean_keep"),
        text.fix_encoding(t).alias("fixed"),
        accents.fold_accents(t).alias("folded"),
        tokens.count_tokens(t, ["it's"]).alias("tokens"),
        tokens.lexicon_tokens(t).alias("lexicon"),
        tokens.feature_tokens(t).alias("words"),
    )
    return text.add_text_features(df).orderBy("id").collect()


def test_whitespace_set_is_pythons():
    assert sorted(C.WS_CHARS) == sorted(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_cleaning_matches_python(edge_rows):
    url = re.compile(r"https?://\S+|www\.\S+")
    for row in edge_rows:
        stripped = row.text.strip()
        assert row.clean == re.sub(r"\s{2,}", " ", url.sub("", stripped)).strip()
        assert row.clean_keep == re.sub(r"\s{2,}", " ", stripped).strip()


def test_encoding_repair_matches_python(edge_rows):
    for row in edge_rows:
        expected = re.sub(r"\+(?=[\x80-\xff])", "", row.text)
        expected = re.sub(r"\+\+(?=[A-Za-z])", "", expected).replace("�", "")
        assert row.fixed == expected


def test_features_match_python(edge_rows):
    number = re.compile(r"\b\d+(?:[.,]\d+)?\b")
    percent = re.compile(r"\b\d+(?:[.,]\d+)?%|\b\d+(?:[.,]\d+)?\s*%")
    for row in edge_rows:
        t = row.text.strip()
        assert row.text_stripped == t
        assert (row.char_length, row.word_count) == (len(t), len(t.split()))
        assert row.has_url == bool(re.search(r"https?://\S+|www\.\S+", t))
        assert row.has_ticker == bool(re.search(r"\$[A-Za-z][A-Za-z.\-]*", t))
        assert row.has_number == bool(number.search(t)), t
        assert row.has_percent == bool(percent.search(t)), t
        assert row.has_replacement_char == ("�" in t)


def test_tokens_match_python(edge_rows):
    url = re.compile(r"https?://\S+|www\.\S+")
    for row in edge_rows:
        plain = url.sub(" ", row.text).replace("’", "'").lower()
        found = re.findall(r"[A-Za-z]+(?:'[A-Za-z]+)?", plain)
        assert row.tokens == [w for w in found if len(w) >= 2 and w != "it's"]
        assert row.lexicon == [w.upper() for w in re.findall(r"[A-Za-z][A-Za-z'-]*", row.text)]
        assert row.words == re.findall(r"(?u)\b\w\w+\b", row.text)


def test_accents_match_python(spark):
    chars = [chr(c) for c in range(0x80, 0x3000)] + ["가", "ﬃ", "\U0001d400", "x™y", "\xc5ngstr\xf6m"]
    df = spark.createDataFrame([(c,) for c in chars], "c string").select("c", accents.fold_accents(F.col("c")).alias("f"))
    for row in df.collect():
        expected = "".join(x for x in unicodedata.normalize("NFKD", row.c) if not unicodedata.combining(x))
        assert row.f == expected, hex(ord(row.c[0]))


def test_null_text_becomes_blank(spark):
    row = text.add_text_features(spark.createDataFrame([(None,)], "text string")).first()
    assert (row.text_stripped, row.char_length, row.word_count, row.has_url) == ("", 0, 0, False)


def test_ngrams(spark):
    row = spark.range(1).select(F.array(*[F.lit(x) for x in "abc"]).alias("t")).select(
        tokens.ngrams(F.col("t"), 2).alias("two"), tokens.ngrams(F.col("t"), 4).alias("four"),
        tokens.ngram_range(F.col("t"), 1, 2).alias("both"),
    ).first()
    assert row.two == ["a b", "b c"] and row.four == [] and row.both == ["a", "b", "c", "a b", "b c"]


def test_stopwords(spark):
    assert tokens.build_stopwords(False, [" The ", "", "x"]) == ["the", "x"]
    english = tokens.build_stopwords(True, ["zzz"])
    assert "the" in english and "zzz" in english


def test_label_maps(spark):
    raw = [" Positive ", "BULLISH", "1", "0", "-1", "mixed\t", "other", None]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    got = [r[0] for r in df.select(labels.normalize_label(F.col("raw"))).collect()]
    assert got == ["positive", "positive", "positive", "neutral", "negative", "neutral", None, None]
    got = [r[0] for r in df.select(labels.normalize_label(F.col("raw"), {" OTHER": "Negative ", 1: "neutral"})).collect()]
    assert got[2] == "neutral" and got[6] == "negative"
    # A target outside the three labels is as bad as no mapping.
    assert spark.range(1).select(labels.normalize_label(F.lit("x"), {"x": "great"})).first()[0] is None


def test_two_codings_differ(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,)], "code int")
    assert [r[0] for r in df.select(labels.decode_label(F.col("code"))).collect()] == ["negative", "positive", "neutral", None]


def test_paths(spark):
    cases = {
        "data/processed/fpb/test.csv": ("fpb", "test"), "test.csv": ("", "test"), "/x/y/a.tar.gz": ("y", "a.tar"),
        "/test.csv": ("", "test"), "a/.hidden": ("a", ".hidden"), "a/b/": ("a", "b"), "a/noext": ("a", "noext"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    for row in df.select("p", parent_name(F.col("p")).alias("d"), stem(F.col("p")).alias("s")).collect():
        assert (row.d, row.s) == cases[row.p]
