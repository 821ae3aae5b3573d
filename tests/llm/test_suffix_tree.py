"""Suffix-tree scores: growth and scores by dictionaries, laws that sum to one, growth with the corpus, held-out gain."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tonemill.llm import suffix_tree as p

SCHEMA = "doc_id long, text string, score string"
LEAST = 4


def words(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w] + [""]


def corpus_rows(seed=11, prefix="rare"):
    rng = random.Random(seed)
    letters = "abcdef"
    after = {(v, w): rng.choice(letters) for v in letters for w in letters}
    rows = []
    for i in range(400):  # mostly, two words decide the next one
        text, v, w = [], rng.choice(letters), rng.choice(letters)
        for _ in range(rng.randint(0, 60)):
            text.append((w.upper() if rng.random() < 0.2 else w) if rng.random() < 0.97 else f"{prefix}{rng.randint(0, 5000)}")
            v, w = w, after[v, w] if rng.random() < 0.8 else rng.choice(letters)
        rows.append((i, " ".join(text), "x"))
    return rows


@pytest.fixture(scope="module")
def corpus():
    return corpus_rows() + [(1000, None, None), (1001, "", None), (1002, " \t\n", None), (1003, "Über über É x", None), (3, "twice", None), (3, "twice", None)]


class Plain:
    """The same tree, grown with dictionaries."""

    def __init__(self, texts, depth=p.DEPTH, least=LEAST):
        self.counts, runs = Counter(), defaultdict(Counter)
        for text in texts:
            tokens = ["", *words(text)]
            self.counts.update(tokens[1:])
            for size in range(1, depth + 1):
                for end in range(size, len(tokens)):
                    runs[tuple(tokens[end - size : end])][tokens[end]] += 1
        self.n, self.v = sum(self.counts.values()), len(self.counts)
        self.levels = []
        for size in range(1, depth + 1):
            level = {}
            for context, following in ((c, f) for c, f in runs.items() if len(c) == size):
                entries = {w: n for w, n in following.items() if n >= least}
                total = sum(following.values())
                if not entries or size > 1 and context[1:] not in self.levels[-1]:
                    continue
                explicit = sum(entries.values())
                rest = (total - explicit + p.DISCOUNT * len(entries)) / total
                parent = {w: self.logp(context[1:], w) for w in entries}
                law = {w: math.log((n - p.DISCOUNT) / total + rest * math.exp(parent[w])) for w, n in entries.items()}
                gain = sum(n * (law[w] - parent[w]) for w, n in entries.items()) + (total - explicit) * math.log(rest)
                if gain > 0.5 * len(entries) * math.log(max(total, 2)):
                    level[context] = (law, math.log(rest))
            self.levels.append(level)

    def logp(self, history, word):
        logp = math.log((self.counts[word] + 0.5) / (self.n + 0.5 * (self.v + 1)))
        for size, level in enumerate(self.levels, start=1):
            context = tuple(history[-size:])
            if len(context) < size or context not in level:
                break
            law, rest = level[context]
            logp = law.get(word, rest + logp)
        return logp

    def score(self, text):
        tokens = ["", *words(text)]
        return sum(self.logp(tokens[:k], tokens[k]) for k in range(1, len(tokens))) / math.log(10)


def key(run):
    out = 0
    for w in run:
        out = (out * int(p._MULTIPLIER) + xxhash.xxh64_intdigest(w.encode())) % (1 << 64)
    return out - (1 << 64) if out >= 1 << 63 else out


def test_base_scores_and_gain(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    got = p.score_texts(docs.filter("doc_id % 5 <> 1"), docs, ["doc_id"]).collect()
    counts = Counter(w for i, t, _ in corpus if i % 5 != 1 for w in words(t))
    n = sum(counts.values())
    want = sorted((i, len(words(t)), sum(counts[w] > 0 for w in words(t)), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in words(t))) for i, t, _ in corpus)
    rows = sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got)
    assert [r[:3] for r in rows] == [w[:3] for w in want]
    assert [r[3] for r in rows] == pytest.approx([w[3] for w in want])
    assert {r.train_tokens for r in got} == {n}
    held = [r for r in got if r.doc_id % 5 == 1 and r.n_tokens > 10]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)


@pytest.mark.parametrize("cached", [p.CACHED, 40, 0])
def test_growth_and_scores_by_dictionaries(spark, corpus, cached):
    docs = spark.createDataFrame(corpus, SCHEMA)
    values, sums, levels = p.grow(docs.filter("doc_id % 5 <> 1"), least=LEAST)
    plain = Plain([t for i, t, _ in corpus if i % 5 != 1])
    assert len(plain.levels[1]) > 10 and sums["tokens"] == plain.n
    if cached == p.CACHED:
        for (_, contexts), want in zip(levels, plain.levels):
            got = {r.context: r.log_rest for r in contexts.collect()}
            assert got == pytest.approx({key(c): rest for c, (_, rest) in want.items()})
    got = sorted((r.doc_id, r.score) for r in p.scored(docs, values, sums, ["doc_id"], cached=cached).collect())
    want = sorted((i, plain.score(t)) for i, t, _ in corpus)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_every_law_sums_to_one(corpus):
    plain = Plain([t for _, t, _ in corpus])
    for history in ([""], ["", "a"], ["", "a", "b"], ["", "c", "d", "e"], ["", "no such word", "a"]):
        assert sum(math.exp(plain.logp(history, w)) for w in [*plain.counts, "no such word"]) == pytest.approx(1)


def test_every_counted_context_stays_when_the_corpus_grows(spark, corpus):
    small = spark.createDataFrame(corpus, SCHEMA)
    others = [(i, " ".join(f"{w}_{part}" for w in t.split()), s) for part in range(9) for i, t, s in corpus_rows(part, "more")]
    large = small.unionByName(spark.createDataFrame(others, SCHEMA))
    before, after = (p.grow(docs, least=LEAST)[2] for docs in (small, large))
    for (law, _), (grown, _) in zip(before, after):
        assert law.count() > 0 and law.join(grown.select("key"), "key", "left_anti").count() == 0
        assert grown.count() > 5 * law.count()


def test_no_training_and_no_documents(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    rows = p.score_texts(docs.filter("doc_id < 0"), docs, ["doc_id"]).collect()
    assert len(rows) == len(corpus) and {r.n_known for r in rows} == {0} and {r.train_tokens for r in rows} == {0}
    assert all(r.score == pytest.approx(r.base_score) for r in rows)
    assert p.score_texts(docs, docs.filter("doc_id < 0"), ["doc_id"]).count() == 0


def test_carried_names_that_clash(spark, corpus):
    docs = spark.createDataFrame(corpus[:5], SCHEMA).selectExpr("doc_id as row", "text", "score as key", "doc_id as count", "text as `a.b`")
    rows = p.score_texts(docs, docs, ["row", "key", "count", "text", "a.b"]).collect()
    assert sorted(r.row for r in rows) == [0, 1, 2, 3, 4] and all(r["a.b"] == r.text for r in rows)


def test_long_texts(spark):
    text = " ".join(f"w{i % 977}" for i in range(60_000)) + " " + "z" * 50_000
    row = p.score_texts(spark.createDataFrame([(1, text, "")], SCHEMA), spark.createDataFrame([(1, text, "")], SCHEMA), ["doc_id"]).first()
    assert row.n_tokens == 60_002 == row.n_known and row.score > row.base_score


def test_word_hashes_are_xxh64():
    rng = random.Random(5)
    words = ["", "é", "x" * 31, "x" * 32, "日本語", *("".join(rng.choice("abcÜ0") for _ in range(n)) for n in range(70) for _ in range(9))]
    want = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    assert p.word_hashes(pa.array(words)).tolist() == want
    assert p.word_hashes(pa.array(words)[7:40]).tolist() == want[7:40] and not len(p.word_hashes(pa.array([], pa.string())))


def test_table_finds_what_it_holds():
    held = np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64)
    held[:3000] >>= np.uint64(30)  # many begin alike
    held = np.unique(np.r_[held, np.uint64(0)])
    keys, counts, values, starts = p._table(held.view(np.int64), np.arange(len(held)), np.arange(len(held)) / 2)
    at, missing = p._look_up(keys, starts, held)
    assert not missing.any() and counts[at].tolist() == list(range(len(held))) and (values[at] == counts[at] / 2).all()
    at, missing = p._look_up(keys, starts, np.r_[held[1:] - np.uint64(1), np.uint64(2**64 - 1)])
    assert missing.all() and not counts[at].any() and not values[at].any()


def test_rare_words_are_met_in_the_join_at_any_size(spark):
    values = spark.range(1, 1001).selectExpr("id as key", "id as weight")
    assert p._least_cached(values, 10_000) == p.LEAST_CACHED
    assert p._least_cached(values, 100) > 850
