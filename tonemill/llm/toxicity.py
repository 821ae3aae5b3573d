"""Toxicity by compression distance: dictionaries trained on toxic and on ordinary text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import sliced, spaced_words, utf8

#: A classifier is fitted on at most so many labelled documents of a class, those whose hashed ids come first.
MAX_TOXIC, MAX_ORDINARY = 6_000, 18_000
#: Ordinary documents whose running text trains the part that both dictionaries share, and its passages.
MAX_BASE_DOCS, MAX_BASE_PASSAGES, PASSAGE_WORDS = 2_500, 150_000, 8
#: Different windows that train one class's part.
MAX_WINDOWS = 20_000
BASE_BYTES, CLASS_BYTES, SEGMENT, LEVEL = 65_536, 16_384, 32, 12
#: A window counts for a class that uses it so many times as often as the other one, in this share of its documents or more.
TYPICAL, SHARE, LEAST_DOCS = 10.0, 0.007, 3
#: zstandard gives up on short blocks and doesn't search their last eight bytes: a run on both sides changes that.
RUN = b"0" * 24
CUT = 0.7
CALIBRATION_PARTS, SHRINK = 5, 1.0
#: Without evidence, the cut is where this share of the toxic labels' number of texts lies above it; so many toxic texts weigh as much.
PRIOR_SHARE, PRIOR_FOUND = 0.5, 5.0
CACHED = 500_000
_LOW, _HIGH = -3, 9


@dataclass(frozen=True)
class Model:
    """Two dictionaries (they begin alike) and a calibrated logistic law over window differences."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def windows(text: bytes) -> set[bytes]:
    """The different windows of a text: its words between blanks, A-Z lower-cased."""
    return {b" " + w + b" " for w in spaced_words(text)}


class Gains:
    """Bytes that the toxic dictionary saves against the ordinary one, by window; frequent windows are kept."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        def compressor(content):
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.toxic, self.ordinary, self.known = compressor(toxic), compressor(ordinary), {}

    def __call__(self, window: bytes) -> int:
        gain = self.known.get(window)
        if gain is None:
            padded = RUN + window + RUN
            gain = len(self.ordinary.compress(padded)) - len(self.toxic.compress(padded))
            if len(self.known) >= CACHED:
                self.known.clear()
            if len(window) <= 40:
                self.known[window] = gain
        return gain

    def features(self, text: bytes) -> np.ndarray:
        """How often which gain occurs among a text's windows, its largest gains, and its size."""
        gains = np.fromiter(map(self, windows(text)), dtype=np.int64)
        n = max(1, len(gains))
        top = np.zeros(3)
        if len(gains):
            largest = np.sort(gains)[::-1][:3]
            top[: len(largest)] = largest
        counts = np.bincount(np.clip(gains, _LOW, _HIGH) - _LOW, minlength=_HIGH - _LOW + 1)
        over = [np.maximum(gains - t, 0).sum() / np.sqrt(n) for t in (2, 3)]
        many = [(gains >= t).sum() / np.sqrt(n) for t in (3, 4, 5)]
        return np.r_[top.cumsum(), np.log1p(counts), over, many, np.log(n)]


def _trained(samples: list[bytes], size: int, **options) -> bytes:
    """Content of a dictionary trained on the samples; of too few samples, the samples."""
    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _sample(labelled: DataFrame, most: dict[int, int]) -> DataFrame:
    """(id, toxic): bounded numbers of labelled ids of each class, in the order of a hash."""
    ids = labelled.select("id", "toxic").distinct()
    parts = [ids.filter(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(n) for t, n in most.items()]
    return parts[0].union(parts[1])


def _per_text(gains_of, model_bytes):
    def run(batches):
        gains = gains_of(*model_bytes)
        for batch in sliced(batches, "text"):
            rows = [gains.features(t).tolist() for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=pa.list_(pa.float64()))], names=["toxic", "features"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, weight: np.ndarray | None = None, steps: int = 50) -> np.ndarray:
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    each = np.ones(len(y)) if weight is None else weight
    each = each / each.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (each * (p - y)) + ridge * np.r_[w[:-1], 0]
        curve = (z * (each * p * (1 - p))[:, None]).T @ z + np.diag(np.r_[np.full(len(w) - 1, ridge), 1e-9])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the texts whose ids have a label 0 or 1 in ``labels``.

    At most MAX_TOXIC and MAX_ORDINARY labelled documents are used. Two in three of them, by the
    hash of the id, train the dictionaries: the windows that each class uses far more
    often than the other one train its own part, which is laid behind a part
    trained on ordinary running text, the same for both, so that ordinary
    windows compress alike. The others calibrate: a logistic law over a text's
    window gains, moved such that CUT is where the F1 score is best, both with each text counted by the
    inverse of its class's sampling rate, so that the bounds don't move the cut; the fewer
    toxic texts tell where that is, the more a fixed prior counts. Without documents of both classes
    the model gives every text the rate of the toxic class, below CUT.
    """
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    most = {1: MAX_TOXIC, 0: MAX_ORDINARY}
    chosen = F.broadcast(_sample(labelled, most))  # MAX_TOXIC + MAX_ORDINARY ids at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    texts = texts.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(3))).select("toxic", "fold", "text")
    trained = texts.filter(F.col("fold") > 0)

    def words_of(batches):
        for batch in sliced(batches, "text"):
            rows = [(t, w) for t, text in zip(batch.column("toxic").to_pylist(), utf8(batch, "text")) for w in windows(text)]
            yield pa.RecordBatch.from_arrays([pa.array([w for _, w in rows], pa.binary()), pa.array([t for t, _ in rows], pa.int32())], names=["window", "toxic"])

    totals = {r["toxic"]: r["n"] for r in texts.filter("fold > 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    held = {r["toxic"] for r in texts.filter("fold = 0").select("toxic").distinct().collect()}
    if len(totals) < 2 or len(held) < 2:
        rate = min(0.5, (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1))
        size = len(Gains(b"", b"").features(b""))
        return Model(b"", b"", np.zeros(size), np.ones(size), np.r_[np.zeros(size), np.log(rate / (1 - rate))])
    counts = trained.select(F.col("toxic").cast("int"), "text").mapInArrow(words_of, "window binary, toxic int")
    counts = counts.groupBy("window").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    rate_t, rate_o = F.col("t") / totals[1], F.col("o") / totals[0]
    more_t, more_o = (F.col("t") + 1) / totals[1], (F.col("o") + 1) / totals[0]
    floors = {n: max(LEAST_DOCS, SHARE * totals[n]) for n in (0, 1)}
    typical = counts.filter(((F.col("t") >= floors[1]) & (rate_t >= TYPICAL * more_o)) | ((F.col("o") >= floors[0]) & (rate_o >= TYPICAL * more_t)))
    own: dict[str, list[bytes]] = {}
    for name, higher in (("toxic", "t"), ("ordinary", "o")):
        lower = "o" if higher == "t" else "t"
        rows = typical.filter(F.col(higher) / totals[1 if higher == "t" else 0] > F.col(lower) / totals[0 if higher == "t" else 1])
        rows = rows.orderBy(F.desc(higher), "window").limit(MAX_WINDOWS).collect()
        samples = [bytes(r["window"]) for r in rows for _ in range(min(500, r[higher]))]
        np.random.default_rng(0).shuffle(samples)
        own[name] = samples

    def passages(batches):
        for batch in sliced(batches, "text"):
            out = []
            for text in utf8(batch, "text"):
                words = spaced_words(text)
                out += [b" " + b" ".join(words[i : i + PASSAGE_WORDS]) + b" " for i in range(0, len(words), PASSAGE_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["passage"])

    ordinary = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(_sample(labelled, {0: MAX_BASE_DOCS, 1: 0})), "id")
    ordinary = ordinary.select("text").mapInArrow(passages, "passage binary").orderBy(F.xxhash64("passage")).limit(MAX_BASE_PASSAGES)
    base = _trained([bytes(r["passage"]) for r in ordinary.collect()], BASE_BYTES)
    toxic, plain = (base + _trained(own[n], CLASS_BYTES, k=SEGMENT, d=6) for n in ("toxic", "ordinary"))

    held_out = texts.filter("fold = 0").select(F.col("toxic").cast("int"), "text")
    rows = held_out.mapInArrow(_per_text(Gains, (toxic, plain)), "toxic int, features array<double>").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)
    labels_of = {r["toxic"]: r["n"] for r in labelled.select("id", F.col("toxic").cast("int").alias("toxic")).distinct().groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weight = np.array([max(1.0, labels_of[int(t)] / most[int(t)]) for t in y])
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight)) + 1e-9
    weights, cut = _calibrated((x - mean) / scale, y, weight)
    weights[-1] += np.log(CUT / (1 - CUT)) - cut
    return Model(toxic, plain, mean, scale, weights)


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights, and the logit above which a text counts as toxic; ``weight`` is how many texts a row stands for.

    Few toxic texts are trusted less: they shrink the weights more. The limit is where texts, each
    scored by weights fitted without it, have the best F1 score among the limits above which
    half of the texts or more are toxic. It is drawn to a prior, the limit with
    PRIOR_SHARE as many texts above it as there are toxic ones, which counts like PRIOR_FOUND
    toxic texts found: the clearest texts are found on small tables as well.
    """
    ridge = max(1e-2, SHRINK / max(1.0, y.sum()))
    weight = np.ones(len(y)) if weight is None else weight
    weights = _logistic(x, y, ridge, weight)
    part = np.empty(len(y), dtype=int)
    for value in (0, 1):
        own = np.flatnonzero(y == value)
        part[own] = np.arange(len(own)) % CALIBRATION_PARTS
    logits = np.empty(len(y))
    for k in range(CALIBRATION_PARTS):
        others = part != k
        logits[~others] = np.c_[x[~others], np.ones((~others).sum())] @ _logistic(x[others], y[others], ridge, weight[others])
    order = np.argsort(-logits, kind="stable")
    hit, n = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    toxic = (weight * y).sum()
    f1 = np.where(2 * hit >= n, 2 * hit / (n + toxic), 0.0)
    best = int(np.argmax(f1))
    found = float(y[order][: best + 1].sum()) if f1[best] > 0 else 0.0
    own = np.c_[x, np.ones(len(x))] @ weights
    by_own = np.argsort(-own, kind="stable")
    ranked = [(logits[order], n), (own[by_own], np.cumsum(weight[by_own]))]
    # The lower of both: weights fitted without one of very few toxic texts say little, and all weights flatter their own texts.
    prior = min(_limit(x, min(int(np.searchsorted(above, PRIOR_SHARE * toxic)), len(y) - 1)) for x, above in ranked)
    return weights, float(np.average([_limit(logits[order], best), prior], weights=[found, PRIOR_FOUND]))


def _limit(falling: np.ndarray, place: int) -> float:
    """Halfway from a value to the next one."""
    after = falling[place + 1] if place + 1 < len(falling) else falling[place] - 1
    return float((falling[place] + after) / 2)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and a column with each whole text's score from 0 to 1; null counts as empty.

    A column of that name is replaced; ids, labels and other columns don't enter.
    """
    names = [c for c in docs.columns if c != score_col]

    def run(batches):
        gains = Gains(model.toxic, model.ordinary)
        for batch in sliced(batches, text_col):
            x = np.array([gains.features(t) for t in utf8(batch, text_col)]).reshape(batch.num_rows, -1)
            z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))] @ model.weights if len(x) else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*names, score_col])

    schema = docs.select(names).schema.add(score_col, "double")
    return docs.select(names).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, by a model fitted on their labelled ones."""
    return scored(docs, fit(docs, labels, text_col=text_col), text_col, "_score").filter(F.col("_score") < cut).drop("_score")
