"""Logistic regression and linear SVM over a vocabulary that ``max_features`` bounds, by L-BFGS.

A pass is one job: tasks get the coefficients as a broadcast, evaluate their parts of the rows and add up one gradient each;
the gradients meet by block of terms. Parts are stored as bytes, which tasks view as arrays: an entry whose value is one is its
term alone, and what rows and terms are scaled by is kept once a row and once a term. Passes run over the parts as dealt once, as
many to each task, and kept where executors have room: a pass converts no values and plans no query. The driver holds the coefficients, as a broadcast join of the bounded vocabulary
does, and the remembered steps, never rows. Vocabularies without a bound are left to the solvers over term blocks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tonemill.operators import blocks, logistic, svm

#: Remembered steps, and the coefficients of a class in one row of the exchange.
MEMORY = 30
BLOCK = 4096
#: Rows that a part has at least before rows are dealt to more parts than ``blocks.PART_ROWS`` asks for, up to one a core.
LEAST_ROWS = 256
#: Tasks of a pass for each core, and rows that a task scores together, so that what it makes of their entries stays in the core's cache.
CORE_TASKS = 2
SLICE = 512
#: A part's arrays, as bytes. By row: its class, its scale, and its entries; the entries' terms; by row the entries whose value
#: isn't one; their terms, and the places in ``levels`` of what they are above one. Terms and places are unsigned, in as few bytes as do.
ARRAYS = {"target": "i4", "scale": "f8", "counts": "i4", "terms": "", "others": "i4", "other_terms": "", "places": "", "levels": "f8"}


def term_rows(spark: SparkSession, coefficients: np.ndarray) -> DataFrame:
    """(term_id, c0, c1, ...) of one row of coefficients a class."""
    columns = {f"c{c}": pa.array(row) for c, row in enumerate(coefficients)}
    return spark.createDataFrame(pa.table({"term_id": pa.array(np.arange(coefficients.shape[1], dtype=np.int32)), **columns}))


def _tasks(parts: int, cores: int) -> int:
    """Tasks of a pass over so many parts."""
    return parts if parts <= cores else min(parts, CORE_TASKS * cores)


def packed(rows: DataFrame, count: int, scale: Column | None = None) -> DataFrame:
    """(number, the columns of ``ARRAYS``), a part a row, of ``count`` sparse rows: target and features STRUCT<indices, values, ...>.

    ``scale`` multiplies a row's values.
    """
    most, cores = blocks.PART_ROWS, rows.sparkSession.sparkContext.defaultParallelism
    number = max(-(-count // most), min(cores, -(-count // LEAST_ROWS)), 1)
    if number > cores:  # as many to each task
        number = -(-number // (CORE_TASKS * cores)) * CORE_TASKS * cores
    arrays = dict(ARRAYS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        def narrow(values):
            return values.astype(np.min_scalar_type(int(values.max(initial=0))))

        at = TaskContext.get().partitionId()
        for whole in batches:
            for low in range(0, whole.num_rows, most):
                batch = whole.slice(low, most)
                counts = np.diff(batch.column("indices").offsets.to_numpy())
                terms = batch.column("indices").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(counts)), counts)
                order = np.argsort(owner * (terms.max(initial=0) + 1) + terms, kind="stable")  # sums don't depend on how entries arrived
                terms, values = terms[order], batch.column("values").flatten().to_numpy(zero_copy_only=False)[order]
                other = values != 1.0
                levels, places = np.unique(values[other] - 1.0, return_inverse=True)
                found = {
                    "target": batch.column("target").to_numpy(zero_copy_only=False), "scale": batch.column("scale").to_numpy(zero_copy_only=False),
                    "counts": counts, "terms": narrow(terms), "others": np.bincount(owner[other], minlength=len(counts)),
                    "other_terms": narrow(terms[other]), "places": narrow(places), "levels": levels,
                }
                columns = {n: pa.array([found[n].astype(kind or found[n].dtype).tobytes()], pa.binary()) for n, kind in arrays.items()}
                yield pa.RecordBatch.from_pydict({"number": pa.array([at], pa.int32()), **columns})
                at += number

    schema = "number int, " + ", ".join(f"{n} binary" for n in ARRAYS)
    plain = rows.repartition(number).select("target", "features.indices", "features.values", (F.lit(1.0) if scale is None else scale).alias("scale"))
    return plain.mapInArrow(pack, schema)


def dealt(parts: DataFrame) -> RDD:
    """``packed`` rows, as many to each task of a pass, kept by executors once a pass has met them; parts without room go to their disks."""
    spark = parts.sparkSession
    tasks = _tasks(parts.count(), spark.sparkContext.defaultParallelism)
    return parts.repartitionById(tasks, F.col("number") % tasks).select(*ARRAYS).rdd.persist(StorageLevel.MEMORY_AND_DISK)


def _summed(parts: RDD, at: np.ndarray, evaluate: Callable, power: int = 1) -> np.ndarray:
    """Sums over all rows: by class the derivatives by term and intercept, and the loss last.

    ``evaluate`` gives the losses by class and the derivatives by class and row, from targets and scores by class and row.
    ``power`` is that of the values by which the derivatives by term weigh rows.
    """
    (width, size), block, step, arrays = at.shape, BLOCK, SLICE, dict(ARRAYS)
    sent = parts.context.broadcast(at)

    def run(rows: Iterator[Row]) -> Iterator[tuple[int, np.ndarray]]:
        import numpy as np

        def by_row(values, counts):
            found, filled = np.zeros(len(counts)), counts > 0
            if len(values):
                found[filled] = np.add.reduceat(values, (np.cumsum(counts) - counts)[filled])
            return found

        def wide(data, count):
            return np.frombuffer(data, f"u{len(data) // count}" if count else "u1")

        at, total = sent.value, np.zeros((width, size + 1))
        for row in rows:
            target, scale, counts, others, levels = (np.frombuffer(row[n], arrays[n]) for n in ("target", "scale", "counts", "others", "levels"))
            ends, other_ends = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(others))
            terms, other_terms, places = wide(row["terms"], ends[-1]), wide(row["other_terms"], other_ends[-1]), wide(row["places"], other_ends[-1])
            above = levels if power == 1 else (1.0 + levels) ** power - 1.0
            for low in range(0, len(target), step):
                own = slice(low, low + step)
                last = min(low + step, len(target))
                here, there = slice(ends[low], ends[last]), slice(other_ends[low], other_ends[last])
                met, other, place = terms[here].astype(np.intp), other_terms[there].astype(np.intp), places[there].astype(np.intp)
                scores, more = np.empty((width, last - low)), levels.take(place)
                for c in range(width):
                    scores[c] = by_row(at[c].take(met), counts[own]) + by_row(at[c].take(other) * more, others[own])
                scores = scores * scale[own] + at[:, -1:]
                loss, pulls = evaluate(target[own], scores)
                total[:, -2] += pulls.sum(axis=1)
                total[:, -1] += loss
                pulls, more = pulls * scale[own] ** power, above.take(place)
                for c in range(width):
                    total[c, :-2] += np.bincount(met, np.repeat(pulls[c], counts[own]), minlength=size - 1)
                    total[c, :-2] += np.bincount(other, np.repeat(pulls[c], others[own]) * more, minlength=size - 1)
        yield from ((low, total[:, low : low + block]) for low in range(0, size + 1, block))

    met = parts.mapPartitions(run).reduceByKey(lambda a, b: a + b, min(parts.context.defaultParallelism, -(-size // block)))
    found = dict(met.collect())  # as many numbers as coefficients
    sent.destroy()
    return np.concatenate([found[low] for low in sorted(found)], axis=1)


def _scale(parts: RDD, width: int, factors: np.ndarray, weights: list[float], factor: float, free: bool) -> np.ndarray:
    """The root of a bound on the diagonal of the objective's second derivatives, by which steps are scaled."""

    def weight(target, scores):
        import numpy as np

        return 0.0, np.array(weights)[target][None, :]

    scale = 1.0 + factor * factors**2 * _summed(parts, np.zeros((1, len(factors))), weight, 2)[:, :-1]
    scale[:, -1] -= 1.0 if free else 0.0
    return np.repeat(np.sqrt(np.maximum(scale, 1e-12)), width, axis=0)


def _minimise(objective: Callable, done: Callable, point: np.ndarray, scale: np.ndarray, max_iter: int, apart: bool) -> tuple[np.ndarray, tuple, int]:
    """(point, its evaluation, steps): L-BFGS from ``point`` until ``done``; ``objective`` gives (value, gradient, ...).

    ``apart``: the classes have an objective each, so each has its own products of the remembered steps.
    """

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray | float:
        return (a * b).sum(axis=1, keepdims=True) if apart else (a * b).sum()

    here, past, steps = objective(point), deque(maxlen=MEMORY), 0
    while steps < max_iter and not done(here):
        direction, alphas = here[1].copy(), []
        for s, y in reversed(past):
            alphas.append(dot(s, direction) / np.maximum(dot(s, y), 1e-300))
            direction = direction - alphas[-1] * y
        direction = direction / scale
        if past:
            s, y = past[-1]
            direction = direction * (dot(s, y) / np.maximum(dot(y, y / scale), 1e-300))
        for (s, y), alpha in zip(past, reversed(alphas)):
            direction = direction + s * (alpha - dot(y, direction) / np.maximum(dot(s, y), 1e-300))
        slope, size = (here[1] * direction).sum(), 1.0
        while True:
            tried = objective(point - size * direction)
            if tried[0] <= here[0] - 1e-4 * size * slope or size < 1e-6:
                break
            size *= 0.5
        if size < 1e-6:
            break
        past.append((-size * direction, tried[1] - here[1]))
        point, here, steps = point - size * direction, tried, steps + 1
    return point, here, steps


def fit_logistic(
    parts: RDD, factors: np.ndarray, classes: int, weights: list[float], penalty: float, max_iter: int = 300, tolerance: float = logistic.TOLERANCE
) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercepts) of the objective of ``logistic.solve``, by its rule to stop.

    ``factors`` multiply the values of ``parts`` by term; the last is the intercept's, one.
    """
    width = 1 if classes == 2 else classes
    inner = logistic._losses(classes, width, weights)

    def evaluate(target, scores):
        import numpy as np

        loss, lean = inner(target, scores.T)
        return np.r_[loss, np.zeros(width - 1)], lean.T

    def objective(at):
        sums = _summed(parts, at * factors, evaluate)
        gradient = penalty * factors * sums[:, :-1]
        gradient[:, :-1] += at[:, :-1]
        return penalty * sums[:, -1].sum() + 0.5 * (at[:, :-1] ** 2).sum(), gradient

    lengths: list[float] = []

    def done(here):
        lengths.append(float(np.linalg.norm(here[1])))
        return lengths[-1] <= tolerance * lengths[0]

    scale = _scale(parts, width, factors, weights, penalty * (1 - 1 / classes) / classes, True)
    point, _, _ = _minimise(objective, done, np.zeros((width, len(factors))), scale, max_iter, False)
    return point[:, :-1], point[:, -1]


def fit_svm(
    parts: RDD, factors: np.ndarray, classes: int, weights: list[float], penalty: float, max_iter: int = 200, gap: float = svm.GAP
) -> tuple[np.ndarray, np.ndarray, svm.Certificate]:
    """(coefficients, intercepts, certificate) of the objective of ``svm.solve``; ``factors`` as in ``fit_logistic``.

    With the dual variables that the margins at a point imply, the duality gap there is half the square of the gradient.
    """
    costs = [penalty * w for w in weights]

    def evaluate(target, scores):
        import numpy as np

        cost = np.array(costs)[target]
        sign = np.where(target == np.arange(classes)[:, None], 1.0, -1.0)
        slack = np.maximum(0.0, 1.0 - sign * scores)
        return slack**2 @ cost, -2.0 * cost * slack * sign

    def objective(at):
        sums = _summed(parts, at * factors, evaluate)
        values = sums[:, -1] + 0.5 * (at**2).sum(axis=1)
        gradient = factors * sums[:, :-1] + at
        left = 0.5 * (gradient**2).sum(axis=1) / np.maximum(values, 1e-300)
        return values.sum(), gradient, left

    scale = _scale(parts, classes, factors, weights, 2.0 * penalty, False)
    point, here, steps = _minimise(objective, lambda here: (here[2] <= gap).all(), np.zeros((classes, len(factors))), scale, max_iter, True)
    return point[:, :-1], point[:, -1], svm.Certificate(here[2], steps)
