"""Logistic regression by vector-free L-BFGS.

Minimises ``C * sum_i weight_i * log loss_i + |w|^2 / 2`` over coefficients w and free intercepts. Point, gradient and
the remembered steps are a table of term blocks; a step is a combination of them, found from their dot products
alone. The driver holds that small matrix, the intercepts, and nothing of the vocabulary's size. A step is one job:
from the table of one point to that of the next, with the loss there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.operators import blocks
from tonemill.runtime import work_table

#: Remembered steps; a block's row holds 2 * MEMORY + 2 vectors of its size.
MEMORY = 8
TOLERANCE = 1e-3


def step_weights(dots: np.ndarray, memory: int) -> np.ndarray:
    """Weights of the steps s, the gradient changes y and the gradient in the next direction: the two loops of L-BFGS
    on the dot products of these vectors, which stand in that order."""
    weights = np.zeros(2 * memory + 1)
    weights[-1] = -1.0
    alphas = np.zeros(memory)
    for i in reversed(range(memory)):
        alphas[i] = (weights @ dots[:, i]) / dots[i, memory + i]
        weights[memory + i] -= alphas[i]
    if memory:
        weights *= dots[memory - 1, 2 * memory - 1] / dots[2 * memory - 1, 2 * memory - 1]
    else:
        weights /= max(1.0, np.sqrt(dots[-1, -1]))
    for i in range(memory):
        weights[i] += alphas[i] - (weights @ dots[:, memory + i]) / dots[i, memory + i]
    return weights


def _losses(classes: int, width: int, weights: list[float]):
    """The weighted loss of rows with ``width`` scores each and its derivatives by them; nested, so that it travels by value."""

    def losses(target, found):
        import numpy as np

        scores = np.zeros((len(target), classes))
        scores[:, classes - width :] = found
        scores -= scores.max(axis=1, keepdims=True)
        total = np.log(np.exp(scores).sum(axis=1))
        weight = np.array(weights)[target]
        own = np.arange(len(target)), target
        loss = float(weight @ (total - scores[own]))
        lean = np.exp(scores - total[:, None])
        lean[own] -= 1.0
        return loss, (lean * weight[:, None])[:, classes - width :]

    return losses


def _evaluation(classes: int, width: int, weights: list[float]):
    """The weighted loss of one part's rows and its derivatives by coefficients and intercepts."""
    losses = _losses(classes, width, weights)

    def evaluate(row, local, bias):
        import numpy as np

        target, starts, places, values = row
        owner = np.repeat(np.arange(len(target)), np.diff(starts))
        scores = [np.bincount(owner, values * local[c, places], minlength=len(target)) + bias[c] for c in range(width)]
        loss, lean = losses(target, np.array(scores).T)
        by_term = np.array([np.bincount(places, values * lean[owner, c], minlength=local.shape[1]) for c in range(width)])
        return loss, by_term, lean.sum(axis=0)

    return evaluate


def _started(layout: blocks.Layout, classes: int, width: int, weights: list[float], penalty: float, parts: int) -> DataFrame:
    """(block, vector): the mean over parts of the coefficients that fit each part alone; their intercepts in block -1.

    A part stands for all, so its loss counts ``parts`` times. The fit is a plain descent with remembered steps in the part's task.
    """
    evaluate = _evaluation(classes, width, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def fit(row, terms):
            shape = (width, terms + 1)

            def objective(x):
                at = x.reshape(shape)
                loss, by_term, by_bias = evaluate(row, at[:, :-1], at[:, -1])
                slope = penalty * parts * np.c_[by_term, by_bias]
                slope[:, :-1] += at[:, :-1]
                return penalty * parts * loss + 0.5 * (at[:, :-1] ** 2).sum(), slope.ravel()

            x, past = np.zeros(width * (terms + 1)), []
            value, slope = objective(x)
            goal = 1e-4 * np.linalg.norm(slope)
            for _ in range(200):
                if np.linalg.norm(slope) <= goal:
                    break
                q, alphas = slope.copy(), []
                for s, y in reversed(past):
                    alphas.append((s @ q) / (s @ y))
                    q -= alphas[-1] * y
                q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(slope))
                for (s, y), alpha in zip(past, reversed(alphas)):
                    q += s * (alpha - (y @ q) / (s @ y))
                size = 1.0
                while True:
                    new, lean = objective(x - size * q)
                    if new <= value - 1e-4 * size * (slope @ q) or size < 1e-6:
                        break
                    size *= 0.5
                if size < 1e-6:
                    break
                past = [*past, (-size * q, lean - slope)][-10:]
                x, value, slope = x - size * q, new, lean
            return x.reshape(shape)

        for batch in batches:
            for i in range(batch.num_rows):
                *row, terms = (batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("target", "starts", "places", "values", "terms"))
                found = fit(row, len(terms)) / parts
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[terms, -1].astype(np.int64)), *[pa.array(found[c].copy()) for c in range(width)]], names=["term", *[f"g{c}" for c in range(width)]])

    return work_table(blocks.push(layout.parts.mapInArrow(run, blocks.flat_schema(width)), width), "start")


def _pushed(layout: blocks.Layout, point: DataFrame, bias: np.ndarray, classes: int, weights: list[float]) -> DataFrame:
    """(block, vector): derivatives of the weighted loss by the coefficients; the loss and those by the intercepts in block -1."""
    width = len(bias)
    evaluate = _evaluation(classes, width, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                *row, terms = (batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("target", "starts", "places", "values", "terms"))
                pulled = batch.column("pulled")[i]
                pieces = [p.values.to_numpy(zero_copy_only=False).reshape(width, -1) for p in pulled] if pulled.is_valid else []
                local = np.concatenate(pieces, axis=1) if pieces else np.zeros((width, 0))
                loss, by_term, by_bias = evaluate(row, local, bias)
                columns = [np.r_[by_term[c], by_bias[c], loss if c == 0 else 0.0] for c in range(width)]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[terms, -2, -1].astype(np.int64)), *map(pa.array, columns)], names=["term", *[f"g{c}" for c in range(width)]])

    flat = blocks.pull(layout, point, width).mapInArrow(run, blocks.flat_schema(width))
    return blocks.push(flat, width)


def _moved(state: DataFrame, weights: np.ndarray) -> DataFrame:
    """(block, vector): the point plus the weighted sum of the remembered vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            out = []
            for point, known in zip(batch.column("point"), batch.column("known")):
                point = point.values.to_numpy(zero_copy_only=False)
                if len(weights):
                    point = point + weights @ known.values.to_numpy(zero_copy_only=False).reshape(len(weights), len(point))
                out.append(point)
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.list_(pa.float64()))], names=["block", "vector"])

    return state.select("block", "point", "known").mapInArrow(run, "block long, vector array<double>")


def _advance(state: DataFrame, pushed: DataFrame, weights: np.ndarray, penalty: float, kept: int, width: int) -> DataFrame:
    """(block, point, known, dots): the state after a step, with its ``kept`` last steps.

    ``dots``: the products of the remembered vectors, and last the point's square. The row of block -1 has the loss and
    the derivatives by the intercepts there.
    """
    memory, block = (len(weights) - 1) // 2, blocks.BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            points, knowns, dots = [], [], []
            for old, known, slope in zip(*(batch.column(n) for n in ("point", "known", "vector"))):
                slope = slope.values.to_numpy(zero_copy_only=False) if slope.is_valid else 0.0
                if not old.is_valid:
                    sums = slope.reshape(width, block)
                    points.append(None)
                    knowns.append(None)
                    dots.append(np.r_[sums[0, -1], sums[:, -2]])
                    continue
                old = old.values.to_numpy(zero_copy_only=False)
                known = known.values.to_numpy(zero_copy_only=False).reshape(-1, len(old)) if len(weights) else np.zeros((0, len(old)))
                step = weights @ known if len(weights) else np.zeros(len(old))
                point = old + step
                slope = point + penalty * slope
                if len(weights):
                    steps, changes = [*known[:memory], step][-kept:], [*known[memory:-1], slope - known[-1]][-kept:]
                    known = np.array([*steps, *changes, slope])
                else:
                    known = slope[None, :]
                points.append(point)
                knowns.append(known.ravel())
                dots.append(np.r_[(known @ known.T).ravel(), point @ point])
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), *[pa.array(x, pa.list_(pa.float64())) for x in (points, knowns, dots)]], names=["block", "point", "known", "dots"]
            )

    met = pushed.join(state.drop("dots"), "block", "full").select("block", "point", "known", "vector")
    return work_table(met.mapInArrow(run, "block long, point array<double>, known array<double>, dots array<double>"), "state")


def _sums(state: DataFrame, memory: int) -> tuple[np.ndarray, float, float, np.ndarray]:
    """The matrix of products and the point's square summed over blocks, the loss, its derivatives by the intercepts: some hundred numbers."""
    rows = state.select((F.col("block") < 0).alias("whole"), F.posexplode("dots").alias("at", "dot")).groupBy("whole", "at").agg(F.sum("dot").alias("dot")).collect()
    of = lambda whole: np.array([r["dot"] for r in sorted((r for r in rows if r["whole"] == whole), key=lambda r: r["at"])])
    products, told, n = of(False), of(True), 2 * memory + 1
    return products[:-1].reshape(n, n), float(products[-1]), float(told[0]), told[1:]


def solve(
    layout: blocks.Layout, classes: int, weights: list[float], penalty: float, max_iter: int = 300, tolerance: float = TOLERANCE, memory: int = MEMORY
) -> tuple[DataFrame, np.ndarray]:
    """((block, vector) table of coefficients, intercepts), at a gradient ``tolerance`` times as long as that at zero.

    ``weights`` are the classes' weights. With two classes there is one row of coefficients, the second class's, else one a class.
    """
    width, none, unknown = 1 if classes == 2 else classes, np.zeros(0), F.lit(None).cast("array<double>").alias("known")

    def begin(point: DataFrame, bias: np.ndarray) -> tuple:
        state = point.select("block", F.col("vector").alias("point"), unknown)
        state = _advance(state, _pushed(layout, point, bias, classes, weights), none, penalty, 0, width)
        return state, *_sums(state, 0)

    bias = np.zeros(width)
    state, dots, _, loss, lean = begin(layout.blocks.select("block", F.array_repeat(F.lit(0.0), width * blocks.BLOCK).alias("vector")), bias)
    value, known = penalty * loss, penalty * lean[None, :]
    goal = tolerance * np.sqrt(dots[-1, -1] + known[-1] @ known[-1])
    start = _started(layout, classes, width, weights, penalty, layout.parts.count())
    at = np.array(start.filter(F.col("block") == blocks.SUMS).select(F.array(*[F.element_at("vector", (c + 1) * blocks.BLOCK) for c in range(width)])).first()[0])
    state_there, dots_there, square, loss, lean = begin(start.filter(F.col("block") >= 0), at)
    if penalty * loss + 0.5 * square < value:
        state, dots, bias, value, known = state_there, dots_there, at, penalty * loss + 0.5 * square, penalty * lean[None, :]
    kept = 0
    for _ in range(max_iter):
        here = state.filter(F.col("block") >= 0)
        inner = dots + known @ known.T
        if np.sqrt(inner[-1, -1]) <= goal:
            break
        step, size, keep = step_weights(inner, kept), 1.0, min(kept + 1, memory)
        slope = float(step @ inner[:, -1])
        while True:
            moved = size * step
            shift = moved @ known
            tried = _advance(here, _pushed(layout, _moved(here, moved), bias + shift, classes, weights), moved, penalty, keep, width)
            new_dots, square, loss, lean = _sums(tried, keep)
            reached = penalty * loss + 0.5 * square
            if reached <= value + 1e-4 * size * slope or size < 1e-6:
                break
            size *= 0.5
        if size < 1e-6:
            break
        known = np.array([*[*known[:kept], shift][-keep:], *[*known[kept:-1], penalty * lean - known[-1]][-keep:], penalty * lean])
        state, bias, value, dots, kept = tried, bias + shift, reached, new_dots, keep
    return _moved(state.filter(F.col("block") >= 0), none), bias
