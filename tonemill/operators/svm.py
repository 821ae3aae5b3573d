"""One-vs-rest linear SVM with squared hinge loss, by dual coordinate descent with a duality gap as certificate.

Per class ``|w|^2 / 2 + C * sum_i weight_i * max(0, 1 - y_i * (w.x_i + b))^2`` is minimised, the intercept penalised
like a feature of value one; Spark's own linear SVM minimises the plain hinge, whose optimum differs. Each part of
the rows holds its own dual variables and improves them against the common point. It counts what it moves in a
term as often as parts hold that term, a bound on what all of them may do to it together. So the parts' changes can be
added up; the dual objective, a parabola along their sum, gives the best share of it to take. The
point is a table of term blocks; the driver holds a few sums a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.operators import blocks
from tonemill.runtime import work_table

#: Passes of a part over its rows in each round, and the gap, as a share of the objective, that ends the search.
EPOCHS = 15
GAP = 1e-5


@dataclass(frozen=True)
class Certificate:
    """``gap``: by class, how far the objective can be above its minimum, as a share of it; ``rounds`` taken."""

    gap: np.ndarray
    rounds: int


def _improve(
    layout: blocks.Layout, point: DataFrame, duals: DataFrame | None, bias: np.ndarray, taken: np.ndarray, costs: list[float], parts: int
) -> DataFrame:
    """(part, alpha, change, pushed, sums): each part's duals, their change by local descent, what that adds to the point.

    ``taken`` is the share of the last change that was taken; ``costs`` is C times each class's weight.
    """
    width, epochs = len(bias), EPOCHS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                target, starts, places, values, terms = (
                    batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in ("target", "starts", "places", "values", "terms")
                )
                pulled = batch.column("pulled")[row]
                pieces = [p.values.to_numpy(zero_copy_only=False).reshape(width, -1) for p in pulled] if pulled.is_valid else []
                begun = np.r_[np.concatenate(pieces, axis=1).T if pieces else np.zeros((0, width)), bias[None, :]]
                n = len(target)
                alpha = np.zeros((n, width))
                if "alpha" in batch.schema.names and batch.column("alpha")[row].is_valid:
                    alpha, last = (batch.column(c)[row].values.to_numpy(zero_copy_only=False).reshape(n, width) for c in ("alpha", "change"))
                    alpha = np.maximum(alpha + taken * last, 0.0)
                sign = np.where(target[:, None] == np.arange(width)[None, :], 1.0, -1.0)
                half = 0.5 / np.array(costs)[target]
                owner = np.repeat(np.arange(n), np.diff(starts))
                margin = np.stack([np.bincount(owner, values * begun[places, c], minlength=n) + bias[c] for c in range(width)], axis=1)
                loss = (np.maximum(0.0, 1.0 - sign * margin) ** 2 / (2 * half[:, None])).sum(axis=0)
                dual = (alpha - 0.5 * half[:, None] * alpha**2).sum(axis=0)
                sharing = batch.column("sharing")[row].values.to_numpy(zero_copy_only=False)
                square = np.bincount(owner, values * values * sharing[places], minlength=n) + parts + half
                often = np.r_[sharing, float(parts)]
                fresh, here, shared = alpha.copy(), begun.copy(), sharing[places] * values
                bounds, order = starts.tolist(), np.random.default_rng(n)
                for _ in range(epochs):
                    for i in order.permutation(n).tolist():
                        at, x = places[bounds[i] : bounds[i + 1]], values[bounds[i] : bounds[i + 1]]
                        pull = sign[i] * (x @ here[at] + here[-1]) - 1.0 + half[i] * fresh[i]
                        new = np.maximum(0.0, fresh[i] - pull / square[i])
                        move = (new - fresh[i]) * sign[i]
                        fresh[i] = new
                        here[at] += shared[bounds[i] : bounds[i + 1], None] * move
                        here[-1] += parts * move
                change, added = fresh - alpha, (here - begun) / often[:, None]
                linear = (change - half[:, None] * alpha * change).sum(axis=0)
                sums = np.concatenate([loss, dual, linear, (half[:, None] * change**2).sum(axis=0), added[-1]])
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": batch.column("part").slice(row, 1), "alpha": pa.array([alpha.ravel()], pa.list_(pa.float64())), "change": pa.array([change.ravel()], pa.list_(pa.float64())),
                        "terms": pa.array([terms], pa.list_(pa.int64())), "added": pa.array([added[:-1].ravel()], pa.list_(pa.float64())), "sums": pa.array([sums], pa.list_(pa.float64())),
                    }
                )

    met = blocks.pull(layout, point, width)
    if duals is not None:
        met = met.join(duals.select("part", "alpha", "change"), "part")
    improved = met.mapInArrow(run, "part long, alpha array<double>, change array<double>, terms array<long>, added array<double>, sums array<double>")
    return work_table(improved, "duals")


def _flat(duals: DataFrame, width: int) -> DataFrame:
    """(term, g0, ...) of the parts' additions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            added = batch.column("added").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column("terms").flatten(), *[pa.array(added[:, c].copy()) for c in range(width)]], names=["term", *[f"g{c}" for c in range(width)]])

    return duals.select("terms", "added").mapInArrow(run, blocks.flat_schema(width))


def _direction(point: DataFrame, duals: DataFrame, width: int) -> DataFrame:
    """(block, vector, step, products): the point, the sum of additions, and by class |point|^2, point.step, |step|^2."""
    block = blocks.BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            steps, products = [], []
            for vector, step in zip(batch.column("vector"), batch.column("step")):
                here = vector.values.to_numpy(zero_copy_only=False).reshape(width, block)
                step = step.values.to_numpy(zero_copy_only=False).reshape(width, block) if step.is_valid else np.zeros((width, block))
                steps.append(step.ravel())
                products.append(np.concatenate([(here * here).sum(axis=1), (here * step).sum(axis=1), (step * step).sum(axis=1)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("vector"), *[pa.array(x, pa.list_(pa.float64())) for x in (steps, products)]], names=["block", "vector", "step", "products"]
            )

    pushed = blocks.push(_flat(duals, width), width).withColumnRenamed("vector", "step")
    met = point.join(pushed, "block", "left").select("block", "vector", "step")
    return work_table(met.mapInArrow(run, "block long, vector array<double>, step array<double>, products array<double>"), "direction")


def _taken(direction: DataFrame, share: np.ndarray) -> DataFrame:
    """(block, vector): the point after each class's share of the step."""
    width, block = len(share), blocks.BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            out = []
            for vector, step in zip(batch.column("vector"), batch.column("step")):
                step = step.values.to_numpy(zero_copy_only=False).reshape(width, block) * share[:, None]
                out.append(vector.values.to_numpy(zero_copy_only=False) + step.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.list_(pa.float64()))], names=["block", "vector"])

    return direction.select("block", "vector", "step").mapInArrow(run, "block long, vector array<double>")


def _sums(df: DataFrame, column: str, shape: tuple[int, int]) -> np.ndarray:
    rows = df.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # a few a class
    return np.array([r["x"] for r in sorted(rows, key=lambda r: r["at"])]).reshape(shape)


def solve(
    layout: blocks.Layout, classes: int, weights: list[float], penalty: float, max_iter: int = 200, gap: float = GAP
) -> tuple[DataFrame, np.ndarray, Certificate]:
    """((block, vector) coefficients, intercepts, certificate), at a duality gap of ``gap`` times the objective or less in every class."""
    costs = [penalty * w for w in weights]
    point = layout.blocks.select("block", F.array_repeat(F.lit(0.0), classes * blocks.BLOCK).alias("vector"))
    bias, share, duals = np.zeros(classes), np.zeros(classes), None
    layout, parts = blocks.with_sharing(layout), layout.parts.count()
    for done in range(max_iter + 1):
        duals = _improve(layout, point, duals, bias, share, costs, parts)
        loss, dual, linear, square, shift = _sums(duals, "sums", (5, classes))
        direction = _direction(point, duals, classes)
        length, along, step = _sums(direction, "products", (3, classes))
        length, along, step = length + bias**2, along + bias * shift, step + shift**2
        primal = 0.5 * length + loss
        left = (primal - (dual - 0.5 * length)) / np.maximum(primal, 1e-300)
        if (left <= gap).all() or done == max_iter:
            break
        share = np.clip((linear - along) / np.maximum(step + square, 1e-300), 0.0, 1.0)
        point, bias = _taken(direction, share), bias + share * shift
    return direction.select("block", "vector"), bias, Certificate(left, done)
