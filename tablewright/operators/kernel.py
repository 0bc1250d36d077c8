"""Support vector ids on many rows: the same losses over random Fourier features that are formed anew in every
pass. What is kept of a row are its inputs and label, not its 200 features; the passes are few, as the minimiser
works in coordinates in which the features are uncorrelated (one pass adds up their products)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learners import FourierFeatures
from .neighbors import matrix
from .preparation import FEATURES

STRIP_ROWS = 2048
MEMORY = 20
# (value, gradient) of a point; the gradient is of the point's length
Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class KernelMachine(FourierFeatures):
    """prediction = intercept + weights . features of the row, or for two classes whether that is above zero."""

    weights = Param(Params._dummy(), "weights", "slope per feature", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "offset", TypeConverters.toFloat)
    binary = Param(Params._dummy(), "binary", "two classes", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, size=None, inputs=None, gamma=None, seed=None, weights=None, intercept=None, binary=None):
        super().__init__()
        self._setup(size=size, inputs=inputs, gamma=gamma, seed=seed, weights=weights, intercept=intercept, binary=binary)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        project, phase = self.draws()
        weights, intercept = self.floats("weights"), self.getOrDefault("intercept")

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            rows = matrix(x)
            return pd.Series(np.concatenate([z @ weights for _, z in strips(rows, project, phase)]) + intercept)

        value = score(vector_to_array(FEATURES))
        return dataset.withColumn("prediction", (value > 0).cast("double") if self.getOrDefault("binary") else value)


def strips(rows: np.ndarray, project: np.ndarray, phase: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The cosine features of a few rows at a time. Cosines are taken in single precision."""
    project, phase, scale = project.astype(np.float32), phase.astype(np.float32), np.sqrt(2.0 / len(phase))
    for at in range(0, max(1, len(rows)), STRIP_ROWS):
        here = slice(at, at + STRIP_ROWS)
        yield here, np.cos(rows[here].astype(np.float32) @ project + phase).astype(float) * scale


def _added(blocks: DataFrame, width: int, fold: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``fold(x, y)`` of every block, added up in the order of the parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch.itertuples():
                y = np.frombuffer(block.y)
                yield pd.DataFrame({"sums": [np.asarray(fold(np.frombuffer(block.x).reshape(len(y), width), y), dtype=float).tobytes()]})

    return sum(np.frombuffer(r["sums"]) for r in blocks.mapInPandas(run, "sums binary").collect())


def minimise(objective: Objective, start: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Limited-memory BFGS with steps found by bisection (weak Wolfe conditions), which kinks do not mislead."""
    point, (value, slope) = start, objective(start)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    small = 0
    for _ in range(rounds):
        direction, alphas = -slope, []
        for s, y in reversed(moves):
            alphas.append(s @ direction / (s @ y))
            direction = direction - alphas[-1] * y
        if moves:
            s, y = moves[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / max(1.0, np.linalg.norm(direction))
        for (s, y), a in zip(moves, reversed(alphas)):
            direction = direction + (a - y @ direction / (s @ y)) * s
        steep = slope @ direction
        if not steep < 0:
            break
        low, high, step, found = 0.0, np.inf, 1.0, None
        for _ in range(25):
            there = point + step * direction
            v, g = objective(there)
            if not v <= value + 1e-4 * step * steep:
                high = step
            else:
                found = (there, v, g)
                if g @ direction >= 0.9 * steep:
                    break
                low = step
            step = 2.0 * low if high == np.inf else (low + high) / 2
        if found is None:
            break
        moved, changed = found[0] - point, found[2] - slope
        small = small + 1 if value - found[1] <= tolerance * abs(found[1]) else 0
        point, value, slope = found
        if moved @ changed > 0:
            moves = [*moves[-(MEMORY - 1) :], (moved, changed)]
        if small >= 2:
            break
    return point


def fit_kernel_machine(
    train: DataFrame, kernel: FourierFeatures, rows: int, mean: float, deviation: float, binary: bool, epsilon: float = 1.35
) -> KernelMachine:
    """Hinge loss (labels 0 and 1) or Huber's loss with its scale, plus half the squared weights of the standardised
    features over the rows; ``train`` has features and label."""
    project, phase = kernel.draws()
    width, size = project.shape
    centre, unit = (0.0, 1.0) if binary else (mean, deviation or 1.0)
    # in units of the label's deviation the penalty keeps its share
    penalty = unit / rows

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(matrix(b["x"]), b["label"].to_numpy(dtype=float)) for b in batches if len(b)]
        if parts:
            x, y = (np.concatenate(v) for v in zip(*parts))
            y = 2.0 * y - 1.0 if binary else (y - centre) / unit
            yield pd.DataFrame({"x": [x.tobytes()], "y": [y.tobytes()]})

    blocks = train.select(vector_to_array(FEATURES).alias("x"), F.col("label").cast("double").alias("label")).mapInPandas(packed, "x binary, y binary").persist()
    try:
        def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            total = np.zeros((size + 1, size + 1))
            for _, z in strips(x, project, phase):
                z = np.c_[z, np.ones(len(z))]
                total += z.T @ z
            return total.ravel()

        gram = _added(blocks, width, products).reshape(size + 1, size + 1) / rows
        spread = np.sqrt(np.maximum((np.diag(gram) - gram[-1] ** 2)[:-1], 0.0) * rows / max(1, rows - 1))
        by = np.r_[np.divide(1.0, spread, out=np.zeros(size), where=spread > 1e-9), 1.0]
        shape = gram * by[:, None] * by[None, :] + np.diag(np.r_[np.full(size, penalty), 0.0]) + 1e-9 * np.eye(size + 1)
        shape[np.diag_indices(size)] += by[:-1] == 0
        # weights = turn @ point has a curvature of about one in every direction
        turn = np.linalg.inv(np.linalg.cholesky(shape)).T

        def hinge(point: np.ndarray) -> tuple[float, np.ndarray]:
            weights = turn @ point
            slopes, offset = weights[:-1] * by[:-1], weights[-1]

            def fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                total = np.zeros(size + 2)
                for here, z in strips(x, project, phase):
                    short = 1.0 - y[here] * (z @ slopes + offset)
                    pull = np.where(short > 0, -y[here], 0.0)
                    total += np.r_[pull @ z, pull.sum(), short[short > 0].sum()]
                return total

            total = _added(blocks, width, fold) / rows
            slope = total[:-1] * by + penalty * np.r_[weights[:-1], 0.0]
            return total[-1] + penalty / 2 * (weights[:-1] @ weights[:-1]), turn.T @ slope

        def huber(point: np.ndarray) -> tuple[float, np.ndarray]:
            weights, sigma = turn @ point[:-1], float(np.exp(point[-1]))
            slopes, offset = weights[:-1] * by[:-1], weights[-1]

            def fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                total = np.zeros(size + 3)
                for here, z in strips(x, project, phase):
                    r = (z @ slopes + offset - y[here]) / sigma
                    near = np.abs(r) <= epsilon
                    pull = np.clip(r, -epsilon, epsilon)
                    loss = np.where(near, 1.0 + r * r, 1.0 + 2.0 * epsilon * np.abs(r) - epsilon**2).sum() * sigma / 2
                    total += np.r_[pull @ z, pull.sum(), np.where(near, 1.0 - r * r, 1.0 - epsilon**2).sum() * sigma / 2, loss]
                return total

            total = _added(blocks, width, fold) / rows
            slope = total[: size + 1] * by + penalty * np.r_[weights[:-1], 0.0]
            return total[-1] + penalty / 2 * (weights[:-1] @ weights[:-1]), np.r_[turn.T @ slope, total[size + 1]]

        if binary:
            weights = turn @ minimise(hinge, np.zeros(size + 1), 60, 1e-4)
        else:
            weights = turn @ minimise(huber, np.zeros(size + 2), 200, 1e-5)[:-1]
    finally:
        blocks.unpersist()
    return KernelMachine(
        **{n: kernel.getOrDefault(n) for n in ("size", "inputs", "gamma", "seed")},
        weights=(weights[:-1] * by[:-1] * unit).tolist(), intercept=float(weights[-1] * unit + centre), binary=binary,
    )
