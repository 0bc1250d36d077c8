"""Pipeline stages for learners that MLlib has no class for. All of them save and load with a pipeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import matrix
from .partials import gram, summed
from .preparation import FEATURES


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Base for stages whose state is a few lists of numbers."""

    def _setup(self, **values: object) -> None:
        self._set(**{k: v for k, v in values.items() if v is not None})

    def floats(self, name: str) -> np.ndarray:
        return np.array(self.getOrDefault(name), dtype=float)


class QuadraticScorer(_Stage):
    """Class scores constant - (x - mean)' P (x - mean) / 2; one P per class or one for all."""

    means = Param(Params._dummy(), "means", "class means, flattened", TypeConverters.toListFloat)
    precisions = Param(Params._dummy(), "precisions", "precision matrices, flattened", TypeConverters.toListFloat)
    constants = Param(Params._dummy(), "constants", "log priors and determinants", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, means=None, precisions=None, constants=None):
        super().__init__()
        self._setup(means=means, precisions=precisions, constants=constants)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        constants = self.floats("constants")
        means = self.floats("means").reshape(len(constants), -1)
        d = means.shape[1]
        precisions = self.floats("precisions").reshape(-1, d, d)

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            values = matrix(x)
            out = np.empty((len(values), len(constants)))
            for c in range(len(constants)):
                diff = values - means[c]
                out[:, c] = constants[c] - 0.5 * np.einsum("ij,jk,ik->i", diff, precisions[c % len(precisions)], diff)
            out -= out.max(axis=1, keepdims=True)
            out = np.exp(out)
            return pd.Series(list(out / out.sum(axis=1, keepdims=True)), dtype=object)

        scored = dataset.withColumn("probability", score(vector_to_array(FEATURES)))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumn("prediction", best.cast("double"))


class LinearScorer(_Stage):
    """prediction = intercept + coefficients . x, as one column expression."""

    coefficients = Param(Params._dummy(), "coefficients", "slopes", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "offset", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, coefficients=None, intercept=None):
        super().__init__()
        self._setup(coefficients=coefficients, intercept=intercept)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(v)) for v in self.floats("coefficients")])
        terms = F.zip_with(vector_to_array(FEATURES), weights, lambda x, w: x * w)
        total = F.aggregate(terms, F.lit(float(self.getOrDefault("intercept"))), lambda s, v: s + v)
        return dataset.withColumn("prediction", total)


class FourierFeatures(_Stage):
    """Random cosine features approximating a Gaussian kernel (Rahimi & Recht 2007)."""

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    inputs = Param(Params._dummy(), "inputs", "input width", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel coefficient", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the projection", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, size=None, inputs=None, gamma=None, seed=None):
        super().__init__()
        self._setup(size=size, inputs=inputs, gamma=gamma, seed=seed)

    def draws(self) -> tuple[np.ndarray, np.ndarray]:
        """The projection and the phases."""
        size, inputs = self.getOrDefault("size"), self.getOrDefault("inputs")
        rng = np.random.default_rng(self.getOrDefault("seed"))
        project = rng.normal(0.0, np.sqrt(2.0 * self.getOrDefault("gamma")), (inputs, size))
        return project, rng.uniform(0.0, 2.0 * np.pi, size)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size = self.getOrDefault("size")
        project, phase = self.draws()

        @F.pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.sqrt(2.0 / size) * np.cos(matrix(x) @ project + phase)), dtype=object)

        return dataset.withColumn("kernel_features", array_to_vector(lift(vector_to_array(FEATURES))))


def fit_discriminant(train: DataFrame, classes: int, quadratic: bool, shrink: float = 0.05) -> QuadraticScorer:
    """Linear (pooled covariance) or quadratic (per-class, shrunk) discriminant from class moments.

    ``train`` has features and label. Two linear passes: the overall mean, then centred moments per
    class; only class means and d x d matrices reach the driver.
    """
    points = train.select(vector_to_array(FEATURES).alias("x"), F.col("label").cast("int").alias("g"))
    n, total, _ = gram(points)[0]
    shift = total / n
    moments = gram(points, "g", shift)
    d = len(shift)
    means, priors, scatters = np.zeros((classes, d)), np.zeros(classes), np.zeros((classes, d, d))
    for g, (count, first, second) in moments.items():
        means[g] = first / count
        priors[g] = count / n
        scatters[g] = second - np.outer(first, first) / count
    constants = np.log(priors)
    if quadratic:
        precisions = []
        for g in range(classes):
            covariance = (1 - shrink) * scatters[g] / max(1.0, moments[g][0] - 1) + shrink * np.eye(d)
            constants[g] -= 0.5 * np.linalg.slogdet(covariance)[1]
            precisions.append(np.linalg.inv(covariance))
    else:
        precisions = [np.linalg.pinv(scatters.sum(axis=0) / (n - classes), rcond=1e-10, hermitian=True)]
    return QuadraticScorer(
        means=(means + shift).ravel().tolist(),
        precisions=np.concatenate([p.ravel() for p in precisions]).tolist(),
        constants=constants.tolist(),
    )


def fit_quantile_regression(train: DataFrame, quantile: float, alpha: float, rounds: int = 80, tolerance: float = 1e-5) -> LinearScorer:
    """Minimises mean pinball loss + alpha * |slopes| by reweighted least squares.

    Every round is one linear pass that adds up X'WX and X'Wy; the small system is solved on the
    driver. The smoothing of the kinks shrinks as the fit settles.
    """
    points = train.select(vector_to_array(FEATURES).alias("x"), F.col("label").cast("double").alias("y"))
    n, mean_y = points.agg(F.count(F.lit(1)), F.avg("y")).first()
    width = len(points.first()["x"])
    beta = np.zeros(width + 1)
    beta[0] = mean_y
    scale, best, best_loss = None, beta, np.inf
    for _ in range(rounds):
        current, smooth = beta, (scale or 1.0) * 1e-1

        def fold(x: np.ndarray, batch: pd.DataFrame) -> dict[int, np.ndarray]:
            design = np.c_[np.ones(len(x)), x]
            y = batch["y"].to_numpy()
            r = y - design @ current
            side = np.where(r >= 0, quantile, 1.0 - quantile)
            w = side / np.maximum(np.abs(r), smooth)
            loss = (np.abs(r) * side).sum()
            normal = (design * w[:, None]).T
            return {0: np.concatenate([[loss, np.abs(r).sum()], (normal @ design).ravel(), normal @ y])}

        flat = summed(points, fold)[0]
        loss = flat[0] / n + alpha * np.abs(current[1:]).sum()
        if loss < best_loss:
            settled = best_loss - loss < tolerance * max(1.0, abs(loss))
            best, best_loss = current, loss
        else:
            settled = True
        spread = flat[1] / n
        if scale is None:
            scale = spread
        elif settled:
            if scale < 1e-5 * max(spread, 1e-12):
                break
            scale *= 0.03
        p = width + 1
        left = flat[2 : 2 + p * p].reshape(p, p) / n
        penalty = np.r_[0.0, alpha / np.maximum(np.abs(current[1:]), 1e-8 + 1e-3 * scale)]
        beta = np.linalg.lstsq(left + np.diag(penalty), flat[2 + p * p :] / n, rcond=None)[0]
        beta[1:][np.abs(beta[1:]) < 1e-7] = 0.0
    return LinearScorer(coefficients=best[1:].tolist(), intercept=float(best[0]))
