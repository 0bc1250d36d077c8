"""Linear dimensionality reduction of all numeric columns; the model is d x d, the rows stay distributed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EMBEDDING_ROWS
from ..errors import TableError
from .partials import gram
from .shape import col, finite, numeric_columns


def _points(df: DataFrame, key: str, columns: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    names = list(columns or [c for c in numeric_columns(df) if c != key])
    if not names:
        raise TableError("a reduction needs at least one numeric column")
    values = [F.coalesce(finite(c), F.lit(0.0)) for c in names]
    return df.select(col(key).alias("id"), F.array(*values).alias("x")), names


def _oriented(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive, so that signs are reproducible."""
    largest = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])


def _project(points: DataFrame, centre: np.ndarray, axes: np.ndarray) -> DataFrame:
    def score(axis: np.ndarray):
        terms = F.zip_with("x", F.array(*[F.lit(float(v)) for v in axis]), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(-float(centre @ axis)), lambda s, v: s + v)

    second = score(axes[:, 1]) if axes.shape[1] > 1 else F.lit(0.0)
    return points.select("id", score(axes[:, 0]).alias("component1"), second.alias("component2"))


def pca(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, float], np.ndarray]:
    """((id, component1, component2), metrics, axes): centred, unscaled principal components.

    Two linear passes give the covariance matrix (the second one centred for accuracy); projection is
    a column expression.
    """
    points, names = _points(df, key, columns)
    n, total, _ = gram(points)[0]
    centre = total / n
    _, first, second = gram(points, shift=centre)[0]
    covariance = (second - np.outer(first, first) / n) / max(1.0, n - 1)
    values, vectors = np.linalg.eigh(covariance)
    order = values.argsort()[::-1][: min(2, len(names))]
    axes = _oriented(vectors[:, order])
    explained = float(values[order].sum() / values.sum()) if values.sum() > 0 else 0.0
    return _project(points, centre, axes), {"explained_variance": explained, "samples": n, "features": float(len(names))}, axes


def truncated_svd(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, float], np.ndarray]:
    """((id, component1, component2), metrics, axes): uncentred, at most one component less than columns."""
    points, names = _points(df, key, columns)
    n, total, second = gram(points)[0]
    values, vectors = np.linalg.eigh(second)
    order = values.argsort()[::-1][: min(2, max(1, len(names) - 1))]
    axes = _oriented(vectors[:, order])
    mean = total / n
    _, first, centred = gram(points, shift=mean)[0]
    covariance = (centred - np.outer(first, first) / n) / n
    explained = float(np.einsum("ij,ik,kj->", axes, covariance, axes) / np.trace(covariance)) if np.trace(covariance) > 0 else 0.0
    return (
        _project(points, np.zeros(len(names)), axes),
        {"explained_variance": explained, "samples": n, "features": float(len(names))},
        axes,
    )


def embedding_preview(projected: DataFrame, rows: int = EMBEDDING_ROWS) -> DataFrame:
    """(row_index, component1, component2) of the first rows by id; the index is given after the limit."""
    head = projected.orderBy("id").limit(rows)
    return head.select(
        (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("row_index"), "component1", "component2"
    )
