"""Spectral clustering on a sparse neighbour graph; one algorithm at every size.

The affinity is Gaussian on the k-nearest-neighbour graph of the distinct points, so it has a bounded number of edges
a point. The leading eigenvectors of the normalised affinity come from block Krylov cycles: each step is one join of
the edges with the current vectors and one aggregation, each cycle ends with a Rayleigh-Ritz solve of a small Gram
matrix whose size depends on the number of clusters alone. A graph that falls into enough parts needs no cycle. Vectors stay distributed columns throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .components import connected_components
from .density import distinct_points
from .neighbors import BLOCK_ROWS, matrix, neighbour_graph
from .ordering import add_row_index
from .partials import gram

NEIGHBOURS = 10
# Products in a cycle, most cycles, and the residual of every eigenvector at which they end with the current one.
STEPS = 6
CYCLES = 3
TOLERANCE = 1e-3
# Further vectors that are carried along, so that the wanted ones settle faster.
GUARDS = 8
# A far pair keeps a positive weight, so that every node has a degree.
LEAST_WEIGHT = 1e-300


def _written(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back. A checkpoint keeps the planner's size estimate, which multiplies
    with every join of the steps below; a table has its own."""
    path = scratch_path(df.sparkSession, "spectral-basis")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def affinity_edges(nodes: DataFrame, neighbours: int = NEIGHBOURS, gamma: float = 1.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, weight) in both directions of every pair of which one is among the nearest of the other."""
    near = neighbour_graph(nodes.select("id", "x"), neighbours, block_rows)
    weight = F.greatest(F.exp(F.lit(-gamma) * F.col("distance") * F.col("distance")), F.lit(LEAST_WEIGHT))
    low, high = F.least("query_id", "neighbour_id").alias("a"), F.greatest("query_id", "neighbour_id").alias("b")
    pairs = cut_lineage(near.groupBy(low, high).agg(F.max(weight).alias("weight")))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): sum of the weights at a node."""
    return edges.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("degree"))


def normalised(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """(a, b, s): weights over the square roots of the degrees of both ends."""
    a, b = degree.toDF("a", "degree_a"), degree.toDF("b", "degree_b")
    s = F.col("weight") / F.sqrt("degree_a") / F.sqrt("degree_b")
    return edges.join(a, "a").join(b, "b").select("a", "b", s.alias("s"))


def multiplied(scaled: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(id, v): half of each row plus half of the affinity times the rows (id, v); the spectrum lies between 0 and 1."""
    ends = vectors.select(F.col("id").alias("b"), "v")
    sums = [F.sum(F.col("s") * F.col("v")[j]).alias(f"w{j}") for j in range(width)]
    moved = scaled.join(ends, "b").groupBy(F.col("a").alias("id")).agg(*sums)
    moved = moved.select("id", F.array(*[f"w{j}" for j in range(width)]).alias("w"))
    return vectors.join(moved, "id").select("id", F.zip_with("v", "w", lambda p, q: (p + q) / 2).alias("v"))


def _ritz(products: np.ndarray, width: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Best vectors in the span of all but the last block: coefficients, values, largest residual of the first ``wanted`` vectors of the first block.

    ``products`` holds the inner products of all blocks; block i + 1 is the operator times block i. The first block
    is orthonormal from the second cycle on, so its residual is free of the cancellation that that of the new
    vectors would suffer."""
    first = np.diag(products)[:width], np.diag(products[:width, width:]), np.diag(products)[width : 2 * width]
    residual = np.sqrt(np.maximum(first[2] / first[0] - (first[1] / first[0]) ** 2, 0.0))
    size = len(products) - width
    scale = 1.0 / np.sqrt(np.maximum(np.diag(products)[:size], np.finfo(float).tiny))
    values, vectors = np.linalg.eigh(products[:size, :size] * scale[:, None] * scale[None, :])
    good = values > 1e-9 * values[-1]
    onto = scale[:, None] * vectors[:, good] / np.sqrt(values[good])
    image = onto.T @ products[:size, width:] @ onto
    theta, inside = np.linalg.eigh((image + image.T) / 2)
    return onto @ inside[:, ::-1][:, :width], theta[::-1][:width], float(residual[:wanted].max())


def _combined(column: str, coefficients: np.ndarray) -> Column:
    """The first entries of an array column times a small matrix."""

    @F.pandas_udf("array<double>")
    def product(x: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(x)[:, : len(coefficients)] @ coefficients), dtype=object)

    return product(column)


def smooth_start(nodes: DataFrame, degree: DataFrame, width: int, seed: int) -> DataFrame:
    """(id, v): the known leading vector and random waves over the standardised points, which vary little along edges."""
    scale = nodes.select(Summarizer.metrics("mean", "std").summary(array_to_vector("x")).alias("s")).first()["s"]
    mean, spread = scale["mean"].toArray(), scale["std"].toArray()
    spread[spread == 0] = 1.0
    rng = np.random.default_rng(seed)
    waves, phase = rng.normal(size=(len(mean), width - 1)) / np.sqrt(max(1.0, len(mean) / 3)), rng.uniform(0, 2 * np.pi, width - 1)

    @F.pandas_udf("array<double>")
    def start(x: pd.Series, degree: pd.Series) -> pd.Series:
        wave = np.cos((matrix(x) - mean) / spread @ waves + phase)
        return pd.Series(list(np.sqrt(degree.to_numpy())[:, None] * np.c_[np.ones(len(wave)), wave]), dtype=object)

    return nodes.select("id", "x").join(degree, "id").select("id", start("x", "degree").alias("v"))


def leading_vectors(scaled: DataFrame, start: DataFrame, width: int, wanted: int, tolerance: float = TOLERANCE) -> tuple[DataFrame, np.ndarray]:
    """((id, v), values): the ``wanted`` largest eigenvalues of the normalised affinity, and orthonormal vectors of
    which the first ``wanted`` belong to them. Where values lie closer together than the cycles can part, the vectors
    span smooth functions near theirs. ``start`` has (id, v) rows of ``width`` entries."""
    vectors = start
    for _ in range(CYCLES):
        basis = _written(vectors.select("id", F.col("v").alias("x")))
        for step in range(STEPS):
            last = basis.select("id", F.slice("x", step * width + 1, width).alias("v"))
            basis = _written(basis.join(multiplied(scaled, last, width), "id").select("id", F.concat("x", "v").alias("x")))
        coefficients, theta, residual = _ritz(gram(basis)[0][2], width, wanted)
        vectors, width = basis.select("id", _combined("x", coefficients).alias("v")), coefficients.shape[1]
        if residual <= tolerance:
            break
    wanted = min(wanted, width)
    return _written(vectors.select("id", F.slice("v", 1, wanted).alias("v"))), 2.0 * theta[:wanted] - 1.0


def _place(value: Column, known: list[int]) -> Column:
    """Place of a value in a short list, its length for any other."""
    at = F.array_position(F.array(*[F.lit(v).cast("long") for v in known]), value)
    return F.when(at > 0, at - 1).otherwise(len(known)).cast("long")


def spectral(
    points: DataFrame, k: int, seed: int, gamma: float = 1.0, neighbours: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(id, cluster) of a normalised cut: k-means over the leading eigenvectors, each divided by the root of the degree.

    Copies of a point are one node and share its cluster; k-means counts them. With no more distinct points than
    clusters each point is its own cluster. A graph of k separate parts has these as clusters; of more parts the k - 1
    with the most rows (ties to the smallest id) are clusters and the others together the last one, since any such
    grouping cuts nothing.
    """
    nodes = cut_lineage(distinct_points(points))
    count = nodes.count()
    if count <= k:
        found = add_row_index(nodes, ["id"], "cluster").select("x", F.col("cluster").cast("long").alias("cluster"))
        return points.select("id", "x").join(found, "x").select("id", "cluster")
    if k < 2:
        return points.select("id", F.lit(0).cast("long").alias("cluster"))
    edges = affinity_edges(nodes, neighbours, gamma, block_rows)
    parts = cut_lineage(connected_components(edges.filter("a < b").select("a", "b")))
    if parts.select("component").distinct().count() >= k:
        weights = nodes.join(parts, nodes["id"] == parts["node"]).select("x", "weight", "component")
        largest = weights.groupBy("component").agg(F.sum("weight").alias("rows")).orderBy(F.desc("rows"), "component").limit(k - 1).collect()
        place = _place(F.col("component"), [row["component"] for row in largest])
        return points.select("id", "x").join(weights.select("x", place.alias("cluster")), "x").select("id", "cluster")
    degree = cut_lineage(degrees(edges))
    start = smooth_start(nodes, degree, k + GUARDS, seed)
    vectors, _ = leading_vectors(cut_lineage(normalised(edges, degree)), start, k + GUARDS, k)
    rows = vectors.join(degree, "id").select("id", F.transform("v", lambda value: value / F.sqrt("degree")).alias("v"))
    width = len(rows.first()["v"])
    spread = rows.agg(*[F.sqrt(F.avg(F.col("v")[j] * F.col("v")[j])).alias(f"s{j}") for j in range(width)]).first()
    even = F.array(*[F.col("v")[j] / F.lit(spread[j] or 1.0) for j in range(width)])
    rows = cut_lineage(rows.join(nodes.select("id", F.col("weight").cast("double").alias("weight"), "x"), "id").select("x", "weight", array_to_vector(even).alias("features")))
    models = [KMeans(k=k, seed=seed + i, weightCol="weight", initSteps=4, maxIter=100, tol=1e-6).fit(rows) for i in range(4)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    found = best.transform(rows).select("x", F.col("prediction").cast("long").alias("cluster"))
    return points.select("id", "x").join(found, "x").select("id", "cluster")
