"""Spectral clustering: rings, copies, and the eigenvectors against a dense solve."""

from __future__ import annotations

import numpy as np

from tablewright.operators import density, spectral


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def dense(edges, degree):
    index = {r.id: i for i, r in enumerate(sorted(degree, key=lambda r: r.id))}
    s = np.zeros((len(index), len(index)))
    for r in edges:
        s[index[r.a], index[r.b]] = r.s
    return index, s


def test_rings_and_copies(spark):
    """Two rings that no centre separates; every point of the inner one has a copy."""
    rng = np.random.default_rng(5)
    turn = np.linspace(0, 2 * np.pi, 240, endpoint=False)
    ring = np.c_[np.cos(turn), np.sin(turn)]
    x = np.vstack([ring * 0.4, ring, ring * 0.4])
    x[240:480] += rng.normal(0, 0.01, (240, 2))
    labels = np.array([r.cluster for r in spectral.spectral(frame(spark, x), 2, 42).orderBy("id").collect()])
    assert len(set(labels[:240])) == 1 and len(set(labels[240:480])) == 1 and labels[0] != labels[240]
    assert (labels[480:] == labels[:240]).all()


def test_vectors_equal_a_dense_solve(spark):
    """Overlapping groups, many blocks of the neighbour join: values and the space of the vectors."""
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.8, (90, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    nodes = density.distinct_points(frame(spark, x))
    edges = spectral.affinity_edges(nodes, 8, 0.5, block_rows=64)
    degree = spectral.degrees(edges)
    scaled = spectral.normalised(edges, degree)
    index, s = dense(scaled.collect(), degree.collect())
    assert np.allclose(s, s.T)
    vectors, values = spectral.leading_vectors(scaled, spectral.smooth_start(nodes, degree, 11, 1), 11, 3)
    want, space = np.linalg.eigh(s)
    assert np.allclose(values, want[::-1][:3], atol=1e-4)
    got = np.zeros((len(index), 3))
    for r in vectors.collect():
        got[index[r.id]] = r.v
    assert np.allclose(got.T @ got, np.eye(3), atol=1e-6)
    assert np.linalg.norm(space[:, -3:].T @ got) ** 2 > 3 - 1e-2


def test_few_points(spark):
    def labels(x, k):
        return [r.cluster for r in spectral.spectral(frame(spark, x), k, 1).orderBy("id").collect()]

    assert labels(np.zeros((0, 2)), 2) == []
    assert labels(np.array([[1.0, 1.0], [1.0, 1.0], [2.0, 2.0]]), 2) == [0, 0, 1]
    assert labels(np.arange(6.0)[:, None], 1) == [0] * 6
    pair = labels(np.array([[0.0], [0.1], [50.0], [50.1], [0.05], [50.05]]), 2)
    assert len(pair) == 6
    far = np.r_[np.linspace(0, 1, 30), np.linspace(50, 51, 40), np.linspace(90, 91, 20)][:, None]
    assert labels(far, 3) == [1] * 30 + [0] * 40 + [2] * 20
    assert labels(far, 2) == [1] * 30 + [0] * 40 + [1] * 20
