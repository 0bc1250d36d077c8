"""Density hierarchy (HDBSCAN, OPTICS levels) over a bounded set of weighted summary points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .clustering import SUMMARY_POINTS, summarise
from .neighbors import distances


def _core_distances(d: np.ndarray, weights: np.ndarray, min_samples: int) -> np.ndarray:
    order = d.argsort(axis=1)
    reached = weights[order].cumsum(axis=1) >= min(min_samples, weights.sum())
    first = reached.argmax(axis=1)
    return np.take_along_axis(d, order, axis=1)[np.arange(len(d)), first]


def _spanning_edges(reach: np.ndarray) -> list[tuple[float, int, int]]:
    """Minimum spanning tree of a small dense graph, ascending."""
    n = len(reach)
    outside = np.ones(n, dtype=bool)
    outside[0] = False
    best, origin, edges = reach[0].copy(), np.zeros(n, dtype=int), []
    for _ in range(n - 1):
        at = int(np.where(outside, best, np.inf).argmin())
        edges.append((float(best[at]), int(origin[at]), at))
        outside[at] = False
        closer = reach[at] < best
        best, origin = np.where(closer, reach[at], best), np.where(closer, at, origin)
    return sorted(edges)


def density_labels(centres: np.ndarray, weights: np.ndarray, min_samples: int, min_cluster_size: int) -> np.ndarray:
    """Most stable clusters of the density hierarchy (excess of mass); -1 marks noise.

    Published method: Campello, Moulavi & Sander 2013. Copies enter through the weights.
    """
    n = len(centres)
    if n == 1:
        return np.array([-1])
    d = distances(centres, centres)
    core = _core_distances(d, weights, min_samples)
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    parent = list(range(n))
    node = list(range(n))  # dendrogram node of each set
    children: dict[int, tuple[int, int, float]] = {}
    size = {i: float(w) for i, w in enumerate(weights)}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    top = n
    for height, a, b in _spanning_edges(reach):
        a, b = find(a), find(b)
        children[top] = (node[a], node[b], height)
        size[top] = size[node[a]] + size[node[b]]
        parent[b] = a
        node[a] = top
        top += 1
    root = top - 1

    def members(start: int) -> list[int]:
        stack, out = [start], []
        while stack:
            at = stack.pop()
            if at < n:
                out.append(at)
            else:
                stack.extend(children[at][:2])
        return out

    # walk down: a split into two large parts opens two clusters, smaller parts fall out as noise
    stability, birth, kids, start_of = {0: 0.0}, {0: 0.0}, {0: []}, {0: root}
    stack = [(root, 0)]
    while stack:
        at, cluster = stack.pop()
        if at < n:
            level = 1.0 / core[at] if core[at] > 0 else np.inf
            stability[cluster] += size[at] * (min(level, 1e12) - birth[cluster])
            continue
        left, right, height = children[at]
        level = min(1.0 / height if height > 0 else np.inf, 1e12)
        large = [c for c in (left, right) if size[c] >= min_cluster_size]
        if len(large) == 2:
            stability[cluster] += size[at] * (level - birth[cluster])
            for c in large:
                new = len(stability)
                stability[new], birth[new], kids[new], start_of[new] = 0.0, level, [], c
                kids[cluster].append(new)
                stack.append((c, new))
        else:
            for c in (left, right):
                if c in large:
                    stack.append((c, cluster))
                else:
                    stability[cluster] += size[c] * (level - birth[cluster])
    chosen: set[int] = set()
    value = dict(stability)
    for cluster in sorted(stability, reverse=True):
        below = sum(value[k] for k in kids[cluster])
        if cluster == 0 or (kids[cluster] and below > stability[cluster]):
            value[cluster] = max(below, 0.0)
        else:
            value[cluster] = stability[cluster]
            chosen.add(cluster)
    labels = np.full(n, -1)
    stack2 = [0]
    picked = []
    while stack2:
        cluster = stack2.pop()
        if cluster in chosen:
            picked.append(cluster)
        else:
            stack2.extend(kids[cluster])
    groups = sorted((members(start_of[c]) for c in picked), key=min)
    for number, group in enumerate(groups):
        labels[group] = number
    return labels


def hdbscan(points: DataFrame, min_cluster_size: int, seed: int, min_samples: int | None = None, limit: int = SUMMARY_POINTS) -> DataFrame:
    """Exact up to ``limit`` distinct points; beyond that on weighted micro-clusters."""
    summary = summarise(points, seed, limit)
    return summary.labels(density_labels(summary.centres, summary.weights, min_samples or min_cluster_size, min_cluster_size))


def optics(points: DataFrame, min_samples: int, seed: int, limit: int = SUMMARY_POINTS) -> DataFrame:
    """Clusters over all density levels; the radius parameter plays no part.

    The reachability levels of the ordering are the merge heights of the same hierarchy, from which
    the most stable groups of at least ``min_samples`` rows are taken.
    """
    summary = summarise(points, seed, limit)
    return summary.labels(density_labels(summary.centres, summary.weights, min_samples, max(2, min_samples)))
