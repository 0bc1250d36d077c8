"""Bagged regression trees grown level by level over binned rows, for tables of many rows.

Values are cut into at most ``max_bins`` bins, and rows that agree in every bin form a cell. A part holds
its cells once and the label of every row; for a tree the bootstrap weights of a cell's rows are added up
first, so nodes, descents and split sums are worked out per cell and not per row. A pass grows all trees by
one level. Weights come from a hash of the row, so the draws depend neither on the parts nor on their order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext, keyword_only
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import MOST_SLICE_ROWS, slices_for
from .learners import _Stage
from .neighbors import matrix
from .preparation import FEATURES
from .shape import col

PART_ROWS = 2_000_000
MESSAGE_VALUES = 250_000
QUANTILE_ERROR = 0.0001
# number of draws of a row, by the 16 bits of a hash: a Poisson variable of mean one
DRAWS = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])), (np.arange(65536) + 0.5) / 65536, side="right").astype(np.uint8)


class BaggedTrees(_Stage):
    """prediction = mean over trees of the leaf value; a row goes left where its value is at most the threshold."""

    sizes = Param(Params._dummy(), "sizes", "nodes per tree", TypeConverters.toListInt)
    features = Param(Params._dummy(), "features", "column a node looks at", TypeConverters.toListInt)
    thresholds = Param(Params._dummy(), "thresholds", "largest value that goes left", TypeConverters.toListFloat)
    children = Param(Params._dummy(), "children", "left child, the right one follows it; a leaf is its own", TypeConverters.toListInt)
    values = Param(Params._dummy(), "values", "mean label of the node", TypeConverters.toListFloat)
    importances = Param(Params._dummy(), "importances", "share of the loss removed, per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, sizes=None, features=None, thresholds=None, children=None, values=None, importances=None):
        super().__init__()
        self._setup(sizes=sizes, features=features, thresholds=thresholds, children=children, values=values, importances=importances)

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.floats("importances"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cuts = np.cumsum(self.getOrDefault("sizes"))[:-1]
        state = [np.split(np.array(self.getOrDefault(n)), cuts) for n in ("features", "thresholds", "children", "values")]
        trees = list(zip(*state))

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            rows = matrix(x)
            total = np.zeros(len(rows))
            for feature, threshold, child, value in trees:
                total += value[_descend(rows, feature, threshold, child)]
            return pd.Series(total / len(trees))

        return dataset.withColumn("prediction", score(vector_to_array(FEATURES)))


def _descend(rows: np.ndarray, feature: np.ndarray, threshold: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The node every row ends in. Leaves have an endless threshold and lead to themselves."""
    flat, base = rows.ravel(), np.arange(len(rows)) * rows.shape[1]
    node = np.zeros(len(rows), dtype=np.int64)
    while True:
        moved = child[node] + (flat[base + feature[node]] > threshold[node])
        if (moved == node).all():
            return node
        node = moved


def bin_thresholds(train: DataFrame, width: int, max_bins: int) -> list[np.ndarray]:
    """Per column its quantile values but the largest; a column of few values gets all of them."""
    values = train.select(vector_to_array(FEATURES).alias("x")).select(*[F.col("x")[i].alias(f"x{i}") for i in range(width)])
    shares = [i / max_bins for i in range(max_bins + 1)]
    found = [np.unique(v)[:-1] for v in values.approxQuantile([f"x{i}" for i in range(width)], shares, QUANTILE_ERROR)]
    return [v[-(max_bins - 1) :] for v in found]


def _blocks(train: DataFrame, key: Sequence[str], thresholds: list[np.ndarray], rows: int, centre: float, seed: int) -> DataFrame:
    """One row a part: its cells' bins, where a cell's rows begin, labels and hashes, in the order of the cells."""

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["x"])
            codes = np.empty((len(x), len(thresholds)), dtype=np.uint8)
            for i, cuts in enumerate(thresholds):
                codes[:, i] = np.searchsorted(cuts, x[:, i], side="left")
            cells = [row.tobytes() for row in codes]
            yield pd.DataFrame({"cell": pd.Series(cells, dtype=object), "label": batch["label"] - centre, "draw": batch["draw"]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, counts, labels, draws = [], [], [], []
        for batch in batches:
            codes = np.frombuffer(b"".join(batch["cell"]), dtype=np.uint8).reshape(len(batch), -1)
            first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
            cells.append(codes[first])
            counts.append(np.diff(np.r_[first, len(batch)]))
            labels.append(batch["label"].to_numpy(dtype=float))
            draws.append(batch["draw"].to_numpy(dtype=np.int64))
        if not cells:
            return
        codes, draw = np.concatenate(cells), np.concatenate(draws)
        starts = np.cumsum(np.r_[0, np.concatenate(counts)])[:-1]
        # a cell may go on in the next batch
        first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
        codes, starts = codes[first], starts[first]
        # copies of a row are next to each other; each has its own draws
        fresh = np.r_[True, draw[1:] != draw[:-1]]
        place = np.arange(len(draw)) - np.maximum.accumulate(np.where(fresh, np.arange(len(draw)), 0))
        draw = draw.view(np.uint64) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        yield pd.DataFrame({
            "cells": [codes.tobytes()], "starts": [starts.astype(np.int64).tobytes()],
            "labels": [np.concatenate(labels).tobytes()], "draws": [draw.tobytes()],
        })

    draw = F.xxhash64(F.lit(seed), *[col(k) for k in key], F.col("label"))
    rows_in = train.select(vector_to_array(FEATURES).alias("x"), F.col("label").cast("double").alias("label"), draw.alias("draw"))
    dealt = rows_in.mapInPandas(binned, "cell binary, label double, draw long")
    parts = max(slices_for(train, min(rows, MOST_SLICE_ROWS)), -(-rows // PART_ROWS))
    # ranges and not hashes: a cell of very many rows is cut
    dealt = dealt.repartitionByRange(parts, "cell", "draw", "label").sortWithinPartitions("cell", "draw", "label")
    return dealt.mapInPandas(packed, "cells binary, starts binary, labels binary, draws binary")


def _hashed(draw: np.ndarray, turn: int) -> np.ndarray:
    """Four 16-bit numbers a row (SplitMix64)."""
    z = draw + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.uint16).reshape(-1, 4)


def fit_forest(
    train: DataFrame, key: Sequence[str], width: int, rows: int, centre: float, deviation: float,
    trees: int = 200, max_depth: int = 8, max_bins: int = 64, bootstrap: bool = True, seed: int = 42,
) -> BaggedTrees:
    """Trees of least squares over all columns, each on its own Poisson bootstrap. ``train`` has features and label."""
    thresholds = bin_thresholds(train, width, max_bins)
    bins = [len(t) + 1 for t in thresholds]
    ends = np.cumsum([0, *bins])
    slots_a_message = max(1, MESSAGE_VALUES // (2 * int(ends[-1])))
    feature, cut, child = ([np.zeros(1, dtype=np.int64) for _ in range(trees)] for _ in range(3))
    cut = [c + 256 for c in cut]
    total = [np.zeros((1, 2)) for _ in range(trees)]
    gains = np.zeros((trees, width))
    active = [np.zeros(1, dtype=np.int64) for _ in range(trees)]
    blocks = _blocks(train, key, thresholds, rows, centre, seed).persist()
    try:
        for depth in range(max_depth):
            state = [(feature[t], cut[t], child[t], active[t]) for t in range(trees)]

            def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                part = TaskContext.get().partitionId()
                for batch in batches:
                    for block in batch.itertuples():
                        starts = np.frombuffer(block.starts, dtype=np.int64)
                        codes = np.frombuffer(block.cells, dtype=np.uint8).reshape(len(starts), -1)
                        y, draw = np.frombuffer(block.labels), np.frombuffer(block.draws, dtype=np.uint64)
                        drawn = None
                        for t, (features, cuts, children, wanted) in enumerate(state):
                            if drawn is None or t % 4 == 0:
                                drawn = _hashed(draw, t // 4)
                            if not len(wanted):
                                continue
                            w = DRAWS[drawn[:, t % 4]].astype(float) if bootstrap else np.ones(len(y))
                            weight, label = np.add.reduceat(w, starts), np.add.reduceat(w * y, starts)
                            slot_of = np.full(len(features), -1)
                            slot_of[wanted] = np.arange(len(wanted))
                            slot = slot_of[_descend(codes, features, cuts, children)]
                            at = np.flatnonzero((slot >= 0) & (weight > 0))
                            if not len(at):
                                continue
                            present, slot = np.unique(slot[at], return_inverse=True)
                            weight, label, here = weight[at], label[at], codes[at]
                            table = np.empty((len(present), 2, ends[-1]))
                            for f, n in enumerate(bins):
                                place = slot * n + here[:, f]
                                for s, v in enumerate((weight, label)):
                                    table[:, s, ends[f] : ends[f + 1]] = np.bincount(place, v, len(present) * n).reshape(-1, n)
                            group = present // slots_a_message
                            for g in np.unique(group):
                                yield pd.DataFrame({
                                    "tree": [t], "message": [int(g)], "part": [part],
                                    "slots": [present[group == g].astype(np.int64).tobytes()], "sums": [table[group == g].tobytes()],
                                })

            def best(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("part")
                t, first = int(pdf["tree"].iloc[0]), int(pdf["message"].iloc[0]) * slots_a_message
                table = np.zeros((min(slots_a_message, len(state[t][3]) - first), 2, ends[-1]))
                for slots, values in zip(pdf["slots"], pdf["sums"]):
                    table[np.frombuffer(slots, dtype=np.int64) - first] += np.frombuffer(values).reshape(-1, 2, ends[-1])
                whole = table[:, :, : bins[0]].sum(axis=2)
                out = [np.full(len(table), -1.0), np.zeros(len(table)), np.zeros(len(table)), np.zeros((len(table), 2))]
                for f, n in enumerate(bins):
                    if n < 2:
                        continue
                    left = table[:, :, ends[f] : ends[f + 1] - 1].cumsum(axis=2)
                    right = whole[:, :, None] - left
                    fits = (left[:, 0] >= 1) & (right[:, 0] >= 1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = left[:, 1] ** 2 / left[:, 0] + right[:, 1] ** 2 / right[:, 0] - (whole[:, 1] ** 2 / whole[:, 0])[:, None]
                    gain = np.where(fits, gain, 0.0)
                    # the first of equal gains, however the sums were rounded
                    at = (gain >= gain.max(axis=1)[:, None] * (1 - 1e-9)).argmax(axis=1)
                    top = gain[np.arange(len(table)), at]
                    better = top > out[2] * (1 + 1e-9)
                    out[0][better], out[1][better], out[2][better] = f, at[better], top[better]
                    out[3][better] = left[np.arange(len(table)), :, at][better]
                return pd.DataFrame({
                    "tree": t, "slot": first + np.arange(len(table)), "feature": out[0].astype(int), "bin": out[1].astype(int), "gain": out[2],
                    "weight": whole[:, 0], "label": whole[:, 1], "left_weight": out[3][:, 0], "left_label": out[3][:, 1],
                })

            folded = blocks.mapInPandas(sums, "tree long, message long, part long, slots binary, sums binary")
            found = folded.groupBy("tree", "message").applyInPandas(
                best, "tree long, slot long, feature long, bin long, gain double, weight double, label double, left_weight double, left_label double"
            )
            grown = found.toPandas().sort_values(["tree", "slot"])
            if not depth:
                for r in grown.itertuples():
                    total[r.tree][0] = r.weight, r.label
            # a gain within the rounding of the sums is none
            grown = grown[(grown["feature"] >= 0) & (grown["gain"] > 1e-12 * deviation**2 * grown["weight"])]
            parents, active = active, [np.zeros(0, dtype=np.int64) for _ in range(trees)]
            for t, part in grown.groupby("tree"):
                at, n, size = parents[t][part["slot"].to_numpy()], len(part), len(feature[t])
                feature[t][at], cut[t][at], child[t][at] = part["feature"], part["bin"], size + 2 * np.arange(n)
                np.add.at(gains[t], part["feature"].to_numpy(), part["gain"].to_numpy())
                fresh = size + np.arange(2 * n)
                feature[t] = np.r_[feature[t], np.zeros(2 * n, dtype=np.int64)]
                cut[t] = np.r_[cut[t], np.full(2 * n, 256)]
                child[t] = np.r_[child[t], fresh]
                left = part[["left_weight", "left_label"]].to_numpy()
                total[t] = np.r_[total[t], np.stack([left, part[["weight", "label"]].to_numpy() - left], axis=1).reshape(-1, 2)]
                active[t] = fresh[total[t][fresh, 0] >= 2]
            if not any(len(a) for a in active):
                break
    finally:
        blocks.unpersist()
    limits = [
        np.array([thresholds[f][c] if c < 256 else np.inf for f, c in zip(feature[t].tolist(), cut[t].tolist())]) for t in range(trees)
    ]
    shares = gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)
    shares = shares.sum(axis=0)
    values = [centre + np.divide(v[:, 1], v[:, 0], out=np.zeros(len(v)), where=v[:, 0] > 0) for v in total]
    return BaggedTrees(
        sizes=[len(f) for f in feature],
        features=np.concatenate(feature).tolist(),
        thresholds=np.concatenate(limits).tolist(),
        children=np.concatenate(child).tolist(),
        values=np.concatenate(values).tolist(),
        importances=(shares / max(shares.sum(), 1e-300)).tolist(),
    )
