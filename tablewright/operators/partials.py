"""Sums of numpy results over partitions: each task folds its rows, the cluster adds the folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import matrix


def summed(
    df: DataFrame, fold: Callable[[np.ndarray, pd.DataFrame], dict[int, np.ndarray]]
) -> dict[int, np.ndarray]:
    """``fold(x, batch)`` returns {key: array}; equal keys are added over all batches and partitions.

    A partition emits one row per key, so what moves is keys x partitions; the result (keys times
    the array length) is what reaches the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                for key, values in fold(matrix(batch["x"]), batch).items():
                    total[key] = total[key] + values if key in total else np.asarray(values, dtype=float)
        yield pd.DataFrame(
            {
                "key": pd.Series(list(total), dtype="int64"),
                "values": pd.Series([v.ravel() for v in total.values()], dtype=object),
            }
        )

    folded = df.mapInPandas(run, "key long, values array<double>").select("key", array_to_vector("values").alias("v"))
    rows = folded.groupBy("key").agg(Summarizer.sum(F.col("v")).alias("s")).collect()
    return {row["key"]: row["s"].toArray() for row in rows}


def gram(df: DataFrame, by: str | None = None, shift: np.ndarray | None = None) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """{group: (n, sum of x, sum of x x')} with x moved by ``shift`` first; ``by`` is a small integer."""

    def fold(x: np.ndarray, batch: pd.DataFrame) -> dict[int, np.ndarray]:
        if shift is not None:
            x = x - shift
        groups = batch[by].to_numpy() if by else np.zeros(len(x), dtype=int)
        out = {}
        for g in np.unique(groups):
            part = x[groups == g]
            out[int(g)] = np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        return out

    result = {}
    for g, flat in summed(df, fold).items():
        d = int(round((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2))
        result[g] = (flat[0], flat[1 : 1 + d], flat[1 + d :].reshape(d, d))
    return result
