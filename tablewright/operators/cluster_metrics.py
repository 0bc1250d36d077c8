"""Internal quality measures of a clustering over (id, x, cluster) rows; label -1 is noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ASSIGNMENT_ROWS, CLUSTER_NAME_PREFIX, NOISE_NAME
from ..functions.scalars import euclidean
from ..session import cut_lineage
from .counting import group_ratios
from .neighbors import BLOCK_ROWS, STRIP_CELLS, block_join, distances, matrix
from .ordering import add_row_index

DRIVER_CENTRES = 2000
# All pairs: blocks of this many times the block rows, worked through in tiles that stay in a core's cache.
LONGER = 16
TILE_ROWS = 256
TILE_COLUMNS = 1024
# Squared distances below this share of the squared lengths have lost too many digits.
CLOSE = 1e-6


def centres(points: DataFrame) -> DataFrame:
    """(cluster, n, centre, within): size, mean vector and sum of squared deviations per cluster."""
    stats = Summarizer.metrics("count", "mean", "variance").summary(F.col("v"))
    summary = points.withColumn("v", array_to_vector("x")).groupBy("cluster").agg(stats.alias("s"))
    variance = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, b: a + b)
    return summary.select(
        "cluster",
        F.col("s.count").alias("n"),
        vector_to_array("s.mean").alias("centre"),
        (variance * (F.col("s.count") - 1)).alias("within"),
    )


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """One row (calinski_harabasz): between over within dispersion; 1 when there is no spread within."""
    table = centres(points.filter("cluster <> -1"))
    whole = points.filter("cluster <> -1").select(F.lit(0).alias("cluster"), "x")
    total = centres(whole).select(F.col("within").alias("total"), F.col("n").alias("rows"))
    parts = table.agg(F.sum("within").alias("inner"), F.count(F.lit(1)).alias("k"), F.lit(0).alias("one"))
    joined = parts.join(total.withColumn("one", F.lit(0)), "one")
    value = (F.col("total") - F.col("inner")) / (F.col("k") - 1) / (F.col("inner") / (F.col("rows") - F.col("k")))
    return joined.select(F.when(F.col("inner") == 0, 1.0).otherwise(value).alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """One row (davies_bouldin): mean over clusters of the worst (scatter + scatter) / centre distance."""
    kept = points.filter("cluster <> -1")
    table = centres(kept).select("cluster", "centre")
    scatter = kept.join(table, "cluster").groupBy("cluster").agg(
        F.avg(euclidean(F.col("x"), F.col("centre"))).alias("scatter")
    )
    table = table.join(scatter, "cluster").select(F.col("cluster").cast("long").alias("id"), F.col("centre").alias("x"), "scatter")

    def worst(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        d = distances(matrix(left["x"]), matrix(right["x"]))
        both = left["scatter"].to_numpy()[:, None] + right["scatter"].to_numpy()[None, :]
        same = left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]
        ratio = np.where(same, -np.inf, np.where(d == 0, 0.0, both / np.where(d == 0, 1.0, d)))
        return pd.DataFrame({"id": left["id"].to_numpy(), "ratio": ratio.max(axis=1)})

    if table.limit(DRIVER_CENTRES + 1).count() <= DRIVER_CENTRES:
        rows = table.toPandas()  # one row per cluster, size just checked
        worst_per = worst(rows, rows)
        return points.sparkSession.createDataFrame([(float(worst_per["ratio"].mean()),)], "davies_bouldin double")
    ratios = block_join(table, table, worst, "id long, ratio double", eps=float("inf"))
    return ratios.groupBy("id").agg(F.max("ratio").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def _fast_distances(a: np.ndarray, b: np.ndarray, squared_a: np.ndarray, squared_b: np.ndarray) -> np.ndarray:
    """Euclidean distances from one product; pairs so close (or not finite) that digits cancel are taken by differences.

    ``squared_a`` and ``squared_b`` are the squared lengths.
    """
    d = np.c_[a, squared_a, np.ones(len(a))] @ np.c_[-2.0 * b, np.ones(len(b)), squared_b].T
    if d.min() > CLOSE * (squared_a.max() + squared_b.max()):
        return np.sqrt(d, out=d)
    row, column = np.nonzero(~(d > CLOSE * (squared_a[:, None] + squared_b[None, :])))
    d = np.sqrt(np.maximum(d, 0.0, out=d), out=d)
    step = max(1, STRIP_CELLS // max(1, a.shape[1]))
    for at in range(0, len(row), step):
        diff = a[row[at : at + step]] - b[column[at : at + step]]
        d[row[at : at + step], column[at : at + step]] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return d


def _cluster_sums(left: pd.DataFrame, right: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Per left row: its distance sums to the clusters of the right block, except those of other clusters that lie whole in
    the block; of these the smallest mean is enough. ``right`` is in the order of its clusters."""
    labels, starts, counts = np.unique(right["cluster"].to_numpy(), return_index=True, return_counts=True)
    sizes, whole = right["n"].to_numpy()[starts], right["members"].to_numpy()[starts] == counts
    weight, own = right["weight"].to_numpy(dtype=float), left["cluster"].to_numpy()
    squared_a, squared_b = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    copies = (weight != 1.0).any()
    base = left[["id", "cluster", "weight", "n"]]
    out = []
    for at in range(0, len(a), TILE_ROWS):
        rows = slice(at, at + TILE_ROWS)
        total = np.zeros((len(a[rows]), len(labels)))
        for to in range(0, len(b), TILE_COLUMNS):
            columns = slice(to, to + TILE_COLUMNS)
            d = _fast_distances(a[rows], b[columns], squared_a[rows], squared_b[columns])
            if copies:
                d *= weight[columns]
            first, last = np.searchsorted(starts, [to, to + d.shape[1] - 1], side="right") - 1
            cuts = np.maximum(starts[first : last + 1] - to, 0)
            total[:, first : last + 1] += np.add.reduceat(d, cuts, axis=1)
        kept = ~whole[None, :] | (labels[None, :] == own[rows][:, None])
        row, label = np.nonzero(kept)
        part = base.iloc[at + row].assign(other=labels[label], other_n=sizes[label], total=total[row, label], nearest=np.nan)
        out.append(part)
        if whole.any():
            means = np.where(kept, np.inf, total / sizes)
            rest = ~kept.all(axis=1)
            nearest = np.fmin.reduce(means, axis=1)[rest]
            out.append(base.iloc[rows][rest].assign(other=pd.NA, other_n=pd.NA, total=np.nan, nearest=nearest))
    return pd.concat([p.astype({"other": "Int64", "other_n": "Int64"}) for p in out])


def silhouette(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row (silhouette): mean Euclidean silhouette without noise rows; single-row clusters score 0.

    All pairs are compared, in blocks of rows in the order of their clusters: a block cuts at most two clusters, so
    that a task returns few values per row however many clusters there are. A row is shuffled once per block.
    Copies of a point in one cluster are one weighted row.
    """
    kept = points.filter("cluster <> -1")
    distinct = kept.groupBy("cluster", "x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    placed = add_row_index(distinct, ["cluster", "id"], "place")
    placed = cut_lineage(placed.select(F.col("place").cast("long").alias("id"), F.col("cluster").cast("long").alias("cluster"), "x", "weight"))
    sizes = placed.groupBy("cluster").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("members"))
    rows = placed.count()
    least = int(np.ceil(np.sqrt(8 * placed.sparkSession.sparkContext.defaultParallelism)))  # some pairs of blocks for every core
    blocks = max(1, -(-rows // (LONGER * block_rows)), min(least, -(-rows // block_rows)))
    length = max(1, -(-rows // blocks))

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        x = matrix(group["x"])
        finite = np.isfinite(x).all(axis=1)
        x = x - x[finite].mean(axis=0) if finite.any() else x
        low = (group["block"] == group["low"]).to_numpy()
        if low.all():
            return _cluster_sums(group, group, x, x)
        left, right, a, b = group[low], group[~low], x[low], x[~low]
        return pd.concat([_cluster_sums(left, right, a, b), _cluster_sums(right, left, b, a)])

    block = F.floor(F.col("id") / F.lit(length)).cast("int")
    dealt = (
        placed.join(sizes, "cluster")
        .withColumn("block", block)
        .withColumn("end", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select("id", "cluster", "x", "weight", "n", "members", "block", F.least("block", "end").alias("low"), F.greatest("block", "end").alias("high"))
        .repartition(blocks * (blocks + 1) // 2, "low", "high")
    )
    schema = "id long, cluster long, weight long, n long, other long, other_n long, total double, nearest double"
    partial = dealt.groupBy("low", "high").applyInPandas(sums, schema)
    per_cluster = partial.groupBy("id", "weight", "n", "cluster", "other", "other_n").agg(
        F.sum("total").alias("total"), F.min("nearest").alias("nearest")
    )
    own = F.col("other") == F.col("cluster")
    per_row = per_cluster.groupBy("id", "weight", "n").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.least(F.min(F.when(~own, F.col("total") / F.col("other_n"))), F.min(F.when(F.col("other").isNull(), F.col("nearest")))).alias("b"),
    )
    score = F.when(F.col("n") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return per_row.agg((F.sum(score * F.col("weight")) / F.sum("weight")).alias("silhouette"))


def silhouette_squared(points: DataFrame) -> DataFrame:
    """One row (silhouette_squared): closed form for squared distances, linear in the rows."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    kept = points.filter("cluster <> -1").select(array_to_vector("x").alias("features"), F.col("cluster").cast("double").alias("prediction"))
    value = ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(kept)
    return points.sparkSession.createDataFrame([(float(value),)], "silhouette_squared double")


def noise_counts(points: DataFrame) -> DataFrame:
    """One row: samples, clusters, noise_samples, noise_ratio."""
    noise = F.col("cluster") == -1
    counts = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("samples"),
        F.count_if(~noise).alias("clusters"),
        F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)).alias("noise_samples"),
        (F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)) / F.sum("n")).alias("noise_ratio"),
    )


def cluster_metrics(points: DataFrame, pairwise: bool = False) -> tuple[dict[str, float], list[str]]:
    """Metric values and warnings; quality measures need at least two clusters and a spare row.

    The silhouette of squared distances needs one pass and is always among them. ``pairwise`` adds the plain
    one, which compares every pair of rows.
    """
    counts = noise_counts(points).first()
    metrics = {name: float(counts[name]) for name in ("samples", "clusters", "noise_samples", "noise_ratio")}
    rows = counts["samples"] - counts["noise_samples"]
    if not 1 < counts["clusters"] < rows:
        return metrics, ["too few clusters for quality measures"]
    frames = [calinski_harabasz(points), davies_bouldin(points), silhouette_squared(points)]
    if pairwise:
        frames.append(silhouette(points))
    for frame in frames:
        metrics.update({k: float(v) for k, v in frame.first().asDict().items()})
    return metrics, []


def cluster_summary(points: DataFrame) -> DataFrame:
    """(cluster, name, count, ratio) per label."""
    name = F.when(F.col("cluster") == -1, NOISE_NAME).otherwise(
        F.concat(F.lit(CLUSTER_NAME_PREFIX), (F.col("cluster") + 1).cast("string"))
    )
    return group_ratios(points, "cluster").select("cluster", name.alias("name"), "count", "ratio")


def assignment_preview(points: DataFrame, rows: int = ASSIGNMENT_ROWS) -> DataFrame:
    """(row_index, cluster) of the first rows by id; the index is given after the limit."""
    from pyspark.sql import Window

    head = points.select("id", "cluster").orderBy("id").limit(rows)
    return head.select((F.row_number().over(Window.orderBy("id")) - 1).alias("row_index"), "cluster")
