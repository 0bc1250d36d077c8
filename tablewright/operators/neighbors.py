"""Exact nearest-neighbour and radius work as a partitioned block join.

Points are assigned to the nearest of a bounded set of pivots. The triangle inequality then tells,
per reference row, which query cells can possibly need it; only those copies are shuffled. Cells
are cut into blocks of bounded size by hashing the row id, so a cell (or a pile of copies) with a
third of all rows becomes many tasks. A block task works on two bounded matrices and returns a
reduced answer (k rows, a count, a representative) per row; pairs are never emitted.
The idea follows the published pivot-based k-NN join (Lu et al., VLDB 2012).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

BLOCK_ROWS = 2048
MAX_PIVOTS = 1000
KNN_BLOCKS = 8  # the k-nearest kernel works through its block in strips, so its blocks may be this much longer
STRIP_CELLS = 4_000_000
LEAF_ROWS = 64  # rows in a box of the k-nearest kernel


@dataclass
class Cells:
    """Driver-side summary of the pivots; its size is bounded by MAX_PIVOTS."""

    points: np.ndarray
    between: np.ndarray


def as_points(df: DataFrame, row_id: str, features: list[str] | str, *keep: str) -> DataFrame:
    """(id, x array<double>, kept columns) from numeric columns, an array column or an ML vector."""
    from pyspark.ml.functions import vector_to_array

    from .shape import col

    if isinstance(features, str):
        kind = df.schema[features].dataType
        x = F.col(features).cast("array<double>") if isinstance(kind, T.ArrayType) else vector_to_array(features)
    else:
        x = F.array(*[F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in features])
    return df.select(col(row_id).cast("long").alias("id"), x.alias("x"), *[col(k) for k in keep])


def matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by coordinate differences (no cancellation), in row chunks."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for at in range(0, len(a), step):
        diff = a[at : at + step, None, :] - b[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _boxes(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers in boxes of at most so many rows, halved along their widest column."""
    left, done = [np.arange(len(x))], []
    while left:
        part = left.pop()
        if len(part) <= rows:
            done.append(part)
            continue
        half = len(part) // 2
        order = np.argpartition(x[part, np.ptp(x[part], axis=0).argmax()], half)
        left += [part[order[:half]], part[order[half:]]]
    return done


def _near_boxes(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """(rows of a, rows of b) that together hold the k nearest rows of b, all ties included, of every row of a;
    nothing if that leaves over half of all pairs, as in many columns."""
    if len(b) <= 4 * LEAF_ROWS or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return None
    own, others = _boxes(a, LEAF_ROWS), _boxes(b, LEAF_ROWS)
    (low_a, high_a), (low_b, high_b) = (
        (np.array([x[part].min(axis=0) for part in parts]), np.array([x[part].max(axis=0) for part in parts])) for x, parts in ((a, own), (b, others))
    )
    sizes = np.array([len(part) for part in others])
    found, pairs = [], 0
    for at, part in enumerate(own):
        gap = np.maximum(np.maximum(low_b - high_a[at], low_a[at] - high_b), 0.0)
        reach = np.maximum(high_b - low_a[at], high_a[at] - low_b)
        least, most = np.sqrt(np.einsum("ij,ij->i", gap, gap)), np.sqrt(np.einsum("ij,ij->i", reach, reach))
        order = np.argsort(most)
        enough = np.searchsorted(np.cumsum(sizes[order]), k)
        bound = most[order[enough]] if enough < len(order) else np.inf
        wanted = np.flatnonzero(least <= bound * (1 + 1e-9))
        pairs += len(part) * sizes[wanted].sum()
        if 2 * pairs > len(a) * len(b):
            return None
        found.append((part, np.concatenate([others[i] for i in wanted])))
    return found


def choose_pivots(reference: DataFrame, rows: int, block_rows: int) -> Cells:
    wanted = int(min(MAX_PIVOTS, max(1, rows // (4 * block_rows))))
    if wanted <= 1:
        points = np.zeros((1, 0))
    else:
        picked = reference.orderBy(F.md5(F.col("id").cast("string")), "id").limit(wanted).select("x").toPandas()
        points = np.unique(matrix(picked["x"]), axis=0)
    return Cells(points, distances(points, points))


def assign_cells(points: DataFrame, cells: Cells) -> DataFrame:
    """Adds cell (nearest pivot) and its distance."""
    pivots = cells.points

    @F.pandas_udf("cell int, to_pivot double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        d = distances(matrix(x), pivots)
        best = d.argmin(axis=1)
        return pd.DataFrame({"cell": best.astype("int32"), "to_pivot": d[np.arange(len(d)), best]})

    return points.withColumn("n_", nearest("x")).select("*", "n_.cell", "n_.to_pivot").drop("n_")


def _reach_knn(queries: DataFrame, reference: DataFrame, cells: Cells, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query cell: its radius, and a bound on the k-th neighbour distance of its rows."""
    n = len(cells.points)
    radius = np.full(n, -1.0)
    for row in queries.groupBy("cell").agg(F.max("to_pivot").alias("r")).collect():
        radius[row["cell"]] = row["r"]
    closest = Window.partitionBy("cell").orderBy("to_pivot")
    near = (
        reference.select("cell", "to_pivot")
        .withColumn("place", F.row_number().over(closest))
        .filter(F.col("place") <= k)
        .select("cell", "to_pivot")
        .toPandas()
    )
    bound = np.full(n, np.inf)
    for cell in np.flatnonzero(radius >= 0):
        reach = radius[cell] + cells.between[cell, near["cell"].to_numpy()] + near["to_pivot"].to_numpy()
        if len(reach) >= k:
            bound[cell] = np.partition(reach, k - 1)[k - 1]
    return radius, bound


def _reach_radius(queries: DataFrame, cells: Cells, eps: float) -> tuple[np.ndarray, np.ndarray]:
    radius = np.full(len(cells.points), -1.0)
    for row in queries.groupBy("cell").agg(F.max("to_pivot").alias("r")).collect():
        radius[row["cell"]] = row["r"]
    return radius, np.full(len(cells.points), float(eps))


def block_join(
    queries: DataFrame,
    reference: DataFrame,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    *,
    knn: int | None = None,
    eps: float | None = None,
    block_rows: int = BLOCK_ROWS,
    longer: int = 1,
) -> DataFrame:
    """Runs ``kernel(query block, reference block)`` on every pair of blocks that can matter.

    Both inputs have (id, x, ...). ``knn`` or ``eps`` decides which reference rows a cell can need. A row is
    shuffled once for every block of the other side, so a kernel that needs no matrix of the whole block asks
    for blocks ``longer`` times ``block_rows``; the cells stay as they are.
    """
    reference = reference.toDF(*reference.columns)
    reference_rows = reference.count()
    if reference_rows == 0:
        return queries.sparkSession.createDataFrame([], schema)
    if reference_rows > 4 * block_rows:
        queries, reference = cut_lineage(queries), cut_lineage(reference)
    cells = choose_pivots(reference, reference_rows, block_rows)
    if len(cells.points) == 1:
        q, r = queries.withColumn("cell", F.lit(0)), reference.withColumn("cell", F.lit(0))
        q_counts, r_counts = {0: q.count()}, {0: reference_rows}
    else:
        q = cut_lineage(assign_cells(queries, cells))
        r = cut_lineage(assign_cells(reference, cells))
        radius, bound = _reach_knn(q, r, cells, knn) if knn else _reach_radius(q, cells, eps)
        between, alive = cells.between, np.flatnonzero(radius >= 0)

        @F.pandas_udf("array<int>")
        def needed_by(cell: pd.Series, to_pivot: pd.Series) -> pd.Series:
            d, own = to_pivot.to_numpy(), cell.to_numpy()
            gap = between[own][:, alive]
            lower = np.maximum(gap - radius[alive] - d[:, None], d[:, None] - gap - radius[alive])
            wanted = lower <= bound[alive] * (1 + 1e-9) + 1e-9
            return pd.Series([alive[row].astype("int32") for row in wanted])

        r = r.withColumn("cell", F.explode(needed_by("cell", "to_pivot")))
        q_counts = {row["cell"]: row["count"] for row in q.groupBy("cell").count().collect()}
        r_counts = {row["cell"]: row["count"] for row in r.groupBy("cell").count().collect()}
    sizes = queries.sparkSession.createDataFrame(
        [
            (int(c), -(-q_counts[c] // (longer * block_rows)), max(1, -(-r_counts.get(c, 0) // (longer * block_rows))))
            for c in q_counts
        ],
        "cell int, q_blocks int, r_blocks int",
    )
    sizes = F.broadcast(sizes)  # one row per pivot, at most MAX_PIVOTS
    q = (
        q.join(sizes, "cell")
        .withColumn("q_block", F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int"))
        .withColumn("r_block", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)))
        .drop("q_blocks", "r_blocks", "to_pivot")
    )
    r = (
        r.join(sizes, "cell")
        .withColumn("r_block", F.pmod(F.xxhash64("id"), F.col("r_blocks")).cast("int"))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        .drop("q_blocks", "r_blocks", "to_pivot")
    )
    names = T._parse_datatype_string(schema).names

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        return kernel(left, right)

    keys = ["cell", "q_block", "r_block"]
    q, r = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (q, r))
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(run, schema)


def knn_join(
    queries: DataFrame, reference: DataFrame, k: int, exclude_same: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, neighbour_id, distance, place): exact k nearest, ties to the smaller id.

    Of identical reference points only the first k (+1) ids can ever be among the nearest, so piles
    of copies shrink to that many rows before the join; the others lose every tie.
    """
    spare = k + int(exclude_same)
    copies = Window.partitionBy("x").orderBy("id")
    slim = reference.select("id", "x").withColumn("c", F.row_number().over(copies)).filter(F.col("c") <= spare).drop("c")

    def strip(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, squared_b: np.ndarray) -> pd.DataFrame:
        squared_a = np.einsum("ij,ij->i", a, a)
        rough = squared_a[:, None] + squared_b[None, :] - 2.0 * (a @ b.T)
        keep = min(spare, len(b))
        slack = 1e-9 * (squared_a + squared_b.max() + 1e-12)
        limit = np.partition(rough, keep - 1, axis=1)[:, keep - 1] + slack
        row, column = np.nonzero(rough <= limit[:, None])
        if exclude_same:
            different = ids[row] != others[column]
            row, column = row[different], column[different]
        diff = a[row] - b[column]
        d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        order = np.lexsort((others[column], d, row))
        row, column, d = row[order], column[order], d[order]
        starts = np.r_[0, np.flatnonzero(np.diff(row)) + 1] if len(row) else np.array([], dtype=int)
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        best = place < k
        return pd.DataFrame({"query_id": ids[row[best]], "neighbour_id": others[column[best]], "distance": d[best]})

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(left["x"]), matrix(right["x"])
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        squared_b = np.einsum("ij,ij->i", b, b)
        near = _near_boxes(a, b, spare)
        if near is not None:
            return pd.concat([strip(ids[own], a[own], others[other], b[other], squared_b[other]) for own, other in near])
        step = max(1, STRIP_CELLS // len(b))
        return pd.concat([strip(ids[at : at + step], a[at : at + step], others, b, squared_b) for at in range(0, len(a), step)])

    schema = "query_id long, neighbour_id long, distance double"
    partial = block_join(queries.select("id", "x"), slim, nearest, schema, knn=spare, block_rows=block_rows, longer=KNN_BLOCKS)
    best = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return partial.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def neighbour_graph(points: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """k nearest other points of every point."""
    return knn_join(points, points, k, exclude_same=True, block_rows=block_rows)


def core_distances(points: DataFrame, min_samples: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, core_distance): distance to the min_samples-th nearest point, the point itself included."""
    near = knn_join(points, points, min_samples, block_rows=block_rows)
    return near.filter(F.col("place") == min_samples).select(F.col("query_id").alias("id"), F.col("distance").alias("core_distance"))
