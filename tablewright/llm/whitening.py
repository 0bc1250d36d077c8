"""Embedding whitening by incremental eigendecomposition.

Each partition keeps the spectrum (eigenvalues and eigenvectors) of the scatter of the vectors it has seen about
their mean. A block of vectors is centred and reduced to the rows of its triangular factor, whose outer products
add up to the block's scatter; each row, and the shift between the two means, is one centred rank-one update. An
update solves the secular equation of the present eigenvalues, after deflation has set aside the pairs it leaves
unchanged. The partitions' spectra are then combined, a bounded number at a time, by the same updates: a spectrum
is a sum of rank-one terms, and so is the shift of its mean. At last one Rayleigh-Ritz pass projects all vectors on
the eigenvectors found and solves the small projected problem, which takes them to full precision.

Counts and sums are whole numbers throughout, so means are exact before their one division.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 4096
FAN_IN = 32
EPS = float(np.finfo(float).eps)
# Scaled entries beyond this are taken as this; sums and differences of such entries still fit a long.
LARGEST = 1 << 61


# ---- rank-one updates ----------------------------------------------------------------------------


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)) = 0 as (index of the nearest pole, distance from it).

    Poles rise strictly and weights are positive, so one root lies above each pole. Each is found from the pole
    next to it, which keeps the distance accurate, by a two-pole rational step inside a shrinking bracket.
    """
    k = len(poles)
    room = np.append(np.diff(poles), weights.sum())  # how far above its pole a root can lie
    half = room / 2
    apart = poles[None, :] - poles[:, None]
    at_half = 1.0 + (weights / (apart - half[:, None])).sum(axis=1)
    near = np.arange(k) + ((at_half < 0) & (np.arange(k) < k - 1))
    delta = poles[None, :] - poles[near][:, None]
    left = poles - poles[near]
    right = np.where(near == np.arange(k), room, 0.0)
    low, high = np.where(at_half >= 0, left, left + half), np.where(at_half >= 0, left + half, right)
    x = (low + high) / 2
    below = np.arange(k)[None, :] <= np.arange(k)[:, None]
    last = np.arange(k) == k - 1
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(400):
            gap = delta - x[:, None]
            terms = weights / gap
            value = 1.0 + terms.sum(axis=1)
            low, high = np.where(value <= 0, x, low), np.where(value >= 0, x, high)
            slopes = terms / gap
            lower_slope, upper_slope = np.where(below, slopes, 0).sum(axis=1), np.where(below, 0, slopes).sum(axis=1)
            p, q = left - x, right - x
            a, b = lower_slope * p * p, upper_slope * q * q
            c = value - a / p - np.where(last, 0.0, b / q)
            # c + a / (p - t) + b / (q - t) = 0 for a step t
            half_b, free = (c * (p + q) + a + b) / 2, c * p * q + a * q + b * p
            root = np.sqrt(np.maximum(half_b * half_b - c * free, 0))
            big = half_b + np.where(half_b >= 0, root, -root)
            one, two = free / big, big / c
            step = np.where((x + one > low) & (x + one < high), one, two)
            step = np.where(last, p + a / c, step)
            fresh = x + step
            good = np.isfinite(fresh) & (fresh > low) & (fresh < high)
            fresh = np.where(good, fresh, low + (high - low) / 2)
            done = (np.abs(fresh - x) <= 2 * EPS * np.abs(fresh)) | (fresh == low) | (fresh == high) | (value == 0)
            x = np.where(value == 0, x, fresh)
            if done.all():
                break
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``vectors diag(values) vectors^T + term term^T``, eigenvalues rising.

    Deflation: eigenvalues that (nearly) agree are rotated so that only one of them meets the term, and those
    whose vector does not meet it stay as they are.
    """
    z = vectors.T @ term
    size = max(float(np.abs(values).max(initial=0)), float(z @ z))
    if not size:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    limit = 8 * EPS * size
    small = np.abs(z) * np.sqrt(size) <= limit
    z[small] = 0
    previous = -1
    for i in np.flatnonzero(~small):
        if previous >= 0 and values[i] - values[previous] <= limit:
            r = np.hypot(z[i], z[previous])
            cos, sin = z[i] / r, z[previous] / r
            a, b = vectors[:, previous].copy(), vectors[:, i].copy()
            vectors[:, previous], vectors[:, i] = cos * a - sin * b, sin * a + cos * b
            z[i], z[previous] = r, 0
        previous = i
    active = np.flatnonzero(z)
    if not len(active):
        return values, vectors
    poles, weights = values[active], z[active] ** 2
    near, x = secular_roots(poles, weights)
    gap = (poles[None, :] - poles[near][:, None]) - x[:, None]  # pole j minus root i
    # Weights for which these roots are exact, so that the vectors below are orthogonal to full precision.
    ratio = -gap / np.where(np.eye(len(poles), dtype=bool), 1.0, poles[:, None] - poles[None, :])
    exact = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=0))), z[active])
    inner = exact[:, None] / gap.T
    inner /= np.linalg.norm(inner, axis=0)
    values[active], vectors[:, active] = poles[near] + x, vectors[:, active] @ inner
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, whole sums, and eigenvalues and eigenvectors of the scatter about the mean."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(d: int) -> Spectrum:
        return Spectrum(0, np.zeros(d, object), np.zeros(d), np.eye(d))

    def joined(self, n: int, sums: np.ndarray, terms: np.ndarray) -> Spectrum:
        """With ``n`` further vectors of these sums, whose scatter is the sum of the outer products of ``terms``."""
        if not n:
            return self
        if self.n:
            apart = sums * self.n - self.sums * n  # exact: n * self.n times the shift of the mean
            weight = Fraction(1, self.n * n * (self.n + n))
            shift = np.array([float(v) for v in apart]) * np.sqrt(float(weight))
            terms = np.vstack([terms, shift])
        values, vectors = self.values, self.vectors
        for term in terms:
            values, vectors = rank_one(values, vectors, term)
        return Spectrum(self.n + n, self.sums + sums, values, vectors)

    def with_rows(self, rows: np.ndarray) -> Spectrum:
        sums = whole_sums(rows)
        return self.joined(len(rows), sums, np.linalg.qr(centred(rows, len(rows), sums), mode="r"))

    def with_spectrum(self, other: Spectrum) -> Spectrum:
        return self.joined(other.n, other.sums, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)


def whole_sums(rows: np.ndarray) -> np.ndarray:
    """Column sums as Python whole numbers."""
    most = int(max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))))
    if most * max(1, len(rows)) < 1 << 62:
        return rows.sum(axis=0).astype(object)
    return rows.astype(object).sum(axis=0)


def scaled_gap(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: longs where they fit, else Python whole numbers."""
    most = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))) * n + max((abs(int(s)) for s in sums), default=0)
    if most < 1 << 62:
        return rows * n - sums.astype(np.int64)
    return rows.astype(object) * n - sums


def centred(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return scaled_gap(rows, n, sums).astype(float) / n


# ---- rows ----------------------------------------------------------------------------------------


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is neither null nor holds null or non-finite entries."""
    vector = F.col("embedding")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    limit = float(LARGEST)
    whole = F.transform(
        vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(limit)), F.lit(-limit))).cast("long") + OFFSET
    )
    rows = embeddings.filter(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: int, d: int, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(column).flatten().to_numpy().reshape(-1, d)


_SPECTRUM = "part long, n string, sums array<string>, vals array<double>, vectors array<double>"


def _spectrum_row(part: int, found: Spectrum) -> pa.RecordBatch:
    columns = {
        "part": pa.array([part], pa.int64()), "n": pa.array([str(found.n)]), "sums": pa.array([[str(s) for s in found.sums]], pa.list_(pa.string())),
        "vals": pa.array([found.values.tolist()], pa.list_(pa.float64())), "vectors": pa.array([found.vectors.ravel().tolist()], pa.list_(pa.float64())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _spectrum(row) -> Spectrum:
    d = len(row["vals"])
    return Spectrum(int(row["n"]), np.array([int(s) for s in row["sums"]], object), np.array(row["vals"]), np.array(row["vectors"]).reshape(d, d))


def spectra(vectors: DataFrame, d: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One spectrum for each partition of (x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, rows = Spectrum.empty(d), [], 0
        for _, block in _matrices(batches, 0, d, block_rows):
            held.append(block)
            rows += len(block)
            if rows >= block_rows:
                found, held, rows = found.with_rows(np.concatenate(held)), [], 0
        if held:
            found = found.with_rows(np.concatenate(held))
        if found.n:
            yield _spectrum_row(0, found)

    made = vectors.mapInArrow(run, _SPECTRUM)
    return made.withColumn("part", F.monotonically_increasing_id())


def combined(parts: DataFrame, fan_in: int = FAN_IN) -> Spectrum:
    """One spectrum of all, ``fan_in`` at a time; only the last one reaches the driver."""

    def merge(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        found = _spectrum(rows[0])
        for row in rows[1:]:
            found = found.with_spectrum(_spectrum(row))
        return pa.Table.from_batches([_spectrum_row(key[0].as_py(), found)])

    while (count := parts.count()) > 1:
        numbered = parts.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(-(-count // fan_in))))
        parts = stored(numbered.groupBy("part").applyInArrow(merge, _SPECTRUM), "whitening-combined")
    return _spectrum(parts.first())


def _summed(vectors: DataFrame, d: int, width: int, rows_of) -> np.ndarray:
    """Sum over all rows of the products of ``rows_of(block)`` with itself, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, block in _matrices(batches, 0, d, BLOCK_ROWS):
            values = rows_of(block)
            total += values.T @ values
        flat = total[np.triu_indices(width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["at", "value"])

    sums = vectors.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(width * (width + 1) // 2)
    flat[sums["at"].to_numpy()] = sums["value"].to_numpy()
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = flat
    return out + np.triu(out, 1).T


@dataclass
class Whitening:
    """The fitted model: d sums, up to 16 directions of length d, their eigenvalues and the checks."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        """Rows on the components; a component without variance gives NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return centred(rows, self.n, self.sums) @ self.directions * scale


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors in ``vectors`` (x), all of length ``d``. Model state is d x d."""
    found = combined(stored(spectra(vectors, d), "whitening-spectra"))
    n, sums, basis = found.n, found.sums, found.vectors
    projected = _summed(vectors, d, d, lambda block: centred(block, n, sums) @ basis) / n
    values, inner = np.linalg.eigh(projected)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(projected))
    values = np.where(values[order] > 64 * d * EPS * trace, values[order], 0.0)
    model = Whitening(n, sums, (basis @ inner)[:, order], values, trace, None)
    live = int((values > 0).sum())
    if live:
        unit = _summed(vectors, d, live, lambda block: model.whitened(block)[:, :live]) / n
        model.identity_error = float(np.abs(unit - np.eye(live)).max())
    return model


def whitened_rows(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    Rows with a null vector or null or non-finite entries take no part; a null vec_id stays null. Repeated rows and
    repeated vectors count once in the fit and each gets its own rows. Vectors shorter than the longest count as
    filled with zero entries; entries beyond 2^61 / 64 count as that. A component without variance has a null
    ``whitened``, and ``explained`` is null if none has any; ``identity_error`` is over the components with variance,
    null if there is none. A ``deviation`` beyond a long is null. Fewer than ``components`` entries give as many
    components; empty vectors and no rows give no rows. Columns other than vec_id and embedding are ignored.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(embeddings)
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return spark.createDataFrame([], schema)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(d) - F.size("x"))))
    model = fit(stored(rows.select("x").distinct(), "whitening-vectors"), d, components)
    live, n = len(model.values), model.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _matrices(batches, 1, d, BLOCK_ROWS):
            gap = scaled_gap(block, n, model.sums)
            most = max(abs(int(gap.max(initial=0))), abs(int(gap.min(initial=0))))
            if most * most * d < 1 << 62:
                deviation = pa.array((gap * gap).sum(axis=1))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in gap]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            many = len(block) * live
            repeat = pa.array(np.repeat(np.arange(len(block)), live))
            values = model.whitened(block).ravel()
            shares = np.tile(model.values / model.trace if model.trace else np.full(live, np.nan), len(block))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(repeat), pa.array(np.tile(np.arange(1, live + 1, dtype=np.int32), len(block))), pa.array(np.full(many, n)),
                    deviation.take(repeat), pa.array(values, from_pandas=True), pa.array(shares, from_pandas=True),
                    pa.array([model.identity_error] * many, pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
