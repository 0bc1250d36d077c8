"""Chart data as DataFrames: one function per chart type, filters applied before any aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import HISTOGRAM_BINS
from ..errors import ChartSpecError
from .evaluation import confusion_matrix
from .ordering import add_row_index
from .quantiles import exact_quantiles
from .shape import col


def check_columns(df: DataFrame, x: str | None, ys: Sequence[str], group: str | None = None) -> None:
    missing = sorted({c for c in [x, *ys, group] if c and c not in df.columns})
    if missing:
        raise ChartSpecError(f"chart columns do not exist: {', '.join(missing)}", missing=missing)
    if not ys:
        raise ChartSpecError("a chart needs at least one y column")


def apply_filters(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Scalar means equality, a list means membership; both reach the scan as pushed filters."""
    for name, wanted in filters.items():
        if name not in df.columns:
            raise ChartSpecError(f"filter column does not exist: {name}", missing=[name])
        df = df.filter(col(name).isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else col(name) == F.lit(wanted))
    return df


def xy_series(df: DataFrame, x: str | None, ys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """(x, series, y) without aggregation for line, bar and scatter; x is text, or the row position."""
    check_columns(df, x, ys)
    if x is None:
        df, x = add_row_index(df, list(order_by) or list(df.columns), "__row"), "__row"
    cells = [F.struct(F.lit(c).alias("series"), col(c).alias("y")) for c in ys]
    return df.select(col(x).cast("string").alias("x"), F.explode(F.array(*cells)).alias("r")).select("x", "r.*")


def histogram(df: DataFrame, y: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, midpoint, count): equal-width bins, the last one closed, empty bins present.

    Two aggregates: the range, then one count per bin; a constant column gets a range of one.
    """
    check_columns(df, None, [y])
    v = F.nanvl(col(y).cast("double"), F.lit(None))
    values = df.select(v.alias("v")).filter("v IS NOT NULL")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins

    def edge(i):
        return F.lit(low) + i * F.lit(step)

    guess = F.least(F.floor((F.col("v") - low) / step), F.lit(bins - 1))
    # the division can land one bin off at an edge; the edges themselves decide
    fixed = (
        F.when((guess > 0) & (F.col("v") < edge(guess)), guess - 1)
        .when((guess < bins - 1) & (F.col("v") >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    counts = values.groupBy(fixed.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    middle = F.round((edge(F.col("bin")) + edge(F.col("bin") + 1)) / 2.0, 6)
    return frame.join(counts, "bin", "left").select(
        "bin", middle.alias("midpoint"), F.coalesce("n", F.lit(0).cast("long")).alias("count")
    )


def boxplot(df: DataFrame, ys: Sequence[str]) -> DataFrame:
    """(column, q1, median, q3, lower_whisker, upper_whisker, outliers, samples) with 1.5 IQR fences."""
    check_columns(df, None, ys)
    quartiles = exact_quantiles(
        df.select(*[F.nanvl(col(c).cast("double"), F.lit(None)).alias(c) for c in ys]), list(ys), [0.25, 0.5, 0.75]
    ).collect()
    q = {(r["column"], r["prob"]): r["value"] for r in quartiles}
    aggs = []
    for i, c in enumerate(ys):
        spread = q[c, 0.75] - q[c, 0.25]
        lo, hi = q[c, 0.25] - 1.5 * spread, q[c, 0.75] + 1.5 * spread
        v = F.nanvl(col(c).cast("double"), F.lit(None))
        aggs += [
            F.min(F.when(v >= lo, v)).alias(f"lo{i}"),
            F.max(F.when(v <= hi, v)).alias(f"hi{i}"),
            F.count_if((v < lo) | (v > hi)).alias(f"out{i}"),
            F.count(v).alias(f"n{i}"),
        ]
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(q[c, 0.25]).alias("q1"),
            F.lit(q[c, 0.5]).alias("median"),
            F.lit(q[c, 0.75]).alias("q3"),
            F.least(F.col(f"lo{i}"), F.lit(q[c, 0.25])).alias("lower_whisker"),
            F.greatest(F.col(f"hi{i}"), F.lit(q[c, 0.75])).alias("upper_whisker"),
            F.col(f"out{i}").alias("outliers"),
            F.col(f"n{i}").alias("samples"),
        )
        for i, c in enumerate(ys)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """(x, y, value): mean of ``value`` per pair of categories."""
    check_columns(df, x, [y, value])
    return df.groupBy(col(x).cast("string").alias("x"), col(y).cast("string").alias("y")).agg(
        F.avg(col(value)).alias("value")
    )


def confusion_chart(df: DataFrame) -> DataFrame:
    """(x=predicted, y=actual, value) over the union of label sets, from predictions."""
    return confusion_matrix(df).select(F.col("predicted").alias("x"), F.col("actual").alias("y"), F.col("count").alias("value"))


def importance_chart(importance: DataFrame) -> DataFrame:
    return importance.select(F.col("feature").alias("x"), F.col("importance").alias("y"))


def residual_chart(residuals: DataFrame) -> DataFrame:
    return residuals.select(F.col("predicted").alias("x"), F.col("residual").alias("y"))


def cluster_chart(assignments: DataFrame) -> DataFrame:
    return assignments.select(F.col("row_index").alias("x"), F.col("cluster").alias("y"))


def anova_effect_chart(table: DataFrame) -> DataFrame:
    """(x=term, y=F) without the residual; a missing F is drawn as 0."""
    return table.filter(F.lower("term") != "residual").select(
        F.col("term").alias("x"), F.coalesce("f", F.lit(0.0)).alias("y")
    )
