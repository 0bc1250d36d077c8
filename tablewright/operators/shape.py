"""Reshaping helpers shared by profiles, statistics and charts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.NumericType,)


def quoted(name: str) -> str:
    """Column reference that survives dots and blanks in the name."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def per_column(
    df: DataFrame,
    columns: Iterable[str],
    measures: Mapping[str, Callable[[str], Column]],
    name: str = "column",
) -> DataFrame:
    """One aggregate over ``df`` laid out as one row per source column.

    All measures of all columns are evaluated in a single scan with map-side combine; the only
    thing reshaped is the one-row result.
    """
    columns = list(columns)
    flat = [fn(c).alias(f"m{i}_{m}") for i, c in enumerate(columns) for m, fn in measures.items()]
    structs = [
        F.struct(F.lit(c).alias(name), *[F.col(f"m{i}_{m}").alias(m) for m in measures])
        for i, c in enumerate(columns)
    ]
    return df.agg(*flat).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def long_metrics(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One-row frame of numbers -> (metric, value) rows; metrics that are null are left out."""
    columns = list(columns or df.columns)
    structs = [
        F.struct(F.lit(c).alias("metric"), col(c).cast("double").alias("value")) for c in columns
    ]
    return (
        df.select(F.explode(F.array(*structs)).alias("r")).select("r.*").filter("value IS NOT NULL")
    )


def finite(name: str) -> Column:
    """Numeric column with NaN and infinities turned into null."""
    c = col(name).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def melt(df: DataFrame, ids: Iterable[str], columns: Iterable[str], var: str, value: str) -> DataFrame:
    """Wide to long with every value as double, by one explode over the row."""
    structs = [
        F.struct(F.lit(c).alias(var), col(c).cast("double").alias(value)) for c in columns
    ]
    return df.select(*[col(c) for c in ids], F.explode(F.array(*structs)).alias("r")).select(
        *[col(c) for c in ids], "r.*"
    )
