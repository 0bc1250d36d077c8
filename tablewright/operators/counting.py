"""Grouped counts, contingency tables and registry-style lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shape import col


def group_ratios(df: DataFrame, by: str, name: str | None = None) -> DataFrame:
    """(by, count, ratio); the window runs over the handful of groups, not over rows."""
    out = name or by
    counts = df.groupBy(col(by).alias(out)).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("ratio", F.col("count") / total)


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed (a, b, count) cells, rows with a null key dropped."""
    return (
        df.select(col(a).alias("a"), col(b).alias("b"))
        .na.drop()
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(row, column, count) for all combinations of levels, with zero cells.

    The grid is laid out from the level lists of the already aggregated cells; its size is the size
    of the requested table.
    """
    counts = pair_counts(df, a, b)
    levels_b = counts.agg(F.array_sort(F.collect_set("b")).alias("levels"))
    grid = counts.select("a").distinct().select("a", F.explode(levels_b.scalar()).alias("b"))
    return (
        grid.join(counts, ["a", "b"], "left")
        .select(
            F.col("a").cast("string").alias("row"),
            F.col("b").cast("string").alias("column"),
            F.coalesce("count", F.lit(0).cast("long")).alias("count"),
        )
    )


def latest_per_key(df: DataFrame, key: Sequence[str], newest_first: Sequence[str]) -> DataFrame:
    """One row per key, the newest; an aggregate, so a key with very many versions combines map-side."""
    rest = [c for c in df.columns if c not in key]
    newest = F.struct(*[col(c) for c in newest_first])
    return (
        df.groupBy(*[col(k) for k in key])
        .agg(F.max_by(F.struct(*[col(c) for c in rest]), newest).alias("r"))
        .select(*[col(k) for k in key], "r.*")
    )


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(*[col(k) for k in key]), list(key), "left_anti").unionByName(new)
