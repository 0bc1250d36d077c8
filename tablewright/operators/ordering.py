"""Row positions, sliding windows and hash cuts without pulling a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shape import col

# A series longer than this is cut into pieces before any window runs over it.
HOT_SERIES_ROWS = 1_000_000


def add_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index") -> DataFrame:
    """Zero-based position of every row in the stated order.

    The rows are range-partitioned by the order columns, so each task sorts its own slice; the
    slice starts come from a table with one row per partition. The slices are checkpointed because
    the two passes have to see the same partition boundaries.
    """
    sliced = cut_lineage(
        df.repartitionByRange(*[col(c) for c in order_by]).withColumn("slice", F.spark_partition_id())
    )
    starts = sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("slice").orderBy(*[col(c) for c in order_by])
    return (
        sliced.join(starts, "slice")
        .withColumn(name, F.col("start") + F.row_number().over(inside) - 1)
        .drop("slice", "start")
    )


def add_series_index(df: DataFrame, group: str, order_by: Sequence[str], name: str) -> DataFrame:
    """Zero-based position inside each series; a hot series is spread over many range slices."""
    order = [group, *order_by]
    sliced = cut_lineage(
        df.repartitionByRange(*[col(c) for c in order]).withColumn("slice", F.spark_partition_id())
    )
    before = Window.partitionBy(col(group)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(col(group), "slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(col(group), "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy(col(group), "slice").orderBy(*[col(c) for c in order_by])
    return (
        sliced.join(starts, [group, "slice"])
        .withColumn(name, F.col("start") + F.row_number().over(inside) - 1)
        .drop("slice", "start")
    )


def sliding_windows(
    df: DataFrame,
    group: str,
    order_by: Sequence[str],
    values: Sequence[str],
    window: int,
    horizon: int,
    hot_rows: int = HOT_SERIES_ROWS,
) -> DataFrame:
    """One row per complete window: the row it predicts plus ``window_values``.

    ``window_values`` is an array (oldest first) of structs holding ``values`` of the ``window``
    rows that end ``horizon`` rows before the predicted row. Series above ``hot_rows`` are cut into
    pieces of that length, each with the few preceding rows it needs copied in front of it.
    """
    reach = window + horizon - 1
    sizes = df.groupBy(col(group)).agg(F.count(F.lit(1)).alias("series_rows"))
    hot = sizes.filter(F.col("series_rows") > hot_rows)
    if hot.isEmpty():
        pieces = df.withColumn("piece", F.lit(0).cast("long")).withColumn("own", F.lit(True))
    else:
        hot_groups = hot.select(col(group))
        cold = df.join(hot_groups, group, "left_anti")
        spread = add_series_index(df.join(hot_groups, group, "left_semi"), group, order_by, "__place")
        home = F.floor(F.col("__place") / hot_rows)
        last = F.floor((F.col("__place") + reach) / hot_rows)
        spread = (
            spread.withColumn("home", home)
            .withColumn("piece", F.explode(F.sequence(home, last)))
            .withColumn("own", F.col("piece") == F.col("home"))
            .drop("__place", "home")
        )
        cold = cold.withColumn("piece", F.lit(0).cast("long")).withColumn("own", F.lit(True))
        pieces = cold.unionByName(spread)
    frame = (
        Window.partitionBy(col(group), "piece")
        .orderBy(*[col(c) for c in order_by])
        .rowsBetween(-reach, -horizon)
    )
    bundle = F.struct(*[col(c).alias(c) for c in values])
    return (
        pieces.withColumn("window_values", F.collect_list(bundle).over(frame))
        .filter((F.size("window_values") == window) & F.col("own"))
        .drop("piece", "own")
    )


# ---- hash-ranked selection -----------------------------------------------------------------------


def keyed_digest(seed: int, key: Sequence[str]) -> Column:
    """32 hex digits from seed and row key; the same text in every engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(c).cast("string") for c in key]))


def smallest_digest_cut(hashed: DataFrame, digest: str, quotas: DataFrame | Column, strata: list[str]) -> DataFrame:
    """(strata..., cut): the digest of the quota-th smallest row of every stratum.

    ``quotas`` has (strata..., quota), or is an expression of ``stratum_rows``, the size of a stratum,
    which the prefix counts give for free. Two narrow passes: counts per four-digit prefix locate the
    prefix that holds the cut, then only the rows of that prefix (1/65536 of a stratum) are ranked.
    A stratum with a third of all rows is therefore never sorted as a whole. The located prefixes, one row per
    stratum, are broadcast.
    """
    prefix = F.substring(digest, 1, 4)
    counts = hashed.groupBy(*strata, prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*strata).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    counted = counts.withColumn("upto", F.sum("n").over(upto))
    if isinstance(quotas, DataFrame):
        wanted = counted.join(quotas, strata)
    else:
        whole = Window.partitionBy(*strata)
        wanted = counted.withColumn("stratum_rows", F.sum("n").over(whole)).withColumn("quota", quotas)
    located = (
        wanted.filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select(*strata, "prefix", (F.col("quota") - (F.col("upto") - F.col("n"))).alias("rank_in_prefix"))
    )
    inside = Window.partitionBy(*strata, "prefix").orderBy(digest)
    return (
        hashed.select(*strata, digest, prefix.alias("prefix"))
        .join(F.broadcast(located), [*strata, "prefix"])
        .withColumn("r", F.row_number().over(inside))
        .filter("r = rank_in_prefix")
        .select(*strata, F.col(digest).alias("cut"))
    )
