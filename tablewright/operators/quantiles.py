"""Exact quantiles that stay distributed, also for hot groups and heavily repeated values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shape import col, melt

# Up to this many values per group the built-in aggregate (a value->count map per group and column) is cheaper.
BUILTIN_ROWS = 200_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Iterable[str] = (),
    builtin_rows: int = BUILTIN_ROWS,
) -> DataFrame:
    """(by..., column, prob, value): linearly interpolated quantiles, nulls ignored.

    Small groups use the built-in ``percentile``. When any group is larger, equal values become one
    (value, count) row, these are sorted into range slices, and counts per slice tell which slices hold
    the wanted ranks; only those are ranked. No task ever holds a whole group.
    """
    by, columns, probs = list(by), list(columns), [float(p) for p in probs]
    largest = df.groupBy(*[col(b) for b in by]).count().agg(F.max("count")).first()[0] or 0
    if largest <= builtin_rows:
        return _builtin(df, columns, probs, by)
    # the group columns get neutral names meanwhile, so that they cannot meet an internal name
    inner = [f"__by{i}" for i in range(len(by))]
    renamed = df.select(*[col(b).alias(n) for b, n in zip(by, inner)], *[col(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    found = _by_slices(renamed, [f"__v{i}" for i in range(len(columns))], probs, inner)
    names = F.create_map(*[v for i, c in enumerate(columns) for v in (F.lit(f"__v{i}"), F.lit(c))])
    return found.select(*[F.col(n).alias(b) for b, n in zip(by, inner)], names[F.col("column")].alias("column"), "prob", "value")


def _builtin(df: DataFrame, columns: list[str], probs: list[float], by: list[str]) -> DataFrame:
    grid = F.array(*[F.lit(p) for p in probs])
    aggs = [F.percentile(col(c).cast("double"), grid).alias(f"__q{i}") for i, c in enumerate(columns)]
    wide = df.groupBy(*[col(b) for b in by]).agg(*aggs)
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("prob"), F.col(f"__q{i}")[k].alias("value"))
        for i, c in enumerate(columns)
        for k, p in enumerate(probs)
    ]
    return wide.select(*[col(b) for b in by], F.explode(F.array(*cells)).alias("r")).select(
        *[col(b) for b in by], "r.*"
    )


def _by_slices(df: DataFrame, columns: list[str], probs: list[float], by: list[str]) -> DataFrame:
    keys = [*by, "column"]
    cols = [col(k) for k in keys]
    values = melt(df, by, columns, "column", "x").filter("x IS NOT NULL")
    counts = values.groupBy(*cols, "x").agg(F.count(F.lit(1)).alias("c"))
    sliced = cut_lineage(counts.repartitionByRange(*cols, "x").withColumn("slice", F.spark_partition_id()))
    so_far = Window.partitionBy(*cols).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*cols)
    slices = (
        sliced.groupBy(*cols, "slice").agg(F.sum("c").alias("held"))
        .withColumn("below", F.sum("held").over(so_far) - F.col("held"))
        .withColumn("n", F.sum("held").over(whole))
    )
    position = F.col("prob") * (F.col("n") - 1)
    ranks = F.array(F.struct(F.lit(0).alias("side"), F.floor(position).alias("k")), F.struct(F.lit(1).alias("side"), F.ceil(position).alias("k")))
    targets = (
        slices.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
        .withColumn("position", position)
        .withColumn("r", F.explode(ranks))
        .select(*cols, "slice", "prob", "position", "below", "held", "r.*")
        .filter((F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("held")))
    )
    targets = cut_lineage(targets)
    slice_keys = [*keys, "slice"]
    wanted = targets.select(*[col(k) for k in slice_keys], "below").distinct()
    inside = Window.partitionBy(*[col(k) for k in slice_keys]).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _null_safe_join(sliced, wanted, slice_keys).withColumn("upto", F.col("below") + F.sum("c").over(inside)).drop("below")
    found = _null_safe_join(ranked, targets.drop("below", "held"), slice_keys).filter(
        (F.col("k") >= F.col("upto") - F.col("c")) & (F.col("k") < F.col("upto"))
    )
    low, high = (F.max(F.when(F.col("side") == s, F.col("x"))) for s in (0, 1))
    ends = found.groupBy(*cols, "prob", "position").agg(low.alias("a"), high.alias("b"))
    # the same terms as the built-in percentile, so that both give the same double
    between = (F.ceil("position") - F.col("position")) * F.col("a") + (F.col("position") - F.floor("position")) * F.col("b")
    ends = ends.select(*cols, "prob", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("value"))
    # a column without values in a group still has its rows, with null
    groups = df.groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("rows")).drop("rows") if by else df.sparkSession.range(1).drop("id")
    every = groups.withColumn("column", F.explode(F.array(*[F.lit(c) for c in columns]))).withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
    return _null_safe_join(every, ends, [*keys, "prob"], "left")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[col(k).alias(f"r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"r_{key}"])
    return left.join(renamed, condition, how).drop(*[f"r_{k}" for k in keys])


def global_quantile(df: DataFrame, column: str, prob: float, builtin_rows: int = BUILTIN_ROWS) -> float:
    """One exact quantile of a whole column as a driver value."""
    return exact_quantiles(df, [column], [prob], builtin_rows=builtin_rows).first()["value"]
