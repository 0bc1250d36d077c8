"""t tests and the chi-square test from moments and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TableError
from ..functions.distributions import chi_square_p, student_p
from .counting import pair_counts
from .shape import col


def _value(name: str) -> Column:
    return F.nanvl(col(name).cast("double"), F.lit(None))


def one_sample_t(df: DataFrame, target: str, population_mean: float = 0.0) -> DataFrame:
    """(statistic, degrees_of_freedom, p_value, samples)."""
    x = _value(target)
    moments = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(x).alias("n"))
    t = (F.col("m") - F.lit(float(population_mean))) / (F.col("s") / F.sqrt("n"))
    tested = moments.select(t.alias("statistic"), (F.col("n") - 1.0).alias("degrees_of_freedom"), F.col("n").alias("samples"))
    return tested.withColumn("p_value", student_p("statistic", "degrees_of_freedom"))


def independent_t(df: DataFrame, target: str, group: str) -> DataFrame:
    """Welch's test of the two groups in key order; exactly two groups are required.

    Variances of large groups are merged from partial aggregates, so a dominant group is no issue.
    """
    x = _value(target)
    groups = (
        df.filter(col(group).isNotNull())
        .groupBy(col(group).alias("g"))
        .agg(F.avg(x).alias("m"), F.var_samp(x).alias("v"), F.count(x).alias("n"))
        .orderBy("g")
        .limit(3)
        .collect()
    )
    if len(groups) != 2:
        raise TableError("the independent t test needs exactly two groups", groups=len(groups))
    a, b = groups
    wide = df.sparkSession.range(1).select(
        *[F.lit(float(v)).alias(n) for n, v in (("m1", a["m"]), ("v1", a["v"]), ("m2", b["m"]), ("v2", b["v"]))],
        *[F.lit(int(v)).alias(n) for n, v in (("n1", a["n"]), ("n2", b["n"]))],
    )
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    freedom = (e1 + e2) ** 2 / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    tested = wide.select(
        ((F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)).alias("statistic"),
        freedom.alias("degrees_of_freedom"),
        (F.col("n1") + F.col("n2")).alias("samples"),
    )
    return tested.withColumn("p_value", student_p("statistic", "degrees_of_freedom"))


def paired_t(df: DataFrame, first: str, second: str) -> DataFrame:
    """Test of the mean difference over rows where both values exist."""
    paired = df.select((_value(first) - _value(second)).alias("difference"))
    return one_sample_t(paired, "difference", 0.0)


def paired_t_by_key(df: DataFrame, pair_key: str, factor: str, target: str) -> DataFrame:
    """Paired test for long data: two factor values matched through ``pair_key``."""
    levels = [r[0] for r in df.select(col(factor)).na.drop().distinct().orderBy(col(factor)).limit(3).collect()]
    if len(levels) != 2:
        raise TableError("the paired t test needs exactly two paired values", levels=len(levels))
    pairs = df.groupBy(col(pair_key)).agg(
        *[F.avg(F.when(col(factor) == level, _value(target))).alias(f"v{i}") for i, level in enumerate(levels)]
    )
    return paired_t(pairs, "v0", "v1")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two factors, Yates-corrected for a 2x2 table.

    N * (sum O^2 / (R * C) - 1) needs the observed cells only, so the empty cells of a wide table are
    never materialised. The 2x2 correction uses the cells of that table.
    """
    cells = pair_counts(df, a, b)
    rows = cells.groupBy("a").agg(F.sum("count").alias("row_total"))
    columns = cells.groupBy("b").agg(F.sum("count").alias("column_total"))
    share = F.col("count") * F.col("count") / (F.col("row_total").cast("double") * F.col("column_total"))
    joined = cells.join(rows, "a").join(columns, "b")
    flat = joined.agg(
        F.sum(share).alias("share"),
        F.sum("count").alias("samples"),
        F.count_distinct("a").alias("levels_a"),
        F.count_distinct("b").alias("levels_b"),
        F.max("row_total").alias("r1"),
        F.max("column_total").alias("c1"),
        F.max(F.struct("row_total", "column_total", "count")).alias("corner"),
    )
    n = F.col("samples").cast("double")
    freedom = ((F.col("levels_a") - 1) * (F.col("levels_b") - 1)).cast("double")
    plain = n * (F.col("share") - 1.0)
    # 2x2: every |O - E| is equal, so one corner gives the common difference
    expected = F.col("corner.row_total") * F.col("corner.column_total") / n
    gap = F.abs(F.col("corner.count") - expected)
    corrected = F.greatest(gap - F.least(gap, F.lit(0.5)), F.lit(0.0))
    inverse = n * n * n / (
        F.col("r1") * (n - F.col("r1")) * F.col("c1") * (n - F.col("c1"))
    )
    statistic = F.when(freedom == 0, 0.0).when(freedom == 1, corrected * corrected * inverse).otherwise(plain)
    return flat.select(
        statistic.alias("statistic"), freedom.alias("degrees_of_freedom"), F.col("samples")
    ).withColumn("p_value", chi_square_p("statistic", "degrees_of_freedom"))


def test_summary(df: DataFrame, target: str, groups: str) -> DataFrame:
    """(target, groups, mean, std); the deviation of a single value is 0."""
    x = _value(target)
    return df.agg(
        F.lit(target).alias("target"),
        F.lit(groups).alias("groups"),
        F.avg(x).alias("mean"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"),
    )
