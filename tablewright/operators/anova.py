"""Analysis of variance from cell aggregates, assumption tests and Tukey comparisons.

Rows are only ever read by aggregates per factor combination; everything after that works on the
cell table (count, sum, sum of squares), whose size is the number of factor combinations.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MIN_ANOVA_ROWS
from ..errors import ParameterError, TableError
from ..functions.distributions import f_p, f_upper, tukey_critical, tukey_p
from ..functions.scalars import factor_key
from ..session import cut_lineage
from .quantiles import exact_quantiles
from .shape import col

# Dense normal equations on the driver; beyond this many design columns the model is refused.
MAX_DESIGN_COLUMNS = 3000


def valid_rows(df: DataFrame, target: str, factors: Sequence[str]) -> DataFrame:
    """Rows with a value in target and factors, after the role checks of every variance analysis."""
    missing = sorted({target, *factors} - set(df.columns))
    if missing:
        raise ParameterError(f"columns do not exist: {', '.join(missing)}", missing=missing)
    if not isinstance(df.schema[target].dataType, T.NumericType):
        raise ParameterError("the target of a variance analysis must be numeric", target=target)
    frame = df.select(col(target), *[col(f) for f in factors]).dropna()
    needed = max(MIN_ANOVA_ROWS, 8 * len(factors))
    if frame.limit(needed).count() < needed:
        raise TableError("too few complete rows for a variance analysis", needed=needed)
    return frame


def _moments(y: Column) -> list[Column]:
    return [
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        F.coalesce(F.var_pop(y), F.lit(0.0)).alias("variance"),
    ]


def between_within(groups: DataFrame) -> DataFrame:
    """Group moments (n, mean, variance) -> one row: k, n, ss_between, ss_within.

    Two aggregates over the group table; the grand mean comes back in through a scalar subquery.
    """
    grand = groups.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m")).scalar()
    return groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - grand) * (F.col("mean") - grand)).alias("ss_between"),
        F.sum(F.col("n") * F.col("variance")).alias("ss_within"),
    )


def effect_sizes(table: DataFrame) -> DataFrame:
    """Adds eta_squared and partial_eta_squared to (term, df, sum_sq, ...) rows.

    A zero or missing sum of squares has no effect size. The residual row is treated like any other
    term, so its partial value is one half.
    """
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("sum_sq").over(everything)
    residual = F.sum(F.when(F.lower("term").contains("residual"), F.col("sum_sq")).otherwise(0.0)).over(everything)
    usable = F.col("sum_sq").isNotNull() & (F.col("sum_sq") != 0)
    return table.withColumn(
        "eta_squared", F.when(usable & (total != 0), F.col("sum_sq") / total)
    ).withColumn(
        "partial_eta_squared",
        F.when(usable & (F.col("sum_sq") + residual != 0), F.col("sum_sq") / (F.col("sum_sq") + residual)),
    )


def one_way_anova(df: DataFrame, target: str, factor: str) -> DataFrame:
    """(term, df, sum_sq, f, p_value, eta_squared, partial_eta_squared) for factor and residual."""
    frame = valid_rows(df, target, [factor])
    y = col(target).cast("double")
    fit = between_within(frame.groupBy(col(factor)).agg(*_moments(y)))
    between_df, within_df = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    f = (F.col("ss_between") / between_df) / (F.col("ss_within") / within_df)
    rows = F.array(
        F.struct(F.lit(f"C({factor})").alias("term"), between_df.alias("df"), F.col("ss_between").alias("sum_sq"), f.alias("f"), within_df.alias("d2")),
        F.struct(F.lit("Residual").alias("term"), within_df.alias("df"), F.col("ss_within").alias("sum_sq"), F.lit(None).cast("double").alias("f"), within_df.alias("d2")),
    )
    table = fit.select(F.explode(rows).alias("r")).select("r.*")
    return effect_sizes(table.withColumn("p_value", f_p("f", "df", "d2")).drop("d2")).select(
        "term", "df", "sum_sq", "f", "p_value", "eta_squared", "partial_eta_squared"
    )


def one_way_fit(df: DataFrame, target: str, factor: str) -> DataFrame:
    """samples, r2, adj_r2, f_statistic, model_p_value of the one-factor model as one row."""
    frame = valid_rows(df, target, [factor])
    fit = between_within(frame.groupBy(col(factor)).agg(*_moments(col(target).cast("double"))))
    total = F.col("ss_between") + F.col("ss_within")
    r2 = F.col("ss_between") / total
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    fitted = fit.select(
        F.col("n").alias("samples"),
        r2.alias("r2"),
        (1.0 - (1.0 - r2) * (F.col("n") - 1) / d2).alias("adj_r2"),
        ((F.col("ss_between") / d1) / (F.col("ss_within") / d2)).alias("f_statistic"),
        d1.alias("d1"),
        d2.alias("d2"),
    )
    return fitted.withColumn("model_p_value", f_p("f_statistic", "d1", "d2")).drop("d1", "d2")


def f_oneway(df: DataFrame, value: str, group: str) -> DataFrame:
    """(f_statistic, p_value, groups): plain one-way F over groups of more than one row."""
    groups = (
        df.filter(col(group).isNotNull())
        .groupBy(col(group))
        .agg(*_moments(col(value).cast("double")), F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
    )
    fit = between_within(groups)
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    tested = fit.select(
        ((F.col("ss_between") / d1) / (F.col("ss_within") / d2)).alias("f_statistic"),
        d1.alias("d1"),
        d2.alias("d2"),
        F.col("k").alias("groups"),
    )
    return tested.withColumn("p_value", f_p("f_statistic", "d1", "d2")).drop("d1", "d2")


def levene(df: DataFrame, target: str, factors: Sequence[str]) -> DataFrame:
    """(groups, statistic, p_value): median-centred Levene over factor combinations of two or more rows."""
    keyed = df.select(col(target).cast("double").alias("y"), *[col(f) for f in factors]).dropna()
    keyed = keyed.select("y", factor_key(*[col(f) for f in factors]).alias("g"))
    centres = exact_quantiles(keyed, ["y"], [0.5], by=["g"]).select("g", F.col("value").alias("centre"))
    spread = keyed.join(centres, "g").withColumn("z", F.abs(F.col("y") - F.col("centre")))
    fit = between_within(spread.groupBy("g").agg(*_moments(F.col("z"))).filter("n >= 2"))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    tested = fit.select(
        F.col("k").alias("groups"),
        ((F.col("ss_between") / d1) / (F.col("ss_within") / d2)).alias("statistic"),
        d1.alias("d1"),
        d2.alias("d2"),
    )
    return tested.withColumn("p_value", f_p("statistic", "d1", "d2")).drop("d1", "d2")


def tukey_hsd(df: DataFrame, target: str, factor: str, alpha: float = 0.05) -> DataFrame:
    """(group_a, group_b, mean_difference, q, p_adjusted, lower, upper, reject) per pair of groups.

    The self-join runs over the table of group means, whose pairs are the requested report.
    """
    groups = (
        df.select(col(target).cast("double").alias("y"), col(factor).cast("string").alias("g"))
        .dropna()
        .groupBy("g")
        .agg(*_moments(F.col("y")))
    )
    everything = Window.partitionBy(F.lit(1))
    freedom = (F.sum("n").over(everything) - F.count(F.lit(1)).over(everything)).cast("double")
    residual = F.sum(F.col("n") * F.col("variance")).over(everything) / freedom
    groups = groups.select(
        "g", "n", "mean", freedom.alias("freedom"), residual.alias("ms"), F.count(F.lit(1)).over(everything).cast("double").alias("k")
    )
    a = groups.select(F.col("g").alias("group_a"), F.col("n").alias("n_a"), F.col("mean").alias("mean_a"), "freedom", "ms", "k")
    b = groups.select(F.col("g").alias("group_b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"))
    error = F.sqrt(F.col("ms") / 2.0 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    pairs = (
        a.join(b, F.col("group_a") < F.col("group_b"))
        .withColumn("mean_difference", F.col("mean_b") - F.col("mean_a"))
        .withColumn("error", error)
        .withColumn("q", F.abs("mean_difference") / F.col("error"))
        .withColumn("p_adjusted", tukey_p("q", "k", "freedom"))
        .withColumn("margin", tukey_critical(F.lit(float(alpha)), "k", "freedom") * F.col("error"))
    )
    return pairs.select(
        "group_a",
        "group_b",
        "mean_difference",
        "q",
        "p_adjusted",
        (F.col("mean_difference") - F.col("margin")).alias("lower"),
        (F.col("mean_difference") + F.col("margin")).alias("upper"),
        (F.col("p_adjusted") < alpha).alias("reject"),
    )


# ---- normality ----------------------------------------------------------------------------------

SHAPIRO_MIN = 3
# The published p-value formula ends here; beyond it is extrapolated, and marked so.
SHAPIRO_PUBLISHED = 5000
RANKS_AT_ONCE = 100_000
_SMALL_P_A = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
_SMALL_P_B = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)


def _score(rank: int, n: int) -> float:
    """Expected normal score of a rank from 1 to n."""
    return NormalDist().inv_cdf((rank - 0.375) / (n + 0.25))


def value_ranks(values: DataFrame) -> DataFrame:
    """(y, n, upto): each distinct value, how often it occurs, and the rank of its last copy."""
    counts = values.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    sliced = cut_lineage(counts.repartitionByRange("y").withColumn("slice", F.spark_partition_id()))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    starts = sliced.groupBy("slice").agg(F.sum("n").alias("rows"))
    starts = starts.select("slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("slice").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return sliced.join(starts, "slice").select("y", "n", (F.col("start") + F.sum("n").over(inside)).alias("upto"))


def _score_sums(ranks: DataFrame, n: int, ends: int) -> tuple[float, float]:
    """(sum of squared scores, sum of score times centred value without the ``ends`` outermost ranks)."""

    @F.pandas_udf("all double, inner double")
    def sums(first: pd.Series, last: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(first, last):
            scores = np.array([_score(i, n) for i in range(a, b + 1)])
            inner = scores[max(0, ends + 1 - a) : max(0, n - ends - a + 1)]
            out.append((float(scores @ scores), float(inner.sum())))
        return pd.DataFrame(out, columns=["all", "inner"])

    first = F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"), F.lit(RANKS_AT_ONCE)))
    pieces = ranks.withColumn("first", first).withColumn("last", F.least(F.col("first") + RANKS_AT_ONCE - 1, F.col("upto")))
    pieces = pieces.repartition("first").withColumn("s", sums("first", "last"))
    row = pieces.agg(F.sum("s.all").alias("norm"), F.sum(F.col("s.inner") * F.col("z")).alias("inner")).first()
    return row["norm"], row["inner"]


def shapiro_p(w: float, n: int) -> float:
    if w >= 1.0:
        return 1.0
    if n == 3:
        return max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log1p(-w)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return 1e-99
        y = -math.log(gamma - y)
        mean = np.polyval((-0.0006714, 0.025054, -0.39978, 0.5440), n)
        deviation = math.exp(np.polyval((-0.0020322, 0.062767, -0.77857, 1.3822), n))
    else:
        log_n = math.log(n)
        mean = np.polyval((0.0038915, -0.083751, -0.31082, -1.5861), log_n)
        deviation = math.exp(np.polyval((0.0030302, -0.082676, -0.4803), log_n))
    return 0.5 * math.erfc((y - mean) / deviation / math.sqrt(2.0))


def shapiro_wilk(df: DataFrame, target: str) -> DataFrame:
    """(samples, statistic, p_value, extrapolated) for three and more values, by AS R94; fewer give no row.

    Ranks come from the counts of the distinct values and scores are summed over pieces of ranks, so no
    task holds all values, also if one value is most of them. Equal values only have statistic 1.
    """
    values = df.select(col(target).cast("double").alias("y")).dropna()
    spark, schema = df.sparkSession, "samples long, statistic double, p_value double, extrapolated boolean"
    facts = values.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.coalesce(F.var_pop("y"), F.lit(0.0)).alias("v")).first()
    n, squares = facts["n"], facts["v"] * facts["n"]
    if n < SHAPIRO_MIN:
        return spark.createDataFrame([], schema)
    if squares == 0:
        return spark.createDataFrame([(n, 1.0, 1.0, n > SHAPIRO_PUBLISHED)], schema)
    ranks = value_ranks(values).withColumn("z", F.col("y") - facts["mean"])
    outer = ranks.agg(*[F.min(F.when(F.col("upto") >= r, F.col("z"))) for r in (1, 2, n - 1, n)]).first()
    ends = 2 if n > 5 else 1
    norm, inner = _score_sums(ranks, n, ends)
    if n == 3:
        total = math.sqrt(0.5) * (outer[3] - outer[0])
    else:
        top, next_top, u = _score(n, n), _score(n - 1, n), 1.0 / math.sqrt(n)
        last = top / math.sqrt(norm) + np.polyval(_SMALL_P_A, u)
        second = next_top / math.sqrt(norm) + np.polyval(_SMALL_P_B, u) if ends == 2 else 0.0
        rest = (norm - 2 * top**2 - 2 * next_top**2 * (ends == 2)) / (1 - 2 * last**2 - 2 * second**2)
        total = last * (outer[3] - outer[0]) + second * (outer[2] - outer[1]) + inner / math.sqrt(rest)
    w = float(min(1.0, total**2 / squares))
    return spark.createDataFrame([(n, w, float(shapiro_p(w, n)), n > SHAPIRO_PUBLISHED)], schema)


def jarque_bera(df: DataFrame, target: str) -> DataFrame:
    """(samples, statistic, p_value) from skewness and kurtosis; the normality check for any size."""
    from ..functions.distributions import chi_square_p

    y = F.nanvl(col(target).cast("double"), F.lit(None))
    row = df.agg(F.count(y).alias("samples"), F.skewness(y).alias("s"), F.kurtosis(y).alias("k"))
    statistic = F.col("samples") / 6.0 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4.0)
    return row.select("samples", statistic.alias("statistic")).withColumn(
        "p_value", chi_square_p("statistic", F.lit(2.0))
    )


# ---- several factors ----------------------------------------------------------------------------


def _design(cells: pd.DataFrame, factors: Sequence[str], interactions: bool) -> tuple[np.ndarray, list[tuple[tuple[str, ...], slice]]]:
    """Treatment-coded design of the cells: intercept, main effects, then interactions by order."""
    dummies = {}
    for f in factors:
        levels = sorted(cells[f].unique())
        dummies[f] = np.stack([(cells[f] == v).to_numpy(dtype=float) for v in levels[1:]], axis=1) if len(levels) > 1 else np.zeros((len(cells), 0))
    blocks, terms, at = [np.ones((len(cells), 1))], [], 1
    orders = range(1, len(factors) + 1) if interactions else [1]
    for order in orders:
        for subset in itertools.combinations(factors, order):
            block = np.ones((len(cells), 1))
            for f in subset:
                block = (block[:, :, None] * dummies[f][:, None, :]).reshape(len(cells), -1)
            if at + block.shape[1] > MAX_DESIGN_COLUMNS:
                raise TableError("too many factor levels for the normal equations", limit=MAX_DESIGN_COLUMNS)
            blocks.append(block)
            terms.append((subset, slice(at, at + block.shape[1])))
            at += block.shape[1]
    return np.concatenate(blocks, axis=1), terms


def _explained(x: np.ndarray, n: np.ndarray, mean: np.ndarray) -> tuple[float, int]:
    """Weighted sum of squares explained by the columns of x and their rank."""
    root = np.sqrt(n)
    q, s, _ = np.linalg.svd(x * root[:, None], full_matrices=False)
    rank = int((s > s.max() * max(x.shape) * np.finfo(float).eps).sum()) if s.size else 0
    projected = q[:, :rank].T @ (mean * root)
    return float(projected @ projected), rank


def factorial_anova(
    df: DataFrame, target: str, factors: Sequence[str], sum_squares_type: str = "2", include_interactions: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(anova table, one-row fit). Sums of squares of type 1, 2 or 3 by model comparison.

    Type 3 drops each term from the full treatment-coded model and lists the intercept first.
    """
    if len(factors) < 2:
        raise ParameterError("the factorial analysis needs at least two factors")
    if sum_squares_type not in ("1", "2", "3"):
        raise ParameterError("the sum of squares type must be 1, 2 or 3")
    frame = valid_rows(df, target, factors)
    spark = df.sparkSession
    y = col(target).cast("double")
    grouped = frame.groupBy(*[col(f) for f in factors]).agg(*_moments(y))
    cells = grouped.limit(MAX_DESIGN_COLUMNS * 10 + 1).toPandas()
    if len(cells) > MAX_DESIGN_COLUMNS * 10:
        raise TableError("too many factor combinations", limit=MAX_DESIGN_COLUMNS * 10)
    n = cells["n"].to_numpy(dtype=float)
    grand = float((n * cells["mean"]).sum() / n.sum())
    mean = cells["mean"].to_numpy(dtype=float) - grand
    shift = {"3": cells["mean"].to_numpy(dtype=float)}.get(sum_squares_type)
    pure = float((n * cells["variance"]).sum())
    x, terms = _design(cells, factors, include_interactions)
    total = float((n * mean * mean).sum()) + pure
    full, rank = _explained(x, n, mean)
    residual = total - full
    residual_df = float(n.sum() - rank)
    residual_ms = residual / residual_df

    def compare(keep: list[slice], drop: slice, values: np.ndarray, intercept: bool = True) -> tuple[float, float]:
        def columns(parts: list[slice]) -> np.ndarray:
            base = [np.ones((len(cells), 1))] if intercept else []
            return np.concatenate([*base, *[x[:, p] for p in parts]], axis=1) if base or parts else np.zeros((len(cells), 0))

        small, small_rank = _explained(columns(keep), n, values) if columns(keep).shape[1] else (0.0, 0)
        large, large_rank = _explained(columns([*keep, drop]), n, values)
        return large - small, float(large_rank - small_rank)

    rows: list[tuple[str, float, float]] = []
    if sum_squares_type == "3":
        everything = [s for _, s in terms]
        with_all, rank_all = _explained(x, n, shift)
        without, rank_without = _explained(x[:, 1:], n, shift)
        rows.append(("Intercept", float(rank_all - rank_without), with_all - without))
        for subset, part in terms:
            others = [s for s in everything if s is not part]
            squares, freedom = compare(others, part, mean)
            rows.append((":".join(f"C({f})" for f in subset), freedom, squares))
    else:
        for position, (subset, part) in enumerate(terms):
            if sum_squares_type == "1":
                others = [s for _, s in terms[:position]]
            else:
                others = [s for other, s in terms if s is not part and not set(subset) < set(other)]
            squares, freedom = compare(others, part, mean)
            rows.append((":".join(f"C({f})" for f in subset), freedom, squares))
    table = []
    for term, freedom, squares in rows:
        f = squares / freedom / residual_ms if freedom and residual_ms else None
        p = float(f_upper([f], [freedom], [residual_df])[0]) if f is not None else None
        table.append((term, float(freedom), float(squares), None if f is None else float(f), p))
    table.append(("Residual", float(residual_df), float(residual), None, None))
    anova = effect_sizes(
        spark.createDataFrame(table, "term string, df double, sum_sq double, f double, p_value double")
    )
    model_df = float(rank - 1)
    r2 = full / total
    f_model = full / model_df / residual_ms
    fit = spark.createDataFrame(
        [
            (
                int(n.sum()),
                float(r2),
                float(1 - (1 - r2) * (n.sum() - 1) / residual_df),
                float(f_model),
                float(f_upper([f_model], [model_df], [residual_df])[0]),
            )
        ],
        "samples long, r2 double, adj_r2 double, f_statistic double, model_p_value double",
    )
    return anova, fit


def anova_assumptions(df: DataFrame, target: str, factors: Sequence[str]) -> DataFrame:
    """(test, statistic, p_value) rows: Levene and Shapiro-Wilk."""
    frame = df.select(col(target), *[col(f) for f in factors]).dropna()
    equal = levene(frame, target, factors).filter("groups >= 2")
    normal = shapiro_wilk(frame, target)
    return equal.select(F.lit("levene").alias("test"), "statistic", "p_value").unionByName(
        normal.select(F.lit("shapiro").alias("test"), "statistic", "p_value")
    )
