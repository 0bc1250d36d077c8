"""Quality metrics of predictions, all from one grouped or global aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RESIDUAL_ROWS
from .shape import col


def confusion_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Observed (actual, predicted, count) cells as text labels."""
    return df.groupBy(
        col(actual).cast("string").alias("actual"), col(predicted).cast("string").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Full (actual, predicted, count) grid over the union of both label sets, zeros included.

    The grid has (number of classes) squared rows by definition; it is laid out from class lists
    taken from the aggregated cells.
    """
    cells = confusion_counts(df, actual, predicted)
    labels = cells.select(F.col("actual").alias("label")).union(cells.select("predicted")).distinct()
    all_labels = labels.agg(F.array_sort(F.collect_set("label")).alias("l")).scalar()
    grid = labels.select(F.col("label").alias("actual"), F.explode(all_labels).alias("predicted"))
    return grid.join(cells, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0).cast("long")).alias("count")
    )


def classification_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, balanced_accuracy, precision/recall/f1 weighted by support (0 for 0/0)."""
    cells = confusion_counts(df, actual, predicted)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("count").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0).alias("hits")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("count").alias("called"), F.lit(0).cast("long").alias("hits")),
            )
        ).alias("r")
    ).select("r.*")
    per_label = sides.groupBy("label").agg(F.sum("support").alias("s"), F.sum("called").alias("c"), F.sum("hits").alias("h"))
    precision = F.when(F.col("c") > 0, F.col("h") / F.col("c")).otherwise(0.0)
    recall = F.when(F.col("s") > 0, F.col("h") / F.col("s")).otherwise(0.0)
    f1 = F.when(F.col("h") > 0, 2.0 * F.col("h") / (F.col("c") + F.col("s"))).otherwise(0.0)
    total = F.sum("s")
    return per_label.agg(
        (F.sum("h") / total).alias("accuracy"),
        F.avg(F.when(F.col("s") > 0, recall)).alias("balanced_accuracy"),
        (F.sum(precision * F.col("s")) / total).alias("precision_weighted"),
        (F.sum(recall * F.col("s")) / total).alias("recall_weighted"),
        (F.sum(f1 * F.col("s")) / total).alias("f1_weighted"),
    )


def log_loss(df: DataFrame, label_index: str, probability: str) -> DataFrame:
    """One row (log_loss): probabilities are normalised and clipped away from 0 and 1.

    ``probability`` is an array of class probabilities in label-index order.
    """
    total = F.aggregate(col(probability), F.lit(0.0), lambda s, x: s + x)
    p = F.element_at(col(probability), col(label_index).cast("int") + 1) / total
    eps = 2.220446049250313e-16
    return df.agg((-F.avg(F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))))).alias("log_loss"))


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: mae, mse, rmse, r2 (1 for a perfect fit of a constant, else 0 for a constant)."""
    a, p = col(actual).cast("double"), col(predicted).cast("double")
    error = a - p
    row = df.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(a).alias("spread"),
    )
    r2 = (
        F.when(F.col("spread") > 0, 1.0 - F.col("mse") / F.col("spread"))
        .when(F.col("mse") == 0, 1.0)
        .otherwise(0.0)
    )
    return row.select("mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def residuals(df: DataFrame, order_by: list[str], actual: str = "actual", predicted: str = "predicted", rows: int | None = RESIDUAL_ROWS) -> DataFrame:
    """(keys..., actual, predicted, residual); the first rows in key order, or all with rows=None."""
    a, p = col(actual).cast("double"), col(predicted).cast("double")
    out = df.select(*[col(c) for c in order_by], a.alias("actual"), p.alias("predicted"), (a - p).alias("residual"))
    return out.orderBy(*[col(c) for c in order_by]).limit(rows) if rows else out


def sample_counts(df: DataFrame, is_test: str) -> DataFrame:
    """One row: samples, train_samples, test_samples."""
    return df.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(~col(is_test)).alias("train_samples"),
        F.count_if(col(is_test)).alias("test_samples"),
    )


def pivot_counts(df: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """(actual, one column per predicted label) with zero fill."""
    pivoted = df.groupBy("actual").pivot("predicted", levels).agg(F.sum("count"))
    return pivoted.na.fill(0)


def ranked_importance(names: list[str], values: list[float], spark, rows: int) -> DataFrame:
    """(feature, importance) of a fitted model, descending, ties in slot order."""
    frame = spark.createDataFrame(
        [(i, n, float(v)) for i, (n, v) in enumerate(zip(names, values))], "slot int, feature string, importance double"
    )
    return frame.orderBy(F.desc("importance"), "slot").limit(rows).drop("slot")


