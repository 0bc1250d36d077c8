"""Windowed sequence learning: time split, scaling on the training period, flattened windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ALL_ROWS_GROUP, MIN_TEST_WINDOWS, MIN_TRAIN_WINDOWS, PREDICTION_ROWS
from ..errors import ParameterError, TableError
from ..functions.scalars import to_strict_timestamp
from ..session import cut_lineage
from .evaluation import classification_metrics, regression_metrics
from .ordering import HOT_SERIES_ROWS, add_row_index, sliding_windows
from .preparation import fit_scaling
from .shape import col, long_metrics
from .splitting import time_cutoff

SEQUENCE_REGRESSORS = ("rnn_regressor", "lstm_regressor", "gru_regressor")
SEQUENCE_CLASSIFIERS = ("rnn_classifier", "lstm_classifier", "gru_classifier")


@dataclass
class SequenceData:
    """Windows with their target and side of the time split."""

    windows: DataFrame  # series, at, order keys, window_values, target, is_train, label
    cutoff: int
    features: list[str]
    labels: list[str] | None
    scaling: list


def series_frame(df: DataFrame, target: str, time: str, group: str | None, features: Sequence[str], order_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(series, at, order keys..., features..., target) of complete rows; times must all be readable."""
    for role, name in (("target", target), ("time", time)):
        if not name or name not in df.columns:
            raise ParameterError(f"the {role} column does not exist", column=name)
    names = list(features) or [c for c in df.columns if c not in {target, time, group, *order_by}]
    missing = sorted(set(names) - set(df.columns))
    if missing or not names:
        raise ParameterError("sequence features do not exist", missing=missing)
    if any(not isinstance(df.schema[c].dataType, T.NumericType) for c in names):
        raise ParameterError("sequence features must be numeric")
    raw = col(time)
    at = to_strict_timestamp(raw) if isinstance(df.schema[time].dataType, T.StringType) else raw.cast("timestamp")
    timed = df.withColumn("at", at)
    if not timed.filter(F.col("at").isNull()).limit(1).isEmpty():
        raise TableError("the time column contains values that cannot be read", column=time)
    series = F.coalesce(col(group).cast("string"), F.lit("None")) if group else F.lit(ALL_ROWS_GROUP)
    kept = timed.dropna(subset=[*names, target])
    return (
        kept.select(
            series.alias("series"), "at", *[col(c) for c in order_by],
            *[col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)], col(target).alias("target"),
        ),
        names,
    )


def sequence_data(
    df: DataFrame, target: str, time: str, group: str | None = None, features: Sequence[str] = (), order_by: Sequence[str] = (),
    window: int = 12, horizon: int = 1, ratio: float = 0.2, classification: bool = False, hot_rows: int = HOT_SERIES_ROWS,
) -> SequenceData:
    """Windows for training and testing; a window belongs to the side of its predicted row.

    ``order_by`` breaks ties between equal times. The scaler sees the training period only.
    """
    frame, names = series_frame(df, target, time, group, features, order_by)
    cutoff = time_cutoff(frame, "at", ratio)
    frame = frame.withColumn("is_train", F.unix_micros("at") <= F.lit(cutoff))
    sides = frame.agg(F.count_if("is_train"), F.count_if(~F.col("is_train"))).first()
    if not sides[0] or not sides[1]:
        raise TableError("the time split leaves one side empty")
    slots = [f"f{i}" for i in range(len(names))]
    scaling = fit_scaling(frame.filter("is_train"), slots, impute=False)
    keep = [c for c in frame.columns if c not in slots]
    scaled = frame.select(*keep, *[F.expr(s.sql()).alias(s.name) for s in scaling])
    windows = sliding_windows(scaled, "series", ["at", *order_by], slots, window, horizon, hot_rows).drop(*slots)
    labels = None
    if classification:
        coded = label_codes(frame.filter("is_train"), "target")
        # the network has one output per class, so the class names are no larger than the model
        labels = [r["name"] for r in coded.orderBy("label").collect()]
        if len(labels) < 2:
            raise TableError("a sequence class target needs at least two training classes")
        # rows whose label was not seen in training are left out
        windows = windows.join(coded, F.col("target").cast("string") == F.col("name")).drop("name")
    else:
        windows = windows.withColumn("label", F.col("target").cast("double"))
    return SequenceData(windows, cutoff, names, labels, scaling)


def label_codes(rows: DataFrame, target: str) -> DataFrame:
    """(name, label): every class of the rows and its place in the order of names, as a double."""
    names = rows.select(F.col(target).cast("string").alias("name")).filter("name IS NOT NULL").distinct()
    return add_row_index(names, ["name"], "label").withColumn("label", F.col("label").cast("double"))


def flattened(windows: DataFrame, width: int) -> DataFrame:
    """Adds features: the window values in time order as one vector."""
    parts = F.flatten(F.transform("window_values", lambda w: F.array(*[w[f"f{i}"] for i in range(width)])))
    return windows.withColumn("features", array_to_vector(parts))


def _regressor(algorithm: str, parameters: Mapping, seed: int):
    """Distributed stand-ins for the three cells: linear, boosted and bagged trees on the window."""
    if algorithm == "rnn_regressor":
        return LinearRegression(regParam=1e-3, elasticNetParam=0.0, maxIter=200, solver="l-bfgs")
    if algorithm == "lstm_regressor":
        return GBTRegressor(maxIter=int(parameters.get("epochs", 30)), maxDepth=4, stepSize=0.1, seed=seed)
    return RandomForestRegressor(numTrees=2 * int(parameters.get("epochs", 30)), maxDepth=8, seed=seed)


def _classifier(algorithm: str, parameters: Mapping, inputs: int, classes: int, seed: int):
    hidden = int(parameters.get("hidden_size", 32))
    layers = {"rnn": [hidden], "lstm": [hidden, max(2, hidden // 2)], "gru": [max(2, hidden // 2)]}[algorithm.split("_")[0]]
    return MultilayerPerceptronClassifier(
        layers=[inputs, *layers * int(parameters.get("num_layers", 1)), classes], seed=seed, blockSize=max(32, int(parameters.get("batch_size", 32))),
        maxIter=int(parameters.get("epochs", 30)),
    )


@dataclass
class SequenceRun:
    model: PipelineModel
    metrics: DataFrame
    tables: dict[str, DataFrame]
    predictions: DataFrame


def run_sequence(
    df: DataFrame, algorithm: str, target: str, time: str, group: str | None = None, features: Sequence[str] = (), order_by: Sequence[str] = (),
    parameters: Mapping | None = None, ratio: float = 0.2, seed: int = 42,
) -> SequenceRun:
    parameters = dict(parameters or {})
    if algorithm not in SEQUENCE_REGRESSORS + SEQUENCE_CLASSIFIERS:
        raise ParameterError(f"unknown sequence algorithm: {algorithm}")
    spark, classes = df.sparkSession, algorithm in SEQUENCE_CLASSIFIERS
    window, horizon = int(parameters.get("window_size", 12)), int(parameters.get("horizon", 1))
    data = sequence_data(df, target, time, group, features, order_by, window, horizon, ratio, classes)
    ready = flattened(data.windows, len(data.features)).select("series", "at", *order_by, "is_train", "target", "label", "features").persist()
    counts = ready.agg(F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test")).first()
    if counts["train"] < MIN_TRAIN_WINDOWS or counts["test"] < MIN_TEST_WINDOWS:
        ready.unpersist()
        raise TableError("too few windows; shorten the window or add data", train=counts["train"], test=counts["test"])
    train, test = ready.filter("is_train"), ready.filter(~F.col("is_train"))
    estimator = (
        _classifier(algorithm, parameters, window * len(data.features), len(data.labels), seed) if classes else _regressor(algorithm, parameters, seed)
    )
    fitted = estimator.fit(train)
    scored = fitted.transform(test)
    order = ["series", "at", *order_by]
    if classes:
        names = F.array(*[F.lit(v) for v in data.labels])
        predictions = scored.select(*order, F.col("target").cast("string").alias("actual"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))
        row = classification_metrics(cut_lineage(predictions)).select("accuracy", "f1_weighted")
    else:
        predictions = scored.select(*order, F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
        row = regression_metrics(cut_lineage(predictions)).select("mae", "mse", "r2")
    sizes = spark.createDataFrame(
        [(float(counts["test"]), float(counts["train"]), float(counts["test"]))], "samples double, train_samples double, test_samples double"
    )
    predictions = cut_lineage(predictions)
    metrics = cut_lineage(long_metrics(row).unionByName(long_metrics(sizes)))
    tables = {
        "prediction_preview": predictions.orderBy(*order).limit(PREDICTION_ROWS).select("actual", "predicted"),
        "loss_history": loss_history(fitted, train),
    }
    ready.unpersist()
    return SequenceRun(PipelineModel([fitted]), metrics, tables, predictions)


def _ensemble_losses(fitted, train: DataFrame) -> list[float]:
    """Mean squared training error after each boosting round or with each further bagged tree, in one pass for the latter."""
    if isinstance(fitted, GBTRegressionModel):
        return list(fitted.evaluateEachIteration(train, "squared"))
    frame, total, errors = train.select("label", "features"), F.lit(0.0), []
    for i, tree in enumerate(fitted.trees):
        frame = tree.setFeaturesCol("features").setPredictionCol(f"tree_{i}").transform(frame)
        total = total + F.col(f"tree_{i}")
        errors.append(F.avg(F.pow(F.col("label") - total / (i + 1), F.lit(2.0))))
    return list(frame.agg(*errors).first())


def loss_history(fitted, train: DataFrame) -> DataFrame:
    """(epoch, loss): the objective the trainer recorded, or the training error by size of a tree ensemble."""
    spark, summary = train.sparkSession, None
    if isinstance(fitted, (GBTRegressionModel, RandomForestRegressionModel)):
        losses = _ensemble_losses(fitted, train)
        return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(losses)], "epoch int, loss double")
    if isinstance(fitted, (LinearRegressionModel, MultilayerPerceptronClassificationModel)) and fitted.hasSummary:
        summary = fitted.summary if isinstance(fitted, LinearRegressionModel) else fitted.summary()
    history = list(summary.objectiveHistory) if summary is not None else []
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(history)], "epoch int, loss double")
