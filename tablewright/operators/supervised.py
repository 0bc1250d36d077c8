"""Supervised learning: split, prepare, fit, score and save, for every catalogued algorithm."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import IMPORTANCE_ROWS, MIN_SUPERVISED_ROWS
from ..errors import ParameterError, TableError
from ..session import cut_lineage, spread
from . import evaluation
from .forest import fit_forest
from .kernel import fit_kernel_machine
from .learners import FourierFeatures, LinearScorer, fit_discriminant, fit_quantile_regression
from .neighbors import knn_join
from .ordering import add_row_index
from .preparation import FEATURES, fit_preparation, select_features
from .shape import col, long_metrics
from .splitting import random_split, stratified_split

KNN_NEIGHBOURS = 5
KERNEL_FEATURES = 200
TREE_DEPTH_LIMIT = 30
# A random forest regressor on at least this many rows is grown over cells of binned rows.
FOREST_ROWS = 100_000
# A support vector id on at least this many rows keeps no Fourier features; more than two classes are left to MLlib.
KERNEL_ROWS = 100_000

CLASSIFIERS = (
    "logistic_regression", "decision_tree_classifier", "random_forest_classifier", "extra_trees_classifier",
    "hist_gradient_boosting_classifier", "xgboost_classifier", "gradient_boosting_classifier", "knn_classifier",
    "naive_bayes_classifier", "svm_classifier", "linear_discriminant_classifier", "quadratic_discriminant_classifier",
)
REGRESSORS = (
    "linear_regression", "ridge_regression", "lasso_regressor", "elastic_net_regressor", "huber_regressor",
    "poisson_regressor", "quantile_regressor", "decision_tree_regressor", "random_forest_regressor",
    "extra_trees_regressor", "bagging_regressor", "gradient_boosting_regressor", "hist_gradient_boosting_regressor",
    "xgboost_regressor", "lightgbm_regressor", "knn_regressor", "svm_regressor",
)


@dataclass
class Facts:
    """What the builders need to know about the training rows."""

    rows: int
    classes: int = 0
    mean: float = 0.0
    deviation: float = 0.0
    width: int = 0
    seed: int = 42
    rounds: int | None = None


def _depth(parameters: Mapping, default: int) -> int:
    depth = int(parameters.get("max_depth", default))
    if depth > TREE_DEPTH_LIMIT:
        raise ParameterError(f"max_depth above {TREE_DEPTH_LIMIT} cannot be trained")
    return depth


def _boosted(estimator: Estimator, facts: Facts) -> Estimator:
    """Boosting is binary in MLlib; more classes go one against the rest."""
    return estimator if facts.classes == 2 else OneVsRest(classifier=estimator)


def build_classifier(algorithm: str, parameters: Mapping, facts: Facts) -> Estimator:
    seed = facts.seed
    if algorithm == "logistic_regression":
        # unit penalty on the summed loss is 1/n on the mean loss
        return LogisticRegression(regParam=1.0 / facts.rows, standardization=False, maxIter=300, tol=1e-7)
    if algorithm == "decision_tree_classifier":
        return DecisionTreeClassifier(maxDepth=_depth(parameters, 8), maxBins=128, seed=seed)
    if algorithm in ("random_forest_classifier", "extra_trees_classifier"):
        extra = algorithm.startswith("extra")
        return RandomForestClassifier(
            numTrees=int(parameters.get("n_estimators", 200)), maxDepth=_depth(parameters, 8), bootstrap=not extra,
            featureSubsetStrategy="sqrt", maxBins=16 if extra else 64, seed=seed,
        )
    if algorithm == "gradient_boosting_classifier":
        return _boosted(GBTClassifier(maxIter=facts.rounds or 100, maxDepth=3, stepSize=0.1, seed=seed), facts)
    if algorithm == "hist_gradient_boosting_classifier":
        return _boosted(
            GBTClassifier(maxIter=facts.rounds or 100, maxDepth=5, stepSize=0.1, maxBins=255, minInstancesPerNode=20, seed=seed), facts
        )
    if algorithm == "xgboost_classifier":
        return _boosted(
            GBTClassifier(
                maxIter=facts.rounds or int(parameters.get("n_estimators", 300)), maxDepth=_depth(parameters, 6), seed=seed,
                stepSize=float(parameters.get("learning_rate", 0.05)), subsamplingRate=float(parameters.get("subsample", 0.8)), maxBins=255,
            ),
            facts,
        )
    if algorithm == "naive_bayes_classifier":
        return NaiveBayes(modelType="gaussian")
    if algorithm == "svm_classifier":
        machine = LinearSVC(featuresCol="kernel_features", regParam=1.0 / facts.rows, maxIter=60, tol=1e-4)
        return machine if facts.classes == 2 else OneVsRest(classifier=machine, featuresCol="kernel_features")
    raise ParameterError(f"unknown classification algorithm: {algorithm}")


def build_regressor(algorithm: str, parameters: Mapping, facts: Facts) -> Estimator:
    seed, alpha = facts.seed, float(parameters.get("alpha", 1.0))
    if algorithm == "linear_regression":
        return LinearRegression(solver="normal")
    if algorithm == "ridge_regression":
        # MLlib divides the squared penalty by the label deviation; undo that
        return LinearRegression(solver="normal", elasticNetParam=0.0, regParam=alpha / facts.rows * facts.deviation, standardization=False)
    if algorithm == "lasso_regressor":
        return LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=1000, tol=1e-9)
    if algorithm == "elastic_net_regressor":
        share = float(parameters.get("l1_ratio", 0.5))
        absolute, squared = alpha * share, alpha * (1.0 - share) * facts.deviation
        total = absolute + squared
        return LinearRegression(
            solver="normal", regParam=total, elasticNetParam=absolute / total if total else 0.0, standardization=False, maxIter=1000, tol=1e-10
        )
    if algorithm == "huber_regressor":
        return LinearRegression(loss="huber", epsilon=float(parameters.get("epsilon", 1.35)), regParam=1e-4, maxIter=2000)
    if algorithm == "poisson_regressor":
        return GeneralizedLinearRegression(family="poisson", link="log", regParam=alpha / facts.mean, maxIter=100)
    if algorithm == "decision_tree_regressor":
        return DecisionTreeRegressor(maxDepth=_depth(parameters, 8), maxBins=128, seed=seed)
    if algorithm in ("random_forest_regressor", "extra_trees_regressor"):
        extra = algorithm.startswith("extra")
        return RandomForestRegressor(
            numTrees=int(parameters.get("n_estimators", 200)), maxDepth=_depth(parameters, 8), bootstrap=not extra,
            featureSubsetStrategy="all", maxBins=16 if extra else 64, seed=seed,
        )
    if algorithm == "bagging_regressor":
        return RandomForestRegressor(numTrees=facts.rounds or 100, maxDepth=8, featureSubsetStrategy="all", subsamplingRate=1.0, maxBins=128, seed=seed)
    if algorithm == "gradient_boosting_regressor":
        return GBTRegressor(maxIter=facts.rounds or 100, maxDepth=3, stepSize=0.1, seed=seed)
    if algorithm == "hist_gradient_boosting_regressor":
        return GBTRegressor(maxIter=facts.rounds or 100, maxDepth=5, stepSize=0.1, maxBins=255, minInstancesPerNode=20, seed=seed)
    if algorithm == "xgboost_regressor":
        return GBTRegressor(
            maxIter=facts.rounds or int(parameters.get("n_estimators", 300)), maxDepth=_depth(parameters, 6), seed=seed,
            stepSize=float(parameters.get("learning_rate", 0.05)), subsamplingRate=float(parameters.get("subsample", 0.8)), maxBins=255,
        )
    if algorithm == "lightgbm_regressor":
        return GBTRegressor(maxIter=facts.rounds or 200, maxDepth=5, stepSize=0.05, maxBins=255, minInstancesPerNode=20, seed=seed)
    if algorithm == "svm_regressor":
        return LinearRegression(featuresCol="kernel_features", loss="huber", epsilon=1.35, regParam=1.0 / facts.rows, maxIter=200, tol=1e-5)
    raise ParameterError(f"unknown regression algorithm: {algorithm}")


def _kernel(facts: Facts) -> FourierFeatures:
    return FourierFeatures(size=KERNEL_FEATURES, inputs=facts.width, gamma=1.0 / max(1, facts.width), seed=facts.seed)


@dataclass
class FittedModel:
    """Preparation, estimator, roles and labels in one bundle."""

    algorithm: str
    task: str
    target: str
    features: list[str]
    names: list[str]
    pipeline: PipelineModel
    labels: list[str] | None = None
    neighbours: DataFrame | None = None  # (id, x, label) for the neighbour algorithms
    key: list[str] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        """Adds prediction (label index or value) and, where the algorithm has one, probability."""
        if self.neighbours is not None:
            return self._score_by_neighbours(df)
        scored = self.pipeline.transform(df)
        if self.task == "classification":
            last = self.pipeline.stages[-1]
            if "probability" in scored.columns:
                if not isinstance(scored.schema["probability"].dataType, T.ArrayType):
                    scored = scored.withColumn("probability", vector_to_array("probability"))
            elif isinstance(last, OneVsRestModel) and ("boosting" in self.algorithm or "xgboost" in self.algorithm):
                # margins of the one-against-rest models through the logistic link of boosted trees
                margins = vector_to_array("rawPrediction")
                scored = scored.withColumn("probability", F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m))))
        return scored.drop(FEATURES, "rawPrediction", "kernel_features", *[c for c in scored.columns if c.startswith(("__num", "__cat", "__idx", "__hot"))])

    def _score_by_neighbours(self, df: DataFrame) -> DataFrame:
        rows, row_id = with_long_id(df, self.key)
        queries = self.pipeline.transform(rows).select(col(row_id).alias("id"), vector_to_array(FEATURES).alias("x"))
        near = knn_join(queries, self.neighbours, KNN_NEIGHBOURS)
        voted = near.join(self.neighbours.select(F.col("id").alias("neighbour_id"), "label"), "neighbour_id")
        if self.task == "classification":
            k = len(self.labels)
            shares = [F.avg((F.col("label") == c).cast("double")).alias(f"p{c}") for c in range(k)]
            answer = voted.groupBy("query_id").agg(*shares).select(
                "query_id", F.array(*[F.col(f"p{c}") for c in range(k)]).alias("probability")
            )
            best = F.array_position("probability", F.array_max("probability")) - 1
            answer = answer.withColumn("prediction", best.cast("double"))
        else:
            answer = voted.groupBy("query_id").agg(F.avg("label").alias("prediction"))
        joined = rows.join(answer, col(row_id) == F.col("query_id")).drop("query_id")
        return joined.drop(row_id) if row_id not in df.columns else joined

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds predicted (label text or value) to new rows."""
        scored = self.score(df)
        if self.labels is None:
            return scored.withColumnRenamed("prediction", "predicted")
        names = F.array(*[F.lit(v) for v in self.labels])
        return scored.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1)).drop("prediction", "probability")

    def save(self, path: str, spark: SparkSession) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        if self.neighbours is not None:
            self.neighbours.write.mode("overwrite").parquet(f"{path}/neighbours")
        facts = {
            k: getattr(self, k) for k in ("algorithm", "task", "target", "features", "names", "labels", "key")
        } | {"has_neighbours": self.neighbours is not None}
        spark.createDataFrame([(json.dumps(facts, ensure_ascii=False),)], "facts string").write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> FittedModel:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        stored = spark.read.parquet(f"{path}/neighbours") if facts.pop("has_neighbours") else None
        return cls(pipeline=PipelineModel.load(f"{path}/pipeline"), neighbours=stored, **facts)


def with_long_id(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, str]:
    """The key itself when it is one integer column, otherwise an exact row index in key order."""
    if len(key) == 1 and isinstance(df.schema[key[0]].dataType, T.IntegralType):
        return df, key[0]
    return add_row_index(df, list(key), "row_id"), "row_id"


@dataclass
class SupervisedRun:
    model: FittedModel
    metrics: DataFrame
    tables: dict[str, DataFrame]
    predictions: DataFrame


def training_rows(df: DataFrame, target: str) -> DataFrame:
    if not target or target not in df.columns:
        raise ParameterError("the target column does not exist", target=target)
    present = col(target).isNotNull()
    if isinstance(df.schema[target].dataType, (T.DoubleType, T.FloatType)):
        present = present & ~F.isnan(col(target))
    rows = df.filter(present)
    if rows.limit(MIN_SUPERVISED_ROWS).count() < MIN_SUPERVISED_ROWS:
        raise TableError("too few rows with a target value", needed=MIN_SUPERVISED_ROWS)
    return rows


def fit_model(
    train: DataFrame, algorithm: str, target: str, features: list[str], key: Sequence[str], labels: list[str] | None,
    parameters: Mapping, seed: int, rounds: int | None = None,
) -> FittedModel:
    """Preparation and estimator fitted on ``train``, which carries a numeric ``label`` column."""
    task = "classification" if labels is not None else "regression"
    preparation = fit_preparation(train, features)
    prepared = preparation.transform(train).select(*[col(k) for k in key], FEATURES, "label").persist()
    try:
        y = prepared.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("m"), F.stddev_pop("label").alias("s"), F.min("label").alias("low")).first()
        facts = Facts(y["n"], len(labels or []), y["m"] or 0.0, y["s"] or 0.0, len(preparation.names), seed, rounds)
        neighbours = None
        if algorithm in ("knn_classifier", "knn_regressor"):
            rows, row_id = with_long_id(prepared, key)
            neighbours = cut_lineage(rows.select(col(row_id).cast("long").alias("id"), vector_to_array(FEATURES).alias("x"), "label"))
            stages = []
        elif algorithm in ("linear_discriminant_classifier", "quadratic_discriminant_classifier"):
            stages = [fit_discriminant(prepared, len(labels), algorithm.startswith("quadratic"))]
        elif algorithm == "quantile_regressor":
            stages = [fit_quantile_regression(prepared, float(parameters.get("quantile", 0.5)), float(parameters.get("alpha", 1.0)))]
        elif algorithm == "random_forest_regressor" and facts.rows >= FOREST_ROWS:
            stages = [
                fit_forest(
                    prepared, key, facts.width, facts.rows, facts.mean, facts.deviation,
                    int(parameters.get("n_estimators", 200)), _depth(parameters, 8), seed=seed,
                )
            ]
        elif algorithm in ("svm_classifier", "svm_regressor") and facts.rows >= KERNEL_ROWS and facts.classes in (0, 2):
            stages = [fit_kernel_machine(prepared, _kernel(facts), facts.rows, facts.mean, facts.deviation, labels is not None)]
        elif algorithm in ("svm_classifier", "svm_regressor"):
            kernel = _kernel(facts)
            # not kept here: the fit keeps its own blocks of the lifted rows
            lifted = kernel.transform(prepared).select("kernel_features", "label")
            build = build_classifier if labels is not None else build_regressor
            stages = [kernel, build(algorithm, parameters, facts).fit(lifted)]
        elif labels is not None:
            stages = [build_classifier(algorithm, parameters, facts).fit(prepared)]
        else:
            if algorithm == "poisson_regressor" and y["low"] < 0:
                raise TableError("the Poisson regression needs a target without negative values")
            stages = [build_regressor(algorithm, parameters, facts).fit(prepared)]
    finally:
        prepared.unpersist()
    pipeline = PipelineModel([*preparation.model.stages, *stages])
    return FittedModel(algorithm, task, target, features, preparation.names, pipeline, labels, neighbours, list(key))


def feature_importance(model: FittedModel, spark: SparkSession) -> DataFrame | None:
    """(feature, importance): tree importances, or mean absolute coefficients; top rows first."""
    last = model.pipeline.stages[-1]
    values = None
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif isinstance(last, OneVsRestModel) and hasattr(last.models[0], "featureImportances"):
        values = sum(m.featureImportances.toArray() for m in last.models) / len(last.models)
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif isinstance(last, LinearScorer):
        values = abs(last.floats("coefficients"))
    elif hasattr(last, "coefficients") and model.algorithm != "svm_regressor":
        values = abs(last.coefficients.toArray())
    if values is None or len(values) != len(model.names):
        return None
    return evaluation.ranked_importance(model.names, list(values), spark, IMPORTANCE_ROWS)


def run_supervised(
    df: DataFrame, algorithm: str, target: str, key: Sequence[str], features: Sequence[str] = (), excluded: Sequence[str] = (),
    parameters: Mapping | None = None, ratio: float = 0.2, seed: int = 42, rounds: int | None = None,
) -> SupervisedRun:
    """The whole run. ``key`` identifies a row; it makes the split and every preview reproducible.

    ``rounds`` shortens the ensembles whose length is not a catalogued parameter.
    """
    parameters = dict(parameters or {})
    spark = df.sparkSession
    if algorithm not in CLASSIFIERS + REGRESSORS:
        raise ParameterError(f"unknown supervised algorithm: {algorithm}")
    rows = training_rows(df, target)
    names = select_features(rows, features, {target, *key, *excluded})
    rows = rows.select(*dict.fromkeys([*key, *names, target]))
    labels = None
    if algorithm in CLASSIFIERS:
        rows = rows.withColumn("__class", col(target).cast("string"))
        labels = sorted(r[0] for r in rows.select("__class").distinct().limit(10_001).collect())
        if len(labels) < 2:
            raise TableError("a classification target needs at least two classes")
        if len(labels) > 10_000:
            raise TableError("more classes than a classifier can hold", classes=len(labels))
        marked = stratified_split(rows, key, "__class", ratio, seed)
        codes = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i)))])
        marked = marked.withColumn("label", codes[F.col("__class")])
    else:
        marked = random_split(rows, key, ratio, seed).withColumn("label", col(target).cast("double"))
    # read by every fitting pass, in even parts, however few row groups the table has; lost blocks are recomputed from the input
    marked = spread(marked, rows.count(), key).persist()
    model = fit_model(marked.filter("NOT is_test"), algorithm, target, names, key, labels, parameters, seed, rounds)
    scored = model.score(marked.filter("is_test"))
    tables: dict[str, DataFrame] = {}
    if labels is not None:
        text = F.array(*[F.lit(v) for v in labels])
        keep = [*[col(k) for k in key], F.col("label").alias("label_index")] + (["probability"] if "probability" in scored.columns else [])
        predictions = scored.select(
            *keep, F.col("__class").alias("actual") if "__class" in scored.columns else F.element_at(text, F.col("label").cast("int") + 1).alias("actual"),
            F.element_at(text, F.col("prediction").cast("int") + 1).alias("predicted"),
        )
        predictions = cut_lineage(predictions)
        metrics = long_metrics(evaluation.classification_metrics(predictions))
        if "probability" in predictions.columns:
            metrics = metrics.unionByName(long_metrics(evaluation.log_loss(predictions, "label_index", "probability")))
        tables["confusion_matrix"] = evaluation.confusion_matrix(predictions)
    else:
        predictions = cut_lineage(scored.select(*[col(k) for k in key], F.col("label").alias("actual"), F.col("prediction").alias("predicted")))
        metrics = long_metrics(evaluation.regression_metrics(predictions))
        tables["residuals"] = evaluation.residuals(predictions, list(key))
    metrics = metrics.unionByName(long_metrics(evaluation.sample_counts(marked, "is_test")))
    importance = feature_importance(model, spark)
    if importance is not None:
        tables["feature_importance"] = importance
    metrics = cut_lineage(metrics)
    marked.unpersist()
    return SupervisedRun(model, metrics, tables, predictions)
