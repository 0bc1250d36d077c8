from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright import registry
from tablewright.errors import ParameterError, TableError
from tablewright.operators import supervised
from tablewright.plans import learning

from . import fixtures


def values(frame):
    return {r["metric"]: r["value"] for r in frame.collect()}


@pytest.fixture(scope="module")
def classes(spark):
    return fixtures.classification(spark).cache()


@pytest.fixture(scope="module")
def numbers(spark):
    return fixtures.regression(spark).cache()


@pytest.mark.parametrize(
    "algorithm",
    ["logistic_regression", "random_forest_classifier", "knn_classifier", "svm_classifier", "linear_discriminant_classifier"],
)
def test_classifiers_reach_the_floor(classes, algorithm):
    small = {"n_estimators": 10, "max_depth": 4} if "forest" in algorithm or "xgboost" in algorithm else {}
    result = registry.run(classes, algorithm, key=["id"], target="target_class", parameters=small)
    metrics = values(result.metrics)
    assert metrics["accuracy"] >= 0.90 and metrics["f1_weighted"] >= 0.90
    assert result.tables["confusion_matrix"].agg(F.sum("count")).first()[0] == metrics["test_samples"] == 48


@pytest.mark.parametrize(
    "algorithm, parameters",
    [("huber_regressor", {}), ("quantile_regressor", {"alpha": 0.01}), ("random_forest_regressor", {"n_estimators": 20}), ("knn_regressor", {}),
     ("xgboost_regressor", {"n_estimators": 25, "learning_rate": 0.3, "max_depth": 4})],
)
def test_regressors_reach_the_floor(numbers, algorithm, parameters):
    metrics = values(registry.run(numbers, algorithm, key=["id"], target="target_value", parameters=parameters).metrics)
    assert metrics["r2"] >= 0.85 and metrics["mae"] < 4.0


@pytest.mark.parametrize("algorithm", ["linear_discriminant_classifier", "knn_classifier"])
def test_reloaded_models_predict_the_same(spark, classes, tmp_path, algorithm):
    model = supervised.run_supervised(classes, algorithm, "target_class", ["id"]).model
    model.save(str(tmp_path / algorithm), spark)
    again = supervised.FittedModel.load(str(tmp_path / algorithm), spark)
    rows = [sorted((r["id"], r["predicted"]) for r in m.predict(classes).select("id", "predicted").collect()) for m in (model, again)]
    assert rows[0] == rows[1] and len(rows[0]) == 240


def test_quantile_fit_equals_grid_search(numbers):
    """The fitted median line is not beaten by small moves in any direction."""
    frame = numbers.toPandas()
    run = supervised.run_supervised(numbers, "quantile_regressor", "target_value", ["id"], ["feature_x"], parameters={"quantile": 0.3, "alpha": 0.0})
    line = run.model.pipeline.stages[-1]
    held = {r["id"] for r in run.predictions.select("id").collect()}
    train = frame[~frame.id.isin(held)]
    z = (train.feature_x - train.feature_x.mean()) / train.feature_x.std(ddof=0)

    def loss(b0, b1):
        r = train.target_value - b0 - b1 * z
        return np.where(r >= 0, 0.3 * r, -0.7 * r).mean()

    b0, b1 = line.getOrDefault("intercept"), line.getOrDefault("coefficients")[0]
    best = loss(b0, b1)
    assert all(loss(b0 + i * 0.02, b1 + j * 0.02) >= best - 1e-4 for i in (-1, 0, 1) for j in (-1, 0, 1))


def test_supervised_refusals(classes, numbers):
    with pytest.raises(ParameterError):
        registry.run(classes, "logistic_regression", key=["id"], target="missing")
    with pytest.raises(ParameterError):
        registry.run(classes, "logistic_regression", key=["id"])
    with pytest.raises(ParameterError):
        registry.run(numbers, "random_forest_regressor", key=["id"], target="target_value", parameters={"max_depth": 0})
    with pytest.raises(ParameterError):
        registry.run(numbers, "linear_regression", key=["id"], target="target_value", parameters={"depth": 3})
    with pytest.raises(TableError):
        registry.run(numbers.limit(12), "linear_regression", key=["id"], target="target_value")
    with pytest.raises(TableError):
        registry.run(numbers, "poisson_regressor", key=["id"], target="target_value")


def rand_index(a, b):
    pairs = lambda n: n * (n - 1) / 2
    both = sum(pairs(v) for v in Counter(zip(a, b)).values())
    left, right = (sum(pairs(v) for v in Counter(c).values()) for c in (a, b))
    chance = left * right / pairs(len(a))
    return (both - chance) / ((left + right) / 2 - chance)


@pytest.mark.parametrize(
    "algorithm, parameters",
    [("kmeans", {}), ("agglomerative", {}), ("dbscan", {"eps": 0.6}), ("hdbscan", {"min_cluster_size": 20}), ("gaussian_mixture", {}), ("birch", {}), ("spectral_clustering", {})],
)
def test_clusterings_find_the_blobs(spark, algorithm, parameters):
    frame = fixtures.blobs(spark)
    result = registry.run(frame, algorithm, key=["id"], features=["feature_x", "feature_y"], parameters=parameters, pairwise_silhouette=True)
    metrics = values(result.metrics)
    assert metrics["clusters"] == 3 and metrics["silhouette_squared"] > 0.70 and metrics["silhouette"] > 0.70
    rows = result.tables["assignments"].orderBy("row_index").collect()
    truth = [r["expected"] for r in frame.orderBy("id").collect()]
    assert rand_index(truth, [r["cluster"] for r in rows]) > 0.90


def test_too_many_clusters(spark):
    with pytest.raises(TableError):
        registry.run(fixtures.blobs(spark).limit(10), "kmeans", key=["id"], features=["feature_x"], parameters={"n_clusters": 10})


@pytest.mark.parametrize("algorithm", ["rnn_regressor", "rnn_classifier"])
def test_sequences_reach_the_floor(spark, algorithm):
    target = "target_class" if algorithm.endswith("classifier") else "target_value"
    result = registry.run(
        fixtures.series(spark), algorithm, key=["series_id", "timestamp"], target=target, time="timestamp", group="series_id", features=["signal", "temperature"]
    )
    metrics = values(result.metrics)
    if target == "target_class":
        assert metrics["accuracy"] >= 0.45 and metrics["f1_weighted"] >= 0.35
    else:
        assert metrics["r2"] > -2.0
    assert result.tables["prediction_preview"].count() <= 200
    assert result.tables["loss_history"].count() > 0


def test_unreadable_times_are_refused(spark):
    frame = fixtures.series(spark).withColumn("timestamp", F.lit("soon"))
    with pytest.raises(TableError):
        registry.run(frame, "rnn_regressor", key=["series_id"], target="target_value", time="timestamp", group="series_id", features=["signal"])


def test_catalogue_has_all_algorithms():
    assert len(registry.ALGORITHMS) == 58
    assert registry.normalise_parameters("xgboost_classifier", {})["learning_rate"] == 0.05


@pytest.mark.parametrize("name", ["gradient_boosting_classifier", "hist_gradient_boosting_classifier", "xgboost_classifier"])
def test_boosted_classifier_queries_run_all_rounds(spark, sf, monkeypatch, name):
    seen = {}

    def stop(*args, **named):
        seen.update(named)
        raise LookupError

    monkeypatch.setattr(learning.supervised, "run_supervised", stop)
    with pytest.raises(LookupError):
        learning.QUERIES[name](spark, sf)
    parameters = registry.normalise_parameters(name, seen["parameters"] or {})
    defaults = registry.normalise_parameters(name, {})
    assert seen["rounds"] is None and parameters == defaults
