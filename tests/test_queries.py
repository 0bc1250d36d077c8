"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tablewright.plans import catalogue, charting, clustering, evaluating, learning, preparing, profiling, sequencing, sourcing, tabular, testing

from .oracle import compare, connect

LIGHT = {**profiling.ORACLES, **tabular.ORACLES, **charting.ORACLES, **evaluating.ORACLES, **preparing.ORACLES, **testing.ORACLES, **sourcing.ORACLES}
LIGHT |= {k: v for k, v in clustering.ORACLES.items() if k not in ("kmeans", "fuzzy_cmeans")}
LIGHT |= {k: learning.ORACLES[k] for k in ("ridge_regression", "pca", "truncated_svd", "saved_model_predictions")}
LIGHT |= {k: sequencing.ORACLES[k] for k in ("sliding_windows_ahead", "last_value_regression")}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(LIGHT))
def test_matches_sql(spark, con, sf, name):
    assert compare(catalogue.all_queries()[name](spark, sf), con, LIGHT[name]) == ""


def test_every_sql_has_a_query():
    assert set(catalogue.all_oracles()) <= set(catalogue.all_queries())


def test_flagship(spark, sf):
    rows = {r["metric"]: r["value"] for r in catalogue.flagship(spark, sf).collect()}
    assert {"mae", "mse", "rmse", "r2", "samples"} <= set(rows)
    assert rows["samples"] == rows["train_samples"] + rows["test_samples"]
