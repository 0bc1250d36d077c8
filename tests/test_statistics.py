from __future__ import annotations

import itertools
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright import registry
from tablewright.errors import ParameterError, TableError
from tablewright.functions import distributions
from tablewright.operators import anova, hypothesis

from . import fixtures


def test_tail_probabilities_match_published_tables():
    assert distributions.student_two_sided([2.228139], [10.0])[0] == pytest.approx(0.05, abs=1e-6)
    assert distributions.f_upper([4.964603], [1.0], [10.0])[0] == pytest.approx(0.05, abs=1e-6)
    assert distributions.f_upper([2.866081], [4.0], [20.0])[0] == pytest.approx(0.05, abs=1e-6)
    assert distributions.gamma_tail(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    assert distributions.gamma_tail(5.0, 18.307038 / 2) == pytest.approx(0.05, abs=1e-6)
    assert distributions.studentized_range_critical(0.05, 3, 10) == pytest.approx(3.877, abs=2e-3)
    assert distributions.studentized_range_critical(0.05, 4, 20) == pytest.approx(3.958, abs=2e-3)
    assert distributions.studentized_range_critical(0.01, 5, 60) == pytest.approx(4.82, abs=5e-3)


def test_shapiro_on_a_published_sample(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = anova.shapiro_wilk(spark.createDataFrame([(float(w),) for w in weights], "y double"), "y").first()
    assert row["statistic"] == pytest.approx(0.79, abs=2e-3)
    assert row["p_value"] == pytest.approx(0.0067, abs=3e-4)


@pytest.mark.parametrize("n", [3, 5, 40, 6000])
def test_shapiro_ranks_equal_sorted_values(spark, monkeypatch, n):
    """Rows in one place, sorted; half of the values are one and the same, ranks come in small pieces."""
    rng = np.random.default_rng(n)
    y = np.sort(np.round(np.where(np.arange(n) % 2, rng.normal(size=n), 0.5), 3))
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    a, u = m / np.sqrt(m @ m), 1 / np.sqrt(n)
    last = a[-1] + np.polyval((-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0), u)
    second = a[-2] + np.polyval((-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0), u)
    if n == 3:
        a = np.array([-1, 0, 1]) * np.sqrt(0.5)
    elif n <= 5:
        a = np.r_[-last, m[1:-1] / np.sqrt((m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2)), last]
    else:
        scale = np.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a = np.r_[-last, -second, m[2:-2] / scale, second, last]
    monkeypatch.setattr(anova, "RANKS_AT_ONCE", 700)
    row = anova.shapiro_wilk(spark.createDataFrame([(float(v),) for v in y], "y double"), "y").first()
    assert row["samples"] == n and row["extrapolated"] == (n > 5000) and 0 <= row["p_value"] <= 1
    assert row["statistic"] == pytest.approx((a @ y) ** 2 / ((y - y.mean()) ** 2).sum(), rel=1e-9)


def test_shapiro_without_a_spread(spark):
    frame = spark.createDataFrame([(1.0,)] * 4, "y double")
    assert tuple(anova.shapiro_wilk(frame, "y").first()) == (4, 1.0, 1.0, False)
    assert anova.shapiro_wilk(frame.limit(2), "y").count() == 0


def test_one_way_and_tukey(spark):
    result = registry.run(fixtures.one_factor(spark), "one_way_anova", key=[], target="score", factors=["treatment"])
    metrics = {r["metric"]: r["value"] for r in result.metrics.collect()}
    assert metrics["model_p_value"] < 0.001 and metrics["r2"] > 0.4
    pairs = result.tables["tukey"].collect()
    assert len(pairs) == 6 and all(p["reject"] and p["lower"] <= p["mean_difference"] <= p["upper"] for p in pairs)


def least_squares(frame, kind):
    """Sums of squares from row-level designs and ordinary least squares."""
    y = frame["score"].to_numpy()

    def dummies(c):
        levels = sorted(frame[c].unique())
        return np.stack([(frame[c] == v).to_numpy(float) for v in levels[1:]], axis=1)

    a, b = dummies("treatment"), dummies("region")
    ab = (a[:, :, None] * b[:, None, :]).reshape(len(y), -1)
    one = np.ones((len(y), 1))
    blocks = {"a": a, "b": b, "ab": ab}

    def rss(names, intercept=True):
        x = np.hstack([one] * intercept + [blocks[n] for n in names])
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()

    full = rss(["a", "b", "ab"])
    if kind == "1":
        terms = [rss([]) - rss(["a"]), rss(["a"]) - rss(["a", "b"]), rss(["a", "b"]) - full]
    elif kind == "2":
        terms = [rss(["b"]) - rss(["a", "b"]), rss(["a"]) - rss(["a", "b"]), rss(["a", "b"]) - full]
    else:
        terms = [rss(["a", "b", "ab"], False) - full, rss(["b", "ab"]) - full, rss(["a", "ab"]) - full, rss(["a", "b"]) - full]
    return [*terms, full]


@pytest.mark.parametrize("kind", ["1", "2", "3"])
def test_factorial_sums_of_squares_equal_row_level_fits(spark, kind):
    frame = fixtures.two_factors(spark, unbalanced=True)
    table, fit = anova.factorial_anova(frame, "score", ["treatment", "region"], kind)
    rows = table.collect()
    assert [r["sum_sq"] for r in rows] == pytest.approx(least_squares(frame.toPandas(), kind), rel=1e-8)
    assert fit.first()["r2"] > 0.4
    assert any(":" in r["term"] for r in rows)


def test_role_errors(spark):
    frame = fixtures.two_factors(spark)
    with pytest.raises(ParameterError):
        registry.run(frame, "one_way_anova", key=[], target="treatment", factors=["region"])
    with pytest.raises(ParameterError):
        registry.run(frame, "factorial_anova", key=[], target="score", factors=["region"])
    with pytest.raises(TableError):
        hypothesis.independent_t(frame, "score", "treatment")
    with pytest.raises(TableError):
        registry.run(frame.limit(10), "one_way_anova", key=[], target="score", factors=["region"])


def test_hypothesis_runs(spark):
    frame = fixtures.two_factors(spark).withColumn("other", F.col("score") + F.rand(1)).withColumn("id", F.monotonically_increasing_id())
    chi = registry.run(frame, "chi_square_test", key=["id"], factors=["treatment", "region"])
    assert chi.tables["contingency"].count() == 6
    values = {r["metric"]: r["value"] for r in chi.metrics.collect()}
    assert values["p_value"] == pytest.approx(1.0) and values["degrees_of_freedom"] == 2
    paired = registry.run(frame, "paired_t_test", key=["id"], target="score", features=["other"])
    assert {r["metric"]: r["value"] for r in paired.metrics.collect()}["p_value"] < 1e-6


def test_fisher_identity_for_two_groups(spark):
    """With two groups the one-way F is the squared pooled t; Welch agrees for balanced groups."""
    frame = fixtures.two_factors(spark).filter("treatment <> 'c'")
    f = anova.f_oneway(frame, "score", "treatment").first()["f_statistic"]
    t = hypothesis.independent_t(frame, "score", "treatment").first()["statistic"]
    assert f == pytest.approx(t * t, rel=1e-9)


def test_levels_are_unordered(spark):
    """Swapping factors does not change type 2 results."""
    frame = fixtures.two_factors(spark, unbalanced=True)
    tables = []
    for order in itertools.permutations(["treatment", "region"]):
        rows = anova.factorial_anova(frame, "score", list(order), "2")[0].collect()
        tables.append({r["term"]: r["sum_sq"] for r in rows if ":" not in r["term"]})
    assert tables[0] == pytest.approx(tables[1], rel=1e-9)
