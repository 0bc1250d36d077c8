"""Frames built from formulas: separable classes, a linear target, blobs, factor cells and series."""

from __future__ import annotations

import datetime

import numpy as np

SEED = 20260819


def classification(spark):
    rng, rows = np.random.default_rng(SEED), []
    for c, (x0, y0) in enumerate(((-3, -1.5), (0.5, 3), (3.5, -1))):
        for _ in range(80):
            x, y = float(rng.normal(x0, 0.75)), float(rng.normal(y0, 0.85))
            rows.append((len(rows), x, y, x + y, ("web", "store", "phone")[c], f"class_{c}"))
    return spark.createDataFrame(rows, "id long, feature_x double, feature_y double, feature_sum double, channel string, target_class string")


def regression(spark):
    rng, rows = np.random.default_rng(SEED), []
    for i in range(320):
        x, y, r = float(rng.uniform(-5, 5)), float(rng.uniform(-5, 5)), i % 3
        rows.append((i, x, y, ("north", "south", "west")[r], 3.2 * x - 1.7 * y + (4, -1.5, 2)[r] + float(rng.normal(0, 0.8))))
    return spark.createDataFrame(rows, "id long, feature_x double, feature_y double, region string, target_value double")


def blobs(spark):
    rng, rows = np.random.default_rng(SEED), []
    for c, centre in enumerate(((-5, -4), (0, 5), (5, -2))):
        for _ in range(120):
            x, y = rng.normal(centre, 0.6)
            rows.append((len(rows), float(x), float(y), float(np.hypot(x, y)), c))
    return spark.createDataFrame(rows, "id long, feature_x double, feature_y double, radius double, expected int")


def one_factor(spark):
    rng = np.random.default_rng(SEED)
    rows = [(g, float(rng.normal(m, 1.1))) for g, m in zip("abcd", (10, 12.5, 15, 18)) for _ in range(30)]
    return spark.createDataFrame(rows, "treatment string, score double")


def two_factors(spark, unbalanced=False):
    rng, rows = np.random.default_rng(SEED), []
    for i, t in enumerate("abc"):
        for j, r in enumerate(("east", "west")):
            for k in range(40 - (7 * i + 5 * j if unbalanced else 0)):
                value = 20 + 3 * i + 2.5 * j + (3.5 if (i, j) == (2, 1) else 0) + rng.normal(0, 1.4)
                rows.append((t, r, k, float(value)))
    return spark.createDataFrame(rows, "treatment string, region string, replicate int, score double")


def series(spark):
    rng, rows = np.random.default_rng(SEED), []
    for s in ("a", "b"):
        before = None
        for i in range(240):
            signal, temperature = float(np.sin(i / 6) + rng.normal(0, 0.05)), float(20 + 5 * np.cos(i / 24))
            y = 2.2 * signal + 0.08 * temperature + float(rng.normal(0, 0.1))
            at = datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=i)
            rows.append((at.isoformat(), s, signal, temperature, y, "up" if before is not None and y > before else "down"))
            before = y
    return spark.createDataFrame(rows, "timestamp string, series_id string, signal double, temperature double, target_value double, target_class string")
