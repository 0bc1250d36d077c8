"""Windowed sequence queries over events (series = user, time = ts, tie-break = event id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences
from ..operators.evaluation import classification_metrics, regression_metrics
from ..session import use_utc
from .tables import table


def _data(spark, sf, classification=False, window=12, horizon=1):
    use_utc(spark)
    frame = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return sequences.sequence_data(
        frame, "event_type" if classification else "value", "ts", "user_id", ["value", "k"], ["event_id"], window, horizon, 0.2, classification
    )


def sliding_windows(spark, sf):
    """Complete windows with their ends and sum, side of the split and target."""
    data = _data(spark, sf)
    v = F.transform("window_values", lambda w: w["f0"])
    return data.windows.select(
        "series", "event_id", "is_train", F.round("label", 4).alias("target"), F.round(v[0], 5).alias("oldest"), F.round(v[11], 5).alias("newest"),
        F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total"),
    )


def sliding_windows_ahead(spark, sf):
    """Horizon of three: the predicted row lies three rows behind the window."""
    data = _data(spark, sf, window=4, horizon=3)
    v = F.transform("window_values", lambda w: w["f1"])
    return data.windows.select("series", "event_id", F.round(v[0], 5).alias("oldest"), F.round(v[3], 5).alias("newest"))


def window_counts(spark, sf):
    return _data(spark, sf).windows.groupBy("is_train").agg(F.count("*").alias("windows"))


def last_value_regression(spark, sf):
    """Metrics of predicting the last value of the window (back on the original scale)."""
    data = _data(spark, sf)
    scale = data.scaling[0]
    last = F.col("window_values")[11]["f0"] * F.lit(scale.scale) + F.lit(scale.mean)
    row = regression_metrics(data.windows.filter(~F.col("is_train")).select(F.col("label").alias("actual"), last.alias("predicted")))
    return row.select(*[F.round(c, 4).alias(c) for c in ("mae", "mse", "r2")])


def last_class_prediction(spark, sf):
    """Metrics of a rule on the newest value of the window as class prediction."""
    data = _data(spark, sf, classification=True)
    newest = F.col("window_values")[11]["f1"]
    rule = F.when(newest < -0.5, "click").when(newest < 0.5, "error").otherwise("view")
    row = classification_metrics(data.windows.filter(~F.col("is_train")).select(F.col("target").alias("actual"), rule.alias("predicted")))
    return row.select(F.round("accuracy", 5).alias("accuracy"), F.round("f1_weighted", 5).alias("f1_weighted"))


def _run(algorithm, target):
    def query(spark, sf):
        use_utc(spark)
        frame = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
        run = sequences.run_sequence(frame, algorithm, target, "ts", "user_id", ["value", "k"], ["event_id"], {"window_size": 12, "horizon": 1, "epochs": 10, "hidden_size": 8})
        return run.metrics.select("metric", F.round("value", 6).alias("value"))

    return query


def prediction_preview(spark, sf):
    use_utc(spark)
    frame = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return sequences.run_sequence(frame, "rnn_regressor", "value", "ts", "user_id", ["value"], ["event_id"]).tables["prediction_preview"]


def loss_history(spark, sf):
    use_utc(spark)
    frame = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return sequences.run_sequence(frame, "rnn_regressor", "value", "ts", "user_id", ["value"], ["event_id"]).tables["loss_history"]


QUERIES = {f.__name__: f for f in (sliding_windows, sliding_windows_ahead, window_counts, last_value_regression, last_class_prediction)}
QUERIES |= {a: _run(a, "value") for a in sequences.SEQUENCE_REGRESSORS}
QUERIES |= {a: _run(a, "event_type") for a in sequences.SEQUENCE_CLASSIFIERS}
QUERIES |= {"prediction_preview": prediction_preview, "loss_history": loss_history}

_BASE = """c AS (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.8) AS cut FROM events),
    e AS (SELECT event_id, user_id::VARCHAR AS series, ts, event_type, value, (props->>'$.k')::DOUBLE AS k, epoch_us(ts) <= cut AS is_train FROM events, c),
    m AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM e WHERE is_train),
    s AS (SELECT e.*, (value - mv) / sv AS v, (k - mk) / sk AS z FROM e, m)"""
_W12 = _BASE + """, w AS (SELECT *, row_number() OVER o AS i, lag(v, 12) OVER o AS oldest, lag(v, 1) OVER o AS newest, lag(z, 1) OVER o AS newest_k, lag(value, 1) OVER o AS last,
        sum(v) OVER (PARTITION BY series ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS total FROM s WINDOW o AS (PARTITION BY series ORDER BY ts, event_id)),
    x AS (SELECT * FROM w WHERE i > 12)"""

ORACLES = {
    "sliding_windows": f"WITH {_W12} SELECT series, event_id, is_train, round(value, 4) AS target, round(oldest, 5) AS oldest, round(newest, 5) AS newest, round(total, 4) AS total FROM x",
    "sliding_windows_ahead": f"""WITH {_BASE}, w AS (SELECT series, event_id, lag(z, 6) OVER o AS a, lag(z, 3) OVER o AS b, row_number() OVER o AS i FROM s WINDOW o AS (PARTITION BY series ORDER BY ts, event_id))
        SELECT series, event_id, round(a, 5) AS oldest, round(b, 5) AS newest FROM w WHERE i > 6""",
    "window_counts": f"WITH {_W12} SELECT is_train, count(*) AS windows FROM x GROUP BY 1",
    "last_value_regression": f"WITH {_W12} SELECT round(avg(abs(value - last)), 4) AS mae, round(avg((value - last) ** 2), 4) AS mse, round(1 - avg((value - last) ** 2) / var_pop(value), 4) AS r2 FROM x WHERE NOT is_train",
    "last_class_prediction": f"""WITH {_W12}, t AS (SELECT event_type AS a, CASE WHEN newest_k < -0.5 THEN 'click' WHEN newest_k < 0.5 THEN 'error' ELSE 'view' END AS p FROM x WHERE NOT is_train),
        l AS (SELECT a AS v FROM t UNION SELECT p FROM t),
        q AS (SELECT (SELECT count(*) FROM t WHERE a = v) AS s, (SELECT count(*) FROM t WHERE p = v) AS c, (SELECT count(*) FROM t WHERE a = v AND p = v) AS h FROM l)
        SELECT round(sum(h)::DOUBLE / sum(s), 5) AS accuracy, round(sum(CASE WHEN h > 0 THEN 2.0::DOUBLE * h / (c + s) ELSE 0 END * s) / sum(s), 5) AS f1_weighted FROM q""",
}
