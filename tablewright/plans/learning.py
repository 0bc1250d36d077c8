"""Supervised and reduction queries. Linear and neighbour models are checked by closed forms or
recursive SQL; tree ensembles report their metrics only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reduction, supervised
from .tables import table

SPLIT_SEED = 42


def signal(spark, sf):
    """Event rows with two features, a numeric target that depends on both, and class labels."""
    k = F.get_json_object("props", "$.k").cast("int")
    y = F.col("value") + F.col("user_id") * 0.3 - k * 0.2
    return table(spark, sf, "events").select(
        "event_id",
        F.col("value").alias("a"),
        F.col("user_id").cast("double").alias("u"),
        k.cast("double").alias("k"),
        # the value with a fractional part from the id, so that no two distances are equal
        (F.col("value") + F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0).alias("aj"),
        F.round(y, 6).alias("y"),
        F.when(y < 35, "low").when(y < 70, "mid").otherwise("top").alias("level"),
        F.when(y < 50, "low").otherwise("top").alias("half"),
        "event_type",
    )


SIGNAL = """e AS (SELECT event_id, value AS a, user_id::DOUBLE AS u, (props->>'$.k')::DOUBLE AS k,
        value + user_id * 0.3::DOUBLE - (props->>'$.k')::INT * 0.2::DOUBLE AS yy, event_type,
        value + ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS aj FROM events),
    w AS (SELECT event_id, a, u, k, aj, event_type, round(yy, 6) AS y, CASE WHEN yy < 35 THEN 'low' WHEN yy < 70 THEN 'mid' ELSE 'top' END AS level,
        CASE WHEN yy < 50 THEN 'low' ELSE 'top' END AS half FROM e)"""
RANDOM = SIGNAL + """, d AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || event_id)) <= (SELECT ceil(count(*) * 0.2) FROM w) AS is_test FROM w)"""


def _stratified(label: str) -> str:
    return SIGNAL + f""", c AS (SELECT {label} AS l, count(*) AS n FROM w GROUP BY 1),
    c1 AS (SELECT *, sum(n) OVER () - ceil(sum(n) OVER () * 0.2) AS train FROM c),
    c2 AS (SELECT *, n * train / sum(n) OVER () AS share FROM c1),
    c3 AS (SELECT *, floor(share) AS whole, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, l) AS place FROM c2),
    c4 AS (SELECT l, n - whole - CASE WHEN place <= train - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM c3),
    d AS (SELECT w.*, row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || event_id)) <= quota AS is_test FROM w JOIN c4 ON {label} = l)"""


def _scaled(x: str, z: str, base: str) -> str:
    """Both features standardised by the training rows."""
    return base + f""", m AS (SELECT avg({x}) AS mx, stddev_pop({x}) AS sx, avg({z}) AS mz, stddev_pop({z}) AS sz FROM d WHERE NOT is_test),
    s AS (SELECT d.*, ({x} - mx) / sx AS p, ({z} - mz) / sz AS q FROM d, m), t AS (SELECT * FROM s WHERE NOT is_test)"""


def _regression(algorithm, features, parameters=None, target="y", digits=4, rounds=None):
    def query(spark, sf):
        run = supervised.run_supervised(signal(spark, sf), algorithm, target, ["event_id"], features, parameters=parameters, seed=SPLIT_SEED, rounds=rounds)
        return run.predictions.select("event_id", "actual", F.round("predicted", digits).alias("predicted"))

    query.__name__ = algorithm
    return query


def _labels(algorithm, features, target, parameters=None, rounds=None):
    def query(spark, sf):
        run = supervised.run_supervised(signal(spark, sf), algorithm, target, ["event_id"], features, parameters=parameters, seed=SPLIT_SEED, rounds=rounds)
        return run.predictions.select("event_id", "actual", "predicted")

    query.__name__ = algorithm
    return query


def _metrics(algorithm, target, parameters=None, rounds=None):
    """Metric rows of the algorithms whose trees have no SQL counterpart."""

    def query(spark, sf):
        run = supervised.run_supervised(
            signal(spark, sf), algorithm, target, ["event_id"], ["a", "u", "k", "event_type"], parameters=parameters, seed=SPLIT_SEED, rounds=rounds
        )
        return run.metrics.select("metric", F.round("value", 6).alias("value"))

    query.__name__ = algorithm
    return query


_FEW_ROUNDS = {"n_estimators": 10, "max_depth": 4}


def logistic_probabilities(spark, sf):
    """Class probabilities of the binary logistic model on one feature."""
    run = supervised.run_supervised(signal(spark, sf), "logistic_regression", "half", ["event_id"], ["a"], seed=SPLIT_SEED)
    return run.predictions.select("event_id", "actual", "predicted", F.round(F.col("probability")[1], 3).alias("p_top"))


def feature_importance(spark, sf):
    run = supervised.run_supervised(signal(spark, sf), "linear_regression", "y", ["event_id"], ["u", "k"], seed=SPLIT_SEED)
    return run.tables["feature_importance"].select("feature", F.round("importance", 5).alias("importance"))


def supervised_metrics(spark, sf):
    run = supervised.run_supervised(signal(spark, sf), "linear_regression", "y", ["event_id"], ["a", "u"], seed=SPLIT_SEED)
    return run.metrics.select("metric", F.round("value", 4).alias("value"))


def saved_model_predictions(spark, sf):
    """Predictions after saving and loading the whole bundle."""
    from ..session import scratch_path

    run = supervised.run_supervised(signal(spark, sf), "linear_regression", "y", ["event_id"], ["a", "u"], seed=SPLIT_SEED)
    path = scratch_path(spark, "model")
    run.model.save(path, spark)
    again = supervised.FittedModel.load(path, spark)
    scored = again.predict(signal(spark, sf).select("event_id", "a", "u"))
    return scored.select("event_id", F.round("predicted", 4).alias("predicted"))


def _measures(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), (F.col("p_retailprice") / 50).alias("r"))


def pca(spark, sf):
    rows, _, _ = reduction.pca(_measures(spark, sf), "p_partkey", ["s", "r"])
    return rows.select(F.col("id").alias("p_partkey"), F.round("component1", 5).alias("component1"), F.round(F.abs("component2"), 5).alias("size2"))


def pca_explained(spark, sf):
    frame = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.col("l_extendedprice") / 1000, "l_discount").toDF("l_orderkey", "q", "p", "d")
    _, metrics, _ = reduction.pca(frame, "l_orderkey", ["q", "p", "d"])
    return spark.createDataFrame([(k, round(float(v), 5)) for k, v in metrics.items()], "metric string, value double")


def truncated_svd(spark, sf):
    rows, _, _ = reduction.truncated_svd(_measures(spark, sf), "p_partkey", ["s", "r"])
    return rows.select(F.col("id").alias("p_partkey"), F.round("component1", 5).alias("component1"))


def embedding_preview(spark, sf):
    rows, _, _ = reduction.pca(_measures(spark, sf), "p_partkey", ["s", "r"])
    return reduction.embedding_preview(rows).select("row_index", F.round("component1", 5).alias("component1"))


_REG_SQL = """SELECT event_id, y AS actual, round({p}, {d}) AS predicted FROM s, b WHERE is_test"""
_COV = """n1 AS (SELECT count(*)::DOUBLE AS n, corr(p, q) AS r, covar_pop(p, y) AS c1, covar_pop(q, y) AS c2, avg(y) AS my FROM t)"""
_TWO_UK = _scaled("u", "k", RANDOM)
_TWO_AU = _scaled("a", "u", RANDOM)


def _descent(absolute: float, squared: float) -> str:
    soft = "sign({v}) * greatest(abs({v}) - " + repr(absolute) + "::DOUBLE, 0) / (1 + " + repr(squared) + "::DOUBLE)"
    return f"""WITH RECURSIVE {_TWO_UK}, {_COV}, it AS (SELECT 0 AS i, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
        UNION ALL SELECT i + 1, x, {soft.format(v='(c2 - r * x)')} FROM (SELECT i, c2, r, {soft.format(v='(c1 - r * b2)')} AS x FROM it, n1) WHERE i < 200),
        b AS (SELECT b1, b2, my FROM it, n1 WHERE i = 200) """ + _REG_SQL.format(p="my + b1 * p + b2 * q", d=3)


_OLS = f"""WITH {_TWO_AU}, {_COV}, b AS (SELECT (c1 - r * c2) / (1 - r * r) AS b1, (c2 - r * c1) / (1 - r * r) AS b2, my FROM n1) """
_NEAREST = """nb AS (SELECT x.event_id, z.event_id AS o, row_number() OVER (PARTITION BY x.event_id ORDER BY sqrt((x.p - z.p) * (x.p - z.p) + (x.q - z.q) * (x.q - z.q)), z.event_id) AS place
    FROM s x, t z WHERE x.is_test QUALIFY place <= 5)"""


def _class_scores(shared: bool) -> str:
    """Two-feature discriminant scores with pooled or shrunk per-class covariance."""
    head = f"WITH {_scaled('a', 'u', _stratified('level'))}, g AS (SELECT level AS cls, count(*)::DOUBLE AS n, avg(p) AS mp, avg(q) AS mq, "
    if shared:
        tail = """var_pop(p) * count(*) AS vp, var_pop(q) * count(*) AS vq, covar_pop(p, q) * count(*) AS vpq FROM t GROUP BY 1),
        v AS (SELECT sum(n) AS nn, sum(vp) / (sum(n) - count(*)) AS xa, sum(vq) / (sum(n) - count(*)) AS xd, sum(vpq) / (sum(n) - count(*)) AS xb FROM g),
        h AS (SELECT cls, n, mp, mq, xa, xb, xd, 0.0::DOUBLE AS pen, nn FROM g, v)"""
    else:
        tail = """0.95::DOUBLE * var_samp(p) + 0.05::DOUBLE AS xa, 0.95::DOUBLE * covar_samp(p, q) AS xb, 0.95::DOUBLE * var_samp(q) + 0.05::DOUBLE AS xd FROM t GROUP BY 1),
        h AS (SELECT cls, n, mp, mq, xa, xb, xd, -0.5 * ln(xa * xd - xb * xb) AS pen, (SELECT sum(n) FROM g) AS nn FROM g)"""
    return head + tail + """
        SELECT event_id, level AS actual, arg_max(cls, ln(n / nn) + pen - 0.5 * (xd * (p - mp) ** 2 - 2 * xb * (p - mp) * (q - mq) + xa * (q - mq) ** 2) / (xa * xd - xb * xb)) AS predicted
        FROM s, h WHERE is_test GROUP BY 1, 2"""


def _stump(spark, sf):
    run = supervised.run_supervised(signal(spark, sf), "decision_tree_regressor", "y", ["event_id"], ["k"], parameters={"max_depth": 1}, seed=SPLIT_SEED)
    return run.predictions.select("event_id", "actual", F.round("predicted", 4).alias("predicted"))


def _class_stump(spark, sf):
    run = supervised.run_supervised(signal(spark, sf), "decision_tree_classifier", "half", ["event_id"], ["k"], parameters={"max_depth": 1}, seed=SPLIT_SEED)
    return run.predictions.select("event_id", "actual", "predicted", F.round(F.col("probability")[1], 5).alias("p_top"))


def poisson_regressor(spark, sf):
    frame = signal(spark, sf).withColumn("count", F.floor(F.col("u") / 10).cast("double"))
    run = supervised.run_supervised(frame, "poisson_regressor", "count", ["event_id"], ["y"], parameters={"alpha": 0.5}, seed=SPLIT_SEED)
    return run.predictions.select("event_id", "actual", F.round("predicted", 3).alias("predicted"))


QUERIES = {
    "linear_regression": _regression("linear_regression", ["a", "u"]),
    "ridge_regression": _regression("ridge_regression", ["u", "k"], {"alpha": 50.0}),
    "lasso_regressor": _regression("lasso_regressor", ["u", "k"], {"alpha": 0.5}, digits=3),
    "elastic_net_regressor": _regression("elastic_net_regressor", ["u", "k"], {"alpha": 0.8, "l1_ratio": 0.5}, digits=3),
    "poisson_regressor": poisson_regressor,
    "knn_regressor": _regression("knn_regressor", ["aj", "u"]),
    "knn_classifier": _labels("knn_classifier", ["aj", "u"], "level"),
    "naive_bayes_classifier": _labels("naive_bayes_classifier", ["a", "u"], "level"),
    "linear_discriminant_classifier": _labels("linear_discriminant_classifier", ["a", "u"], "level"),
    "quadratic_discriminant_classifier": _labels("quadratic_discriminant_classifier", ["a", "u"], "level"),
    "logistic_regression": logistic_probabilities,
    "decision_tree_regressor": _stump,
    "decision_tree_classifier": _class_stump,
    "feature_importance": feature_importance,
    "supervised_metrics": supervised_metrics,
    "saved_model_predictions": saved_model_predictions,
    "pca": pca,
    "pca_explained": pca_explained,
    "truncated_svd": truncated_svd,
    "embedding_preview": embedding_preview,
    "huber_regressor": _metrics("huber_regressor", "y"),
    "quantile_regressor": _metrics("quantile_regressor", "y", {"quantile": 0.5, "alpha": 0.01}),
    "random_forest_regressor": _metrics("random_forest_regressor", "y"),
    "extra_trees_regressor": _metrics("extra_trees_regressor", "y"),
    "bagging_regressor": _metrics("bagging_regressor", "y"),
    "gradient_boosting_regressor": _metrics("gradient_boosting_regressor", "y", rounds=10),
    "hist_gradient_boosting_regressor": _metrics("hist_gradient_boosting_regressor", "y", rounds=10),
    "xgboost_regressor": _metrics("xgboost_regressor", "y", _FEW_ROUNDS),
    "lightgbm_regressor": _metrics("lightgbm_regressor", "y", rounds=10),
    "svm_regressor": _metrics("svm_regressor", "y"),
    "random_forest_classifier": _metrics("random_forest_classifier", "level"),
    "extra_trees_classifier": _metrics("extra_trees_classifier", "level"),
    "gradient_boosting_classifier": _metrics("gradient_boosting_classifier", "half"),
    "hist_gradient_boosting_classifier": _metrics("hist_gradient_boosting_classifier", "half"),
    "xgboost_classifier": _metrics("xgboost_classifier", "level"),
    "svm_classifier": _metrics("svm_classifier", "half"),
}

_AXIS = """m AS (SELECT avg(s) AS ms, avg(r) AS mr, 0.5 * atan2(2 * covar_pop(s, r), var_pop(s) - var_pop(r)) AS th FROM p),
    x AS (SELECT ms, mr, CASE WHEN abs(cos(th)) >= abs(sin(th)) THEN sign(cos(th)) ELSE sign(sin(th)) END AS f, th FROM m)"""
_PARTS = "p AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice / 50 AS r FROM part)"

ORACLES = {
    "linear_regression": _OLS + _REG_SQL.format(p="my + b1 * p + b2 * q", d=4),
    "ridge_regression": f"""WITH {_TWO_UK}, {_COV}, b AS (SELECT ((n + 50) * n * c1 - n * r * n * c2) / ((n + 50) ** 2 - (n * r) ** 2) AS b1,
        ((n + 50) * n * c2 - n * r * n * c1) / ((n + 50) ** 2 - (n * r) ** 2) AS b2, my FROM n1) """ + _REG_SQL.format(p="my + b1 * p + b2 * q", d=4),
    "lasso_regressor": _descent(0.5, 0.0),
    "elastic_net_regressor": _descent(0.4, 0.4),
    "poisson_regressor": f"""WITH RECURSIVE {RANDOM}, m AS (SELECT avg(y) AS my, stddev_pop(y) AS sy, avg(floor(u / 10)) AS mc FROM d WHERE NOT is_test),
        s AS (SELECT event_id, is_test, floor(u / 10) AS c, (y - my) / sy AS p FROM d, m), t AS MATERIALIZED (SELECT c, p FROM s WHERE NOT is_test),
        it AS (SELECT 0 AS i, ln(mc) AS b0, 0.0::DOUBLE AS b1 FROM m
          UNION ALL SELECT i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
          FROM (SELECT i, b0, b1, avg(c - mu) AS g0, avg((c - mu) * p) - 0.5 * b1 AS g1, avg(mu) AS h00, avg(mu * p) AS h01, avg(mu * p * p) + 0.5 AS h11
                FROM (SELECT i, b0, b1, c, p, exp(b0 + b1 * p) AS mu FROM it, t) GROUP BY i, b0, b1) WHERE i < 30)
        SELECT event_id, c AS actual, round(exp(b0 + b1 * p), 3) AS predicted FROM s, it WHERE is_test AND i = 30""",
    "knn_regressor": f"""WITH {_scaled('aj', 'u', RANDOM)}, {_NEAREST} SELECT s.event_id, s.y AS actual, round(avg(t.y), 4) AS predicted
        FROM s JOIN nb ON s.event_id = nb.event_id JOIN t ON t.event_id = o GROUP BY 1, 2""",
    "knn_classifier": f"""WITH {_scaled('aj', 'u', _stratified('level'))}, {_NEAREST},
        v AS (SELECT nb.event_id, t.level AS l, count(*) AS n FROM nb JOIN t ON t.event_id = o GROUP BY 1, 2)
        SELECT s.event_id, s.level AS actual, v.l AS predicted FROM s JOIN v ON s.event_id = v.event_id
        QUALIFY row_number() OVER (PARTITION BY s.event_id ORDER BY v.n DESC, v.l) = 1""",
    "naive_bayes_classifier": f"""WITH {_scaled('a', 'u', _stratified('level'))},
        g AS (SELECT level AS cls, count(*)::DOUBLE AS n, avg(p) AS mp, avg(q) AS mq, var_pop(p) AS vp, var_pop(q) AS vq FROM t GROUP BY 1)
        SELECT event_id, level AS actual, arg_max(cls, ln(n) - 0.5 * ln(vp * vq) - 0.5 * ((p - mp) ** 2 / vp + (q - mq) ** 2 / vq)) AS predicted
        FROM s, g WHERE is_test GROUP BY 1, 2""",
    "linear_discriminant_classifier": _class_scores(True),
    "quadratic_discriminant_classifier": _class_scores(False),
    "logistic_regression": f"""WITH RECURSIVE {_stratified('half')}, m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, count(*)::DOUBLE AS n FROM d WHERE NOT is_test),
        s AS (SELECT event_id, is_test, half, (a - ma) / sa AS p FROM d, m), t AS MATERIALIZED (SELECT (half = 'top')::INT AS c, p FROM s WHERE NOT is_test),
        it AS (SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1
          UNION ALL SELECT i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
          FROM (SELECT i, b0, b1, sum(c - mu) AS g0, sum((c - mu) * p) - b1 AS g1, sum(mu * (1 - mu)) AS h00, sum(mu * (1 - mu) * p) AS h01, sum(mu * (1 - mu) * p * p) + 1 AS h11
                FROM (SELECT i, b0, b1, c, p, 1 / (1 + exp(-(b0 + b1 * p))) AS mu FROM it, t) GROUP BY i, b0, b1) WHERE i < 25)
        SELECT event_id, half AS actual, CASE WHEN b0 + b1 * p > 0 THEN 'top' ELSE 'low' END AS predicted, round(1 / (1 + exp(-(b0 + b1 * p))), 3) AS p_top
        FROM s, it WHERE is_test AND i = 25""",
    "decision_tree_regressor": f"""WITH {RANDOM}, t AS (SELECT k, y FROM d WHERE NOT is_test),
        c AS (SELECT k AS cut, (SELECT avg(y) FROM t WHERE t.k <= x.k) AS l, (SELECT avg(y) FROM t WHERE t.k > x.k) AS r,
              (SELECT sum(y) ** 2 / count(*) FROM t WHERE t.k <= x.k) + (SELECT sum(y) ** 2 / count(*) FROM t WHERE t.k > x.k) AS gain FROM (SELECT DISTINCT k FROM t) x),
        b AS (SELECT * FROM c WHERE gain IS NOT NULL ORDER BY gain DESC, cut LIMIT 1)
        SELECT event_id, y AS actual, round(CASE WHEN k <= cut THEN l ELSE r END, 4) AS predicted FROM d, b WHERE is_test""",
    "decision_tree_classifier": f"""WITH {_stratified('half')}, t AS (SELECT k, (half = 'top')::INT AS c FROM d WHERE NOT is_test),
        v AS (SELECT k, sum(count(*)) OVER o AS nl, sum(sum(c)) OVER o AS tl FROM t GROUP BY k WINDOW o AS (ORDER BY k)),
        g AS (SELECT k AS cut, tl::DOUBLE / nl AS l, (tt - tl)::DOUBLE / (n - nl) AS r, nl * (l * l + (1 - l) ** 2) + (n - nl) * (r * r + (1 - r) ** 2) AS gain
              FROM v, (SELECT count(*) AS n, sum(c) AS tt FROM t) WHERE nl < n),
        b AS (SELECT * FROM g ORDER BY gain DESC, cut LIMIT 1),
        x AS (SELECT event_id, half, CASE WHEN k <= cut THEN l ELSE r END AS z FROM d, b WHERE is_test)
        SELECT event_id, half AS actual, CASE WHEN z > 0.5 THEN 'top' ELSE 'low' END AS predicted, round(z, 5) AS p_top FROM x""",
    "feature_importance": f"""WITH {_TWO_UK}, {_COV} SELECT 'u' AS feature, round(abs((c1 - r * c2) / (1 - r * r)), 5) AS importance FROM n1
        UNION ALL SELECT 'k', round(abs((c2 - r * c1) / (1 - r * r)), 5) FROM n1""",
    "supervised_metrics": _OLS + """, f AS (SELECT y AS ac, my + b1 * p + b2 * q AS pr FROM s, b WHERE is_test),
        er AS (SELECT avg(abs(ac - pr)) AS mae, avg((ac - pr) ** 2) AS mse, 1 - avg((ac - pr) ** 2) / var_pop(ac) AS r2 FROM f)
        SELECT 'mae' AS metric, round(mae, 4) AS value FROM er UNION ALL SELECT 'mse', round(mse, 4) FROM er UNION ALL SELECT 'rmse', round(sqrt(mse), 4) FROM er
        UNION ALL SELECT 'r2', round(r2, 4) FROM er UNION ALL SELECT 'samples', count(*)::DOUBLE FROM d
        UNION ALL SELECT 'train_samples', count(*)::DOUBLE FROM t UNION ALL SELECT 'test_samples', count(*)::DOUBLE FROM f""",
    "saved_model_predictions": _OLS + "SELECT event_id, round(my + b1 * p + b2 * q, 4) AS predicted FROM s, b",
    "pca": f"WITH {_PARTS}, {_AXIS} SELECT p_partkey, round(f * ((s - ms) * cos(th) + (r - mr) * sin(th)), 5) AS component1, round(abs((s - ms) * sin(th) - (r - mr) * cos(th)), 5) AS size2 FROM p, x",
    # smallest eigenvalue of the 3 x 3 covariance in closed form
    "pca_explained": """WITH t AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount AS z FROM lineitem),
        c AS (SELECT count(*)::DOUBLE AS n, var_samp(x) AS a, var_samp(y) AS b, var_samp(z) AS c, covar_samp(x, y) AS d, covar_samp(x, z) AS e, covar_samp(y, z) AS f FROM t),
        q AS (SELECT *, (a + b + c) / 3 AS q FROM c),
        p AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
        r AS (SELECT *, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p ** 3) AS r FROM p),
        l AS (SELECT n, 1 - (q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3 + 2 * pi() / 3)) / (3 * q) AS v FROM r)
        SELECT 'explained_variance' AS metric, round(v, 5) AS value FROM l UNION ALL SELECT 'samples', n FROM l UNION ALL SELECT 'features', 3.0 FROM l""",
    "truncated_svd": f"""WITH {_PARTS}, m AS (SELECT 0.5 * atan2(2 * avg(s * r), avg(s * s) - avg(r * r)) AS th FROM p)
        SELECT p_partkey, round((s * cos(th) + r * sin(th)) * CASE WHEN abs(cos(th)) >= abs(sin(th)) THEN sign(cos(th)) ELSE sign(sin(th)) END, 5) AS component1 FROM p, m""",
    "embedding_preview": f"WITH {_PARTS}, {_AXIS} SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_index, round(f * ((s - ms) * cos(th) + (r - mr) * sin(th)), 5) AS component1 FROM p, x ORDER BY p_partkey LIMIT 2000",
}
