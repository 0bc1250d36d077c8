"""Evaluation metrics against rule-based or closed-form predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation
from ..operators.splitting import random_split
from .tables import table


def price_predictions(spark, sf):
    """Closed-form one-feature fit of the order price, as predictions for the metric queries."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    fit = orders.agg(
        F.regr_slope("o_totalprice", "o_custkey").alias("s"), F.regr_intercept("o_totalprice", "o_custkey").alias("i")
    ).first()
    return orders.select("o_orderkey", F.col("o_totalprice").alias("actual"), (F.lit(fit["i"]) + F.lit(fit["s"]) * F.col("o_custkey")).alias("predicted"))


def status_predictions(spark, sf):
    """Order status against a rule on the price."""
    price = F.col("o_totalprice")
    rule = F.when(price < 150000, "F").when(price < 350000, "O").otherwise("X")
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("actual"), rule.alias("predicted"))


_STATUS = """SELECT o_orderstatus AS a, CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 350000 THEN 'O' ELSE 'X' END AS p FROM orders"""


def classification_metrics(spark, sf):
    row = evaluation.classification_metrics(status_predictions(spark, sf))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(status_predictions(spark, sf))


def log_loss(spark, sf):
    share = F.col("o_totalprice") / 600000
    frame = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label_index"),
        F.array(share, (1 - share) * 0.7, (1 - share) * 0.3).alias("probability"),
    )
    return evaluation.log_loss(frame, "label_index", "probability").withColumn("log_loss", F.round("log_loss", 6))


def regression_metrics(spark, sf):
    row = evaluation.regression_metrics(price_predictions(spark, sf))
    return row.select(F.round("mae", 3).alias("mae"), F.round(F.col("mse") / 1e6, 4).alias("mse_millions"), F.round("rmse", 3).alias("rmse"), F.round("r2", 8).alias("r2"))


def residual_rows(spark, sf):
    rows = evaluation.residuals(price_predictions(spark, sf), ["o_orderkey"])
    return rows.select("o_orderkey", "actual", F.round("predicted", 4).alias("predicted"), F.round("residual", 4).alias("residual"))


def sample_counts(spark, sf):
    return evaluation.sample_counts(random_split(table(spark, sf, "orders"), ["o_orderkey"], 0.2, 42), "is_test")


QUERIES = {
    f.__name__: f
    for f in (classification_metrics, confusion_matrix, log_loss, regression_metrics, residual_rows, sample_counts)
}

ORACLES = {
    "classification_metrics": f"""WITH t AS ({_STATUS}), l AS (SELECT a AS v FROM t UNION SELECT p FROM t),
        m AS (SELECT v, (SELECT count(*) FROM t WHERE a = v) AS s, (SELECT count(*) FROM t WHERE p = v) AS c, (SELECT count(*) FROM t WHERE a = v AND p = v) AS h FROM l),
        r AS (SELECT *, CASE WHEN c > 0 THEN h::DOUBLE / c ELSE 0 END AS pr, CASE WHEN s > 0 THEN h::DOUBLE / s ELSE 0 END AS re FROM m)
        SELECT round(sum(h)::DOUBLE / sum(s), 6) AS accuracy, round(avg(re) FILTER (s > 0), 6) AS balanced_accuracy,
            round(sum(pr * s) / sum(s), 6) AS precision_weighted, round(sum(re * s) / sum(s), 6) AS recall_weighted,
            round(sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * s) / sum(s), 6) AS f1_weighted FROM r""",
    "confusion_matrix": f"""WITH t AS ({_STATUS}), l AS (SELECT a AS v FROM t UNION SELECT p FROM t)
        SELECT x.v AS actual, y.v AS predicted, (SELECT count(*) FROM t WHERE a = x.v AND p = y.v) AS count FROM l x, l y""",
    "log_loss": """SELECT round(-avg(ln(greatest(least(CASE o_orderstatus WHEN 'F' THEN s WHEN 'O' THEN (1 - s) * 0.7 ELSE (1 - s) * 0.3 END, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) AS log_loss
        FROM (SELECT o_orderstatus, o_totalprice / 600000 AS s FROM orders)""",
    "regression_metrics": """WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i FROM orders),
        e AS (SELECT o_totalprice AS a, o_totalprice - (i + s * o_custkey) AS r FROM orders, f)
        SELECT round(avg(abs(r)), 3) AS mae, round(avg(r * r) / 1e6, 4) AS mse_millions, round(sqrt(avg(r * r)), 3) AS rmse, round(1 - avg(r * r) / var_pop(a), 8) AS r2 FROM e""",
    "residual_rows": """WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i FROM orders)
        SELECT o_orderkey, o_totalprice AS actual, round(i + s * o_custkey, 4) AS predicted, round(o_totalprice - (i + s * o_custkey), 4) AS residual
        FROM orders, f ORDER BY o_orderkey LIMIT 500""",
    "sample_counts": "SELECT count(*) AS samples, count(*) - ceil(count(*) * 0.2)::BIGINT AS train_samples, ceil(count(*) * 0.2)::BIGINT AS test_samples FROM orders",
}
