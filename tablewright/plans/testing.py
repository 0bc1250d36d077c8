"""Hypothesis tests and variance analysis; p-values are checked by numeric integration in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anova, hypothesis
from .tables import table


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def one_sample_t_test(spark, sf):
    return _rounded(hypothesis.one_sample_t(table(spark, sf, "events"), "value", 50.0))


def independent_t_test(spark, sf):
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "gain").otherwise("other")
    return _rounded(hypothesis.independent_t(table(spark, sf, "events").withColumn("kind", kind), "value", "kind"))


def paired_t_test(spark, sf):
    return _rounded(hypothesis.paired_t(table(spark, sf, "part").withColumn("half", F.col("p_retailprice") / 40), "p_size", "half"))


def paired_t_test_by_key(spark, sf):
    kind = F.when(F.col("event_type").isin("error", "view"), "idle").otherwise("work")
    return _rounded(hypothesis.paired_t_by_key(table(spark, sf, "events").withColumn("kind", kind), "user_id", "kind", "value"))


def chi_square_test(spark, sf):
    return _rounded(hypothesis.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


def chi_square_two_by_two(spark, sf):
    return _rounded(hypothesis.chi_square(table(spark, sf, "labels"), "quality", "toxic"))


def test_summary(spark, sf):
    return _rounded(hypothesis.test_summary(table(spark, sf, "events"), "value", "purchase, signup"))


def one_way_anova(spark, sf):
    return _rounded(anova.one_way_anova(table(spark, sf, "events"), "value", "event_type"), 5)


def one_way_fit(spark, sf):
    return _rounded(anova.one_way_fit(table(spark, sf, "events"), "value", "event_type"))


def f_oneway(spark, sf):
    return _rounded(anova.f_oneway(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"))


def factorial_anova_type_2(spark, sf):
    return _rounded(anova.factorial_anova(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"], "2")[0], 4)


def factorial_anova_type_1(spark, sf):
    return _rounded(anova.factorial_anova(table(spark, sf, "lineitem"), "l_quantity", ["l_linestatus", "l_returnflag"], "1", False)[0], 4)


def factorial_anova_three_factors(spark, sf):
    frame = table(spark, sf, "orders").withColumn("quarter", F.quarter("o_orderdate"))
    return _rounded(anova.factorial_anova(frame, "o_totalprice", ["o_orderstatus", "o_orderpriority", "quarter"], "2")[0], 2)


def factorial_anova_type_3(spark, sf):
    return _rounded(anova.factorial_anova(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"], "3")[0], 4)


def factorial_fit(spark, sf):
    return _rounded(anova.factorial_anova(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"], "2")[1])


def levene_test(spark, sf):
    return _rounded(anova.levene(table(spark, sf, "events"), "value", ["event_type"]))


def levene_two_factors(spark, sf):
    return _rounded(anova.levene(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]))


def tukey_pairs(spark, sf):
    pairs = anova.tukey_hsd(table(spark, sf, "events"), "value", "event_type")
    return _rounded(pairs.select("group_a", "group_b", "mean_difference", "q"))


def tukey_report(spark, sf):
    return _rounded(anova.tukey_hsd(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag"), 4)


def shapiro_wilk(spark, sf):
    """Normality of part prices."""
    return _rounded(anova.shapiro_wilk(table(spark, sf, "part"), "p_retailprice"))


def jarque_bera(spark, sf):
    return _rounded(anova.jarque_bera(table(spark, sf, "events"), "value"), 4)


def anova_assumptions(spark, sf):
    return _rounded(anova.anova_assumptions(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"]))


QUERIES = {
    f.__name__: f
    for f in (
        one_sample_t_test, independent_t_test, paired_t_test, paired_t_test_by_key, chi_square_test,
        chi_square_two_by_two, test_summary, one_way_anova, one_way_fit, f_oneway, factorial_anova_type_2,
        factorial_anova_type_1, factorial_anova_three_factors, factorial_anova_type_3, factorial_fit, levene_test, levene_two_factors,
        tukey_pairs, tukey_report, shapiro_wilk, jarque_bera, anova_assumptions,
    )
}


def _t_tail(source: str) -> str:
    """Two-sided Student tail by Simpson's rule between -|t| and |t|; ``source`` has (t, df)."""
    return f"""(SELECT greatest(0, 1 - sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * (1 + x * x / df) ** (-(df + 1) / 2)) * 2 * least(abs(any_value(t)), 60) / 4000 / 3)
        FROM (SELECT i, df, t, -least(abs(t), 60) + i * 2 * least(abs(t), 60) / 4000 AS x FROM {source}, range(4001) r(i)))"""


def _f_tail(source: str) -> str:
    """Upper F tail by Simpson's rule over the angle; ``source`` has (f, d1, d2)."""
    return f"""(SELECT sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * 2 * exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2)
                  + (d2 - 1) * ln(greatest(cos(a), 1e-300)) + (d1 - 1) * ln(greatest(sin(a), 1e-300)))) * h / 3
        FROM (SELECT i, d1, d2, (pi() / 2 - z) / 20000 AS h, z + i * (pi() / 2 - z) / 20000 AS a
              FROM (SELECT d1, d2, atan(sqrt(d1 * f / d2)) AS z FROM {source}), range(20001) r(i)) GROUP BY h)"""


def _chi_tail(source: str) -> str:
    """Upper chi-square tail as one minus Simpson's rule over the square root; ``source`` has (x, k)."""
    return f"""(SELECT CASE WHEN any_value(k) <= 0 THEN 1 ELSE greatest(0, 1 - sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * 2 * CASE WHEN s = 0 AND k > 1 THEN 0 ELSE s ** (k - 1) END * exp(-s * s / 2) / (2 ** (k / 2) * exp(lgamma(k / 2)))) * any_value(sqrt(x)) / 4000 / 3) END
        FROM (SELECT i, x, k, i * sqrt(x) / 4000 AS s FROM {source}, range(4001) r(i)))"""


_TEST = """SELECT round(t, 6) AS statistic, round(df, 6) AS degrees_of_freedom, samples, round({tail}, 6) AS p_value FROM t"""
_GROUPS = """g AS (SELECT {g} AS g, count(*) AS n, avg({v}) AS m, var_pop({v}) * count(*) AS w FROM {t} GROUP BY 1),
    a AS (SELECT avg({v}) AS gm FROM {t}),
    s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * (m - gm) ** 2) AS ssb, sum(w) AS ssw FROM g, a),
    f AS (SELECT (ssb / (k - 1)) / (ssw / (n - k)) AS f, (k - 1)::DOUBLE AS d1, (n - k)::DOUBLE AS d2, * EXCLUDE (k, n), k, n::BIGINT AS n FROM s)"""
_EVENT_GROUPS = _GROUPS.format(g="event_type", v="value", t="events")
_QUANTITY_GROUPS = _GROUPS.format(g="l_returnflag", v="l_quantity", t="lineitem")


def _levene_sql(source: str, key: str, value: str) -> str:
    return f"""WITH z AS (SELECT {key} AS g, abs({value} - median({value}) OVER (PARTITION BY {key})) AS z FROM {source}),
        """ + _GROUPS.format(g="g", v="z", t="z") + f" SELECT k AS groups, round(f, 6) AS statistic, round({_f_tail('f')}, 6) AS p_value FROM f"


# Two factors of which one has two levels: its adjusted sum of squares is the squared within-group
# covariance over the within-group variance, so additive and full models have closed forms.
_TWO_FACTORS = """y AS (SELECT l_quantity AS y, l_returnflag AS a, (l_linestatus = 'O')::INT AS b FROM lineitem),
    tot AS (SELECT count(*)::DOUBLE AS n, avg(y) AS gm, var_pop(y) * count(*) AS sst FROM y),
    ga AS (SELECT count(*) AS n, avg(y) AS m, covar_pop(b, y) * count(*) AS c, var_pop(b) * count(*) AS v FROM y GROUP BY a),
    gb AS (SELECT count(*) AS n, avg(y) AS m FROM y GROUP BY b),
    gc AS (SELECT count(*) AS n, avg(y) AS m FROM y GROUP BY a, b),
    p AS (SELECT (SELECT sum(ga.n * (m - gm) ** 2) FROM ga, tot) AS a, (SELECT sum(gb.n * (m - gm) ** 2) FROM gb, tot) AS b,
          (SELECT sum(gc.n * (m - gm) ** 2) FROM gc, tot) AS c, (SELECT sum(c) ** 2 / sum(v) FROM ga) AS b_a,
          (SELECT count(*) FROM ga) AS la, (SELECT count(*) FROM gc) AS lc, n, sst FROM tot),
    q AS (SELECT *, a + b_a AS ab, a + b_a - b AS a_b FROM p)"""


def _effects_sql(terms: str, residual: str, residual_df: str) -> str:
    return f"""WITH {_TWO_FACTORS}, r AS (SELECT {residual} AS ss, ({residual_df})::DOUBLE AS df FROM q), e AS ({terms}),
        s AS (SELECT *, (SELECT sum(ss) FROM e) + (SELECT ss FROM r) AS total, (SELECT ss FROM r) AS rs, (ss / df) / (SELECT ss / df FROM r) AS f FROM e)
        SELECT term, df, round(ss, 4) AS sum_sq, round(f, 4) AS f,
            round(""" + _f_tail("(SELECT s.f AS f, s.df AS d1, r.df AS d2 FROM r)") + """, 4) AS p_value,
            round(ss / total, 4) AS eta_squared, round(ss / (ss + rs), 4) AS partial_eta_squared FROM s
        UNION ALL SELECT 'Residual', df, round(ss, 4), NULL, NULL, round(ss / (SELECT any_value(total) FROM s), 4), 0.5 FROM r"""


ORACLES = {
    "factorial_anova_type_2": _effects_sql(
        """SELECT 'C(l_returnflag)' AS term, (la - 1)::DOUBLE AS df, a_b AS ss FROM q
        UNION ALL SELECT 'C(l_linestatus)', 1.0, b_a FROM q
        UNION ALL SELECT 'C(l_returnflag):C(l_linestatus)', (la - 1)::DOUBLE, c - ab FROM q""",
        "sst - c",
        "n - lc",
    ),
    "factorial_anova_type_1": _effects_sql(
        """SELECT 'C(l_linestatus)' AS term, 1.0::DOUBLE AS df, b AS ss FROM q
        UNION ALL SELECT 'C(l_returnflag)', (la - 1)::DOUBLE, a_b FROM q""",
        "sst - ab",
        "n - la - 1",
    ),
    # treatment coding: dropping a term pools the cells at the other factor's first level only
    "factorial_anova_type_3": _effects_sql(
        """SELECT 'Intercept' AS term, 1.0::DOUBLE AS df, (SELECT count(*) * avg(y) ** 2 FROM y WHERE a = 'A' AND b = 0) AS ss FROM q
        UNION ALL SELECT 'C(l_returnflag)', (la - 1)::DOUBLE, (SELECT sum(n * (m - g) ** 2) FROM (SELECT count(*) AS n, avg(y) AS m FROM y WHERE b = 0 GROUP BY a), (SELECT avg(y) AS g FROM y WHERE b = 0)) FROM q
        UNION ALL SELECT 'C(l_linestatus)', 1.0, (SELECT sum(n * (m - g) ** 2) FROM (SELECT count(*) AS n, avg(y) AS m FROM y WHERE a = 'A' GROUP BY b), (SELECT avg(y) AS g FROM y WHERE a = 'A')) FROM q
        UNION ALL SELECT 'C(l_returnflag):C(l_linestatus)', (la - 1)::DOUBLE, c - ab FROM q""",
        "sst - c",
        "n - lc",
    ),
    "factorial_fit": f"""WITH {_TWO_FACTORS}, z AS (SELECT (c / (lc - 1)) / ((sst - c) / (n - lc)) AS f, (lc - 1)::DOUBLE AS d1, (n - lc)::DOUBLE AS d2 FROM q)
        SELECT n::BIGINT AS samples, round(c / sst, 6) AS r2, round(1 - (1 - c / sst) * (n - 1) / (n - lc), 6) AS adj_r2,
            round((SELECT f FROM z), 6) AS f_statistic, round({_f_tail('z')}, 6) AS model_p_value FROM q""",
    "one_sample_t_test": "WITH t AS (SELECT (avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))) AS t, count(*) - 1.0::DOUBLE AS df, count(*) AS samples FROM events) "
    + _TEST.format(tail=_t_tail("t")),
    "independent_t_test": """WITH m AS (SELECT avg(value) FILTER (event_type IN ('purchase', 'signup')) AS m1, avg(value) FILTER (event_type NOT IN ('purchase', 'signup')) AS m2,
            var_samp(value) FILTER (event_type IN ('purchase', 'signup')) / count(*) FILTER (event_type IN ('purchase', 'signup')) AS e1,
            var_samp(value) FILTER (event_type NOT IN ('purchase', 'signup')) / count(*) FILTER (event_type NOT IN ('purchase', 'signup')) AS e2,
            count(*) FILTER (event_type IN ('purchase', 'signup')) AS n1, count(*) FILTER (event_type NOT IN ('purchase', 'signup')) AS n2 FROM events),
        t AS (SELECT (m1 - m2) / sqrt(e1 + e2) AS t, (e1 + e2) ** 2 / (e1 ** 2 / (n1 - 1) + e2 ** 2 / (n2 - 1)) AS df, n1 + n2 AS samples FROM m) """
    + _TEST.format(tail=_t_tail("t")),
    "paired_t_test": """WITH d AS (SELECT p_size - p_retailprice / 40 AS d FROM part),
        t AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, count(*) - 1.0::DOUBLE AS df, count(*) AS samples FROM d) """
    + _TEST.format(tail=_t_tail("t")),
    "paired_t_test_by_key": """WITH p AS (SELECT user_id, avg(value) FILTER (event_type IN ('error', 'view')) - avg(value) FILTER (event_type NOT IN ('error', 'view')) AS d FROM events GROUP BY 1),
        t AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, count(d) - 1.0::DOUBLE AS df, count(d) AS samples FROM p) """
    + _TEST.format(tail=_t_tail("t")),
    "chi_square_test": """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2),
        r AS (SELECT a, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS k FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c),
        e AS (SELECT coalesce(o, 0) AS o, r * k / n AS e FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c USING (a, b)),
        t AS (SELECT sum((o - e) ** 2 / e) AS x, ((SELECT count(*) FROM r) - 1.0) * ((SELECT count(*) FROM k) - 1)::DOUBLE AS k, sum(o)::BIGINT AS samples FROM e)
        SELECT round(x, 6) AS statistic, k::DOUBLE AS degrees_of_freedom, samples, round(""" + _chi_tail("t") + ", 6) AS p_value FROM t",
    "chi_square_two_by_two": """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS o FROM labels GROUP BY 1, 2),
        r AS (SELECT a, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS k FROM c GROUP BY 1), n AS (SELECT sum(o) AS n FROM c),
        e AS (SELECT coalesce(o, 0) AS o, r * k / n AS e FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c USING (a, b)),
        t AS (SELECT sum((abs(o - e) - least(abs(o - e), 0.5)) ** 2 / e) AS x, 1.0::DOUBLE AS k, sum(o)::BIGINT AS samples FROM e)
        SELECT round(x, 6) AS statistic, k AS degrees_of_freedom, samples, round(""" + _chi_tail("t") + ", 6) AS p_value FROM t",
    "test_summary": "SELECT 'value' AS target, 'purchase, signup' AS groups, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events",
    "one_way_anova": f"""WITH {_EVENT_GROUPS}
        SELECT 'C(event_type)' AS term, d1 AS df, round(ssb, 5) AS sum_sq, round(f, 5) AS f, round({_f_tail('f')}, 5) AS p_value,
            round(ssb / (ssb + ssw), 5) AS eta_squared, round(ssb / (ssb + ssw), 5) AS partial_eta_squared FROM f
        UNION ALL SELECT 'Residual', d2, round(ssw, 5), NULL, NULL, round(ssw / (ssb + ssw), 5), 0.5 FROM f""",
    "one_way_fit": f"""WITH {_EVENT_GROUPS}
        SELECT n AS samples, round(ssb / (ssb + ssw), 6) AS r2, round(1 - (ssw / (ssb + ssw)) * (n - 1) / (n - k), 6) AS adj_r2,
            round(f, 6) AS f_statistic, round({_f_tail('f')}, 6) AS model_p_value FROM f""",
    "f_oneway": f"WITH {_QUANTITY_GROUPS} SELECT round(f, 6) AS f_statistic, round({_f_tail('f')}, 6) AS p_value, k AS groups FROM f",
    "levene_test": _levene_sql("events", "event_type", "value"),
    "levene_two_factors": _levene_sql("lineitem", "l_returnflag || ' | ' || l_linestatus", "l_quantity"),
    "tukey_pairs": f"""WITH {_EVENT_GROUPS} SELECT x.g AS group_a, y.g AS group_b, round(y.m - x.m, 6) AS mean_difference,
        round(abs(y.m - x.m) / sqrt((SELECT ssw / d2 FROM f) / 2 * (1.0::DOUBLE / x.n + 1.0::DOUBLE / y.n)), 6) AS q FROM g x JOIN g y ON x.g < y.g""",
    "jarque_bera": """WITH m AS (SELECT count(*) AS n, avg(value) AS mean, var_pop(value) AS v FROM events),
        s AS (SELECT any_value(n) AS n, avg((value - mean) ** 3) / any_value(v) ** 1.5 AS s, avg((value - mean) ** 4) / any_value(v) ** 2 - 3 AS k FROM events, m)
        SELECT n AS samples, round(n / 6.0::DOUBLE * (s * s + k * k / 4), 4) AS statistic, round(exp(-n / 12.0::DOUBLE * (s * s + k * k / 4)), 4) AS p_value FROM s""",
}
