"""Queries over imputation, scaling, encoding and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preparation, splitting
from ..session import use_utc
from .profiling import _HOLES, with_holes
from .tables import table


def median_imputation(spark, sf):
    frame = with_holes(spark, sf)
    fills = preparation.medians(frame, ["l_quantity", "l_linenumber"])
    return frame.select(
        "l_orderkey",
        *[F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c) for c, v in fills.items()],
    )


def standardisation(spark, sf):
    frame = table(spark, sf, "part").withColumn("flat", F.lit(3.0))
    scalings = preparation.fit_scaling(frame, ["p_size", "p_retailprice", "flat"], impute=False)
    return frame.select("p_partkey", *[F.round(F.expr(s.sql()), 6).alias(s.name) for s in scalings])


def most_frequent_imputation(spark, sf):
    frame = with_holes(spark, sf).select("l_orderkey", "l_returnflag", F.col("l_linenumber").cast("string").alias("line"))
    best = {r["column"]: r["value"] for r in preparation.most_frequent(frame, ["l_returnflag", "line"]).collect()}
    return frame.select("l_orderkey", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in best.items()])


def one_hot_columns(spark, sf):
    """One-hot slots in sorted category order, fitted without one segment so that it is all zeros."""
    from pyspark.ml.functions import vector_to_array

    frame = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    fitted = preparation.fit_preparation(frame.filter("c_mktsegment <> 'MACHINERY'"), ["c_mktsegment"])
    slots = vector_to_array("features")
    return fitted.transform(frame).select(
        "c_custkey", *[slots[i].cast("int").alias(n.lower()) for i, n in enumerate(fitted.names)]
    )


def prepared_features(spark, sf):
    """The whole preparation on mixed columns with gaps: median fill, scaling, mode fill, one-hot."""
    from pyspark.ml.functions import vector_to_array

    frame = with_holes(spark, sf).select("l_orderkey", "l_quantity", "l_linenumber", "l_returnflag")
    fitted = preparation.fit_preparation(frame, ["l_quantity", "l_linenumber", "l_returnflag"])
    slots = vector_to_array("features")
    return fitted.transform(frame).select(
        "l_orderkey", *[F.round(slots[i], 5).alias(n.lower()) for i, n in enumerate(fitted.names)]
    )


def label_encoding(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return preparation.encode_labels(frame, "o_orderpriority").select("o_orderkey", "label_index")


def random_split(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderkey")
    return splitting.random_split(frame, ["o_orderkey"], 0.2, 42)


def stratified_quotas(spark, sf):
    return splitting.stratified_quotas(table(spark, sf, "labels").withColumn("label", F.concat("quality", F.lit("/"), "toxic")), "label", 0.25)


def stratified_split(spark, sf):
    frame = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return splitting.stratified_split(frame, ["c_custkey"], "c_mktsegment", 0.3, 11)


def three_way_split(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderkey")
    return splitting.three_way_split(frame, ["o_orderkey"], 0.15, 0.2, 42)


def time_split(spark, sf):
    use_utc(spark)
    frame = table(spark, sf, "events").select("event_id", "ts")
    return splitting.time_split(frame, "ts", 0.2).select("event_id", "is_train")


def training_period_scaling(spark, sf):
    """Values scaled by mean and deviation of the training period only."""
    use_utc(spark)
    frame = splitting.time_split(table(spark, sf, "events").select("event_id", "ts", "value"), "ts", 0.2)
    scaling = preparation.fit_scaling(frame.filter("is_train"), ["value"], impute=False)[0]
    return frame.select("event_id", F.round(F.expr(scaling.sql()), 6).alias("scaled"))


QUERIES = {
    f.__name__: f
    for f in (
        median_imputation, standardisation, most_frequent_imputation, one_hot_columns, prepared_features,
        label_encoding, random_split, stratified_quotas, stratified_split, three_way_split, time_split,
        training_period_scaling,
    )
}

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
_CUTOFF = "(SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.8) AS cut FROM events)"

ORACLES = {
    "median_imputation": f"""WITH t AS ({_HOLES}), m AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_linenumber::DOUBLE, 0.5) AS n FROM t)
        SELECT l_orderkey, coalesce(l_quantity, q) AS l_quantity, coalesce(l_linenumber, n)::DOUBLE AS l_linenumber FROM t, m""",
    "standardisation": """SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size,
        round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice, 0.0::DOUBLE AS flat FROM part""",
    "most_frequent_imputation": f"""WITH t AS ({_HOLES}),
        f AS (SELECT l_returnflag AS v FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        g AS (SELECT l_linenumber::VARCHAR AS v FROM t WHERE l_linenumber IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT l_orderkey, coalesce(l_returnflag, f.v) AS l_returnflag, coalesce(l_linenumber::VARCHAR, g.v) AS line FROM t, f, g""",
    "one_hot_columns": "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{s.lower()}" for s in _SEGMENTS) + " FROM customer",
    "prepared_features": f"""WITH t AS ({_HOLES}),
        m AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_linenumber::DOUBLE, 0.5) AS n FROM t),
        f AS (SELECT l_returnflag AS v FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        x AS (SELECT l_orderkey, coalesce(l_quantity, q) AS a, coalesce(l_linenumber, n) AS b, coalesce(l_returnflag, f.v) AS c FROM t, m, f)
        SELECT l_orderkey, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 5) AS l_quantity, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 5) AS l_linenumber,
            (c = 'A')::INT::DOUBLE AS l_returnflag_a, (c = 'N')::INT::DOUBLE AS l_returnflag_n FROM x""",
    "label_encoding": "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label_index FROM orders",
    "random_split": "SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) <= (SELECT ceil(count(*) * 0.2) FROM orders) AS is_test FROM orders",
    "stratified_quotas": """WITH c AS (SELECT quality || '/' || toxic AS label, count(*) AS n FROM labels GROUP BY 1),
        t AS (SELECT *, sum(n) OVER () - ceil(sum(n) OVER () * 0.25) AS train FROM (SELECT * FROM c)),
        s AS (SELECT *, n * train / sum(n) OVER () AS share FROM t),
        r AS (SELECT *, floor(share) AS whole, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, label) AS place FROM s)
        SELECT label, n, (n - whole - CASE WHEN place <= train - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""",
    "stratified_split": """WITH c AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1),
        t AS (SELECT *, sum(n) OVER () - ceil(sum(n) OVER () * 0.3) AS train FROM c),
        s AS (SELECT *, n * train / sum(n) OVER () AS share FROM t),
        r AS (SELECT *, floor(share) AS whole, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, label) AS place FROM s),
        q AS (SELECT label, n - whole - CASE WHEN place <= train - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM r)
        SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('11:' || c_custkey)) <= quota AS is_test
        FROM customer JOIN q ON c_mktsegment = label""",
    "three_way_split": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS i, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, CASE WHEN i <= ceil(n * 0.2) THEN 'test' WHEN i <= ceil(n * 0.2) + ceil(n * 0.15) THEN 'validation' ELSE 'train' END AS part FROM r""",
    "time_split": f"SELECT event_id, epoch_us(ts) <= cut AS is_train FROM events, {_CUTOFF}",
    "training_period_scaling": f"""WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events, {_CUTOFF} WHERE epoch_us(ts) <= cut)
        SELECT event_id, round((value - m) / d, 6) AS scaled FROM events, s""",
}
