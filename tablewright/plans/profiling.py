"""Queries over profiles, typing, filters and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convert, ordering, preparation, profiling
from ..operators.shape import col
from .tables import table

# The tables have no nulls, so the same ones are injected in both engines.
_HOLES = """
    SELECT l_orderkey, nullif(l_linenumber, 3) AS l_linenumber,
           CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS l_quantity,
           l_extendedprice, l_discount, l_tax,
           nullif(l_returnflag, 'R') AS l_returnflag, l_linestatus
    FROM lineitem
"""


def with_holes(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.nullif("l_linenumber", F.lit(3)).alias("l_linenumber"),
        F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        "l_discount",
        "l_tax",
        F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"),
        "l_linestatus",
    )


def as_text(spark, sf):
    """Order rows as raw text cells with blanks, signs, decimals and gaps, as an import sees them."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("+"), (F.col("o_custkey") % 50).cast("string"), F.lit(".5")).alias("amount"),
        F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.col("o_orderpriority").alias("priority"),
        F.lit("").alias("comment"),
        F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "是").otherwise("no").alias("flag"),
    )


_TEXT = """
    SELECT ' ' || o_orderkey AS id, '+' || (o_custkey % 50) || '.5' AS amount,
           CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_custkey::VARCHAR END AS customer,
           o_orderpriority AS priority, '' AS comment,
           CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN '是' ELSE 'no' END AS flag
    FROM orders
"""


def missing_profile(spark, sf):
    return profiling.missing_profile(with_holes(spark, sf)).withColumn("missing_ratio", F.round("missing_ratio", 6))


def column_profile(spark, sf):
    return profiling.column_profile(as_text(spark, sf))


def typed_profile(spark, sf):
    return profiling.column_profile(with_holes(spark, sf))


def preview_head(spark, sf):
    return profiling.preview(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"])


def correlation_profile(spark, sf):
    frame = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return profiling.correlation_profile(frame.withColumn("constant", F.lit(1.0))).withColumn(
        "correlation", F.round("correlation", 6)
    )


_CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant"]
_CORRELATION_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS \"row\", '{b}' AS \"column\", "
    + ("0.0::DOUBLE" if "constant" in (a, b) else "round(corr(%s, %s), 6)" % (a, b))
    + " AS correlation" + ("" if "constant" in (a, b) else " FROM lineitem")
    for a in _CORRELATED
    for b in _CORRELATED
)


def numeric_matrix(spark, sf):
    frame = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 == 0, F.lit(float("inf"))).when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        "c_name",
    )
    return profiling.numeric_matrix(frame)


def text_conversion(spark, sf):
    types = {"id": "integer", "amount": "number", "customer": "integer", "priority": "text", "comment": "text", "flag": "boolean"}
    return convert.convert_strict(as_text(spark, sf), types)


def bad_cells(spark, sf):
    frame = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("position"),
        F.when(F.col("c_custkey") % 10 == 0, F.concat("c_custkey", F.lit(".0"))).otherwise(F.col("c_custkey").cast("string")).alias("number_text"),
        F.col("c_mktsegment").alias("segment"),
    )
    types = {"number_text": "integer", "segment": "number"}
    return convert.bad_cells(frame, types, F.col("position") + 2)


def feature_selection(spark, sf):
    frame = table(spark, sf, "part")
    names = preparation.select_features(frame, [], {"p_retailprice", "p_name", None})
    return frame.select(*[col(n) for n in names])


def drop_null_targets(spark, sf):
    return with_holes(spark, sf).filter(F.col("l_quantity").isNotNull()).groupBy("l_linestatus").agg(F.count("*").alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def drop_incomplete_rows(spark, sf):
    kept = preparation.drop_missing(with_holes(spark, sf), ["l_quantity", "l_returnflag", "l_linenumber"])
    return kept.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("rows"))


def row_sample(spark, sf):
    return profiling.hash_sample(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], 42)


def duplicate_rows(spark, sf):
    return profiling.duplicate_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicate_texts(spark, sf):
    texts = table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256"))
    return profiling.duplicate_rows(texts)


def outlier_check(spark, sf):
    from ..operators import charts

    boxes = charts.boxplot(table(spark, sf, "events"), ["value"])
    return boxes.select("column", "outliers", "samples")


def column_counts(spark, sf):
    return profiling.column_counts(with_holes(spark, sf).drop("l_extendedprice", "l_quantity"))


def column_flags(spark, sf):
    frame = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_mktsegment").alias("segment_copy"), F.lit("x").alias("fixed"))
    return profiling.column_flags(frame)


def class_imbalance(spark, sf):
    from ..operators.counting import group_ratios

    counts = group_ratios(table(spark, sf, "labels"), "quality")
    return counts.agg(
        F.count("*").alias("classes"),
        F.round(F.max("count") / F.min("count"), 6).alias("imbalance"),
        F.round(F.min("ratio"), 6).alias("smallest_share"),
    )


def split_leakage(spark, sf):
    """Test rows whose text also occurs among the training rows."""
    from ..operators.splitting import random_split

    marked = random_split(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_hash")), ["doc_id"], 0.2, 7)
    train = marked.filter(~F.col("is_test")).select("text_hash")
    return marked.filter("is_test").join(train, "text_hash", "left_semi").select("doc_id")


def row_index(spark, sf):
    frame = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return ordering.add_row_index(frame, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


QUERIES = {
    "missing_profile": missing_profile,
    "column_profile": column_profile,
    "typed_profile": typed_profile,
    "preview_head": preview_head,
    "correlation_profile": correlation_profile,
    "numeric_matrix": numeric_matrix,
    "text_conversion": text_conversion,
    "bad_cells": bad_cells,
    "feature_selection": feature_selection,
    "drop_null_targets": drop_null_targets,
    "drop_incomplete_rows": drop_incomplete_rows,
    "row_sample": row_sample,
    "duplicate_rows": duplicate_rows,
    "duplicate_texts": duplicate_texts,
    "outlier_check": outlier_check,
    "column_counts": column_counts,
    "column_flags": column_flags,
    "class_imbalance": class_imbalance,
    "split_leakage": split_leakage,
    "row_index": row_index,
}

_HOLE_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_HOLE_TYPES = dict(zip(_HOLE_COLUMNS, ["integer", "integer", "number", "number", "number", "number", "text", "text"]))

ORACLES = {
    "missing_profile": f"WITH t AS ({_HOLES}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, "
        f"round(count(*) FILTER ({c} IS NULL)::DOUBLE / count(*), 6) AS missing_ratio, count(*) AS rows FROM t"
        for c in _HOLE_COLUMNS
    ),
    "column_profile": f"WITH t AS ({_TEXT}) " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column",
            CASE WHEN count(*) FILTER ({c} <> '') = 0 THEN 'empty'
                 WHEN bool_and(regexp_full_match(trim({c}), '[+-]?\\d+')) FILTER ({c} <> '') THEN 'integer'
                 WHEN bool_and(regexp_full_match(trim({c}), '[+-]?(\\d+\\.\\d*|\\d*\\.\\d+|\\d+)')) FILTER ({c} <> '') THEN 'number'
                 ELSE 'text' END AS inferred_type,
            count(*) FILTER ({c} IS NULL OR {c} = '') AS null_count, count(*) AS rows FROM t"""
        for c in ["id", "amount", "customer", "priority", "comment", "flag"]
    ),
    "typed_profile": f"WITH t AS ({_HOLES}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS inferred_type, count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS rows FROM t"
        for c, k in _HOLE_TYPES.items()
    ),
    "preview_head": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
    "correlation_profile": _CORRELATION_SQL,
    "numeric_matrix": """SELECT c_custkey::DOUBLE AS c_custkey,
        CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""",
    "text_conversion": f"""WITH t AS ({_TEXT}) SELECT trim(id)::BIGINT AS id, amount::DOUBLE AS amount,
        nullif(customer, '')::BIGINT AS customer, priority, nullif(comment, '') AS comment,
        lower(flag) IN ('true', '1', 'yes', '是') AS flag FROM t""",
    "bad_cells": """SELECT c_custkey + 2 AS row, 'number_text' AS "column", 'integer' AS data_type, c_custkey || '.0' AS value
        FROM customer WHERE c_custkey % 10 = 0
        UNION ALL SELECT c_custkey + 2, 'segment', 'number', c_mktsegment FROM customer""",
    "feature_selection": "SELECT p_partkey, p_brand, p_type, p_size FROM part",
    "drop_null_targets": f"WITH t AS ({_HOLES}) SELECT l_linestatus, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM t WHERE l_quantity IS NOT NULL GROUP BY 1",
    "drop_incomplete_rows": f"""WITH t AS ({_HOLES}) SELECT l_returnflag, l_linenumber, count(*) AS rows FROM t
        WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2""",
    "row_sample": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
        ORDER BY md5('42:' || l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber), 1, 2, 3, 4 LIMIT 50000""",
    "duplicate_rows": "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "duplicate_texts": "SELECT sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "outlier_check": """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
        SELECT 'value' AS "column", count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers, count(*) AS samples
        FROM events, q""",
    "column_counts": f"WITH t AS ({_HOLES}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS unique_values, count({c}) - count(DISTINCT {c}) AS duplicates FROM t"
        for c in _HOLE_COLUMNS if c not in ("l_extendedprice", "l_quantity")
    ),
    "column_flags": """SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) = 1 AS is_constant, count(DISTINCT c_custkey) = count(*) AS is_identifier, NULL::VARCHAR AS twin_of FROM customer
        UNION ALL SELECT 'c_name', count(DISTINCT c_name) = 1, count(DISTINCT c_name) = count(*), NULL FROM customer
        UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) = 1, count(DISTINCT c_mktsegment) = count(*), NULL FROM customer
        UNION ALL SELECT 'segment_copy', count(DISTINCT c_mktsegment) = 1, count(DISTINCT c_mktsegment) = count(*), 'c_mktsegment' FROM customer
        UNION ALL SELECT 'fixed', true, count(*) = 1, NULL FROM customer""",
    "class_imbalance": """WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
        SELECT count(*) AS classes, round(max(n)::DOUBLE / min(n), 6) AS imbalance, round(min(n)::DOUBLE / sum(n), 6) AS smallest_share FROM c""",
    "split_leakage": """WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('7:' || doc_id)) <= (SELECT ceil(count(*) * 0.2) FROM documents) AS is_test FROM documents)
        SELECT doc_id FROM d WHERE is_test AND text IN (SELECT text FROM d WHERE NOT is_test)""",
    "row_index": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_index FROM lineitem""",
}
