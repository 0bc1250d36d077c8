"""Queries over joins, grouped counts, windows, ordering, upserts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import counting
from ..operators.ordering import add_series_index
from ..operators.quantiles import exact_quantiles
from ..session import use_utc
from .tables import table


def lineage_join(spark, sf):
    """Each order with its customer and nation: id lookups, one match per row."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "c_name", "n_name")
    )


def left_lookup(spark, sf):
    """Every document with its label, null where it has none."""
    documents = table(spark, sf, "documents").select("doc_id", "source")
    return documents.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


def known_labels(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    return documents.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


def unseen_labels(spark, sf):
    """Part brands that never occur among the small parts."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    known = parts.filter(F.col("p_size") <= 2).select("p_name").distinct()
    return parts.join(known, "p_name", "left_anti").groupBy("p_name").agg(F.count("*").alias("rows"))


def group_ratio(spark, sf):
    return counting.group_ratios(table(spark, sf, "customer"), "c_mktsegment").withColumn("ratio", F.round("ratio", 6))


def contingency(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 7
    # one combination is counted under another, so that an empty cell has to appear
    k = F.when((F.col("event_type") == "click") & (k == 3), 4).otherwise(k)
    return counting.contingency(table(spark, sf, "events").select("event_type", k.alias("k")), "event_type", "k")


def grouped_values(spark, sf):
    frame = table(spark, sf, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("R")))
    return (
        frame.filter(F.col("flag").isNotNull())
        .groupBy("flag")
        .agg(F.count("*").alias("rows"), F.round(F.min("l_quantity"), 4).alias("low"), F.round(F.max("l_quantity"), 4).alias("high"))
    )


def mean_and_deviation(spark, sf):
    frame = table(spark, sf, "events")
    return frame.groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std")
    )


def distinct_classes(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").cast("string").alias("label")).distinct()


def next_version(spark, sf):
    """Next version number per source: line numbers stand in for versions of an order."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("newest"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", (F.coalesce("newest", F.lit(0)) + 1).cast("long").alias("next_version")
    )


def time_quantile(spark, sf):
    use_utc(spark)
    micros = table(spark, sf, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return exact_quantiles(micros, ["micros"], [0.8, 0.5], by=["event_type"]).select(
        "event_type", "prob", F.round("value", 0).cast("long").alias("micros")
    )


def series_sizes(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("rows"))


def pivot_counts(spark, sf):
    from ..operators.evaluation import confusion_counts, pivot_counts as pivot

    frame = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("actual"), F.col("o_orderpriority").alias("predicted"))
    cells = confusion_counts(frame)
    pivoted = pivot(cells)
    return pivoted.toDF(*["actual", *[f"p{c[0]}" for c in pivoted.columns[1:]]])


def latest_state(spark, sf):
    frame = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return counting.latest_per_key(frame, ["user_id"], ["event_id"])


def ordered_events(spark, sf):
    """Stable order by (group text, time) shown as the position inside each series."""
    frame = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("series"), "ts", "event_id")
    placed = add_series_index(frame, "series", ["ts", "event_id"], "position")
    return placed.select("series", "event_id", F.col("position").cast("long").alias("position"))


def preview_limits(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy("event_id").limit(500)


def text_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 4000).alias("preview"))


def newest_listing(spark, sf):
    """Orders of one status, newest first: the listing of one project."""
    frame = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    return frame.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_custkey")


def label_union(spark, sf):
    labels = table(spark, sf, "labels")
    return labels.select(F.col("quality").cast("string").alias("label")).union(labels.select(F.col("toxic").cast("string"))).distinct()


def upsert_rows(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"))
    new = old.filter(F.col("c_custkey") % 3 == 0).select("c_custkey", F.lower("state").alias("state"))
    return counting.upsert(old, new, ["c_custkey"])


def trim_and_match(spark, sf):
    raw = F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))
    return table(spark, sf, "orders").select("o_orderkey", F.trim(raw).alias("trimmed"), F.trim(raw).rlike(r"\A\d-[A-Z]+\z").alias("matches"))


def boolean_words(spark, sf):
    word = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "是").otherwise("nope")
    return table(spark, sf, "orders").select("o_orderkey", scalars.is_true_word(word).alias("flag"))


def strict_numbers(spark, sf):
    from pyspark.sql import types as T

    from ..operators.convert import converted

    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.col("c_custkey"), F.lit(" "))).when(F.col("c_custkey") % 3 == 1, F.concat("c_custkey", F.lit(".5"))).otherwise("1e3x")
    return table(spark, sf, "customer").select("c_custkey", converted(text, T.StringType(), "integer").alias("whole"), converted(text, T.StringType(), "number").alias("number"))


def timestamp_parse(spark, sf):
    use_utc(spark)
    text = F.when(F.col("event_id") % 10 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", F.unix_seconds(scalars.to_strict_timestamp(text)).alias("seconds"))


def iso_dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalars.iso_date("o_orderdate").alias("iso"), scalars.iso_datetime("o_orderdate").alias("iso_time"))


def factor_keys(spark, sf):
    frame = table(spark, sf, "lineitem").select(scalars.factor_key(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")).alias("factor"))
    return frame.groupBy("factor").agg(F.count("*").alias("rows"))


def text_fingerprints(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length(F.encode("html", "UTF-8")).cast("long").alias("bytes"))


def text_lengths(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.length(F.trim("text")).cast("long").alias("chars"), scalars.needs_ocr(F.col("text"), 100).alias("short"))


def safe_names(spark, sf):
    return table(spark, sf, "orders").select(scalars.safe_name(F.col("o_orderpriority")).alias("name")).groupBy("name").agg(F.count("*").alias("rows"))


def rounded_midpoints(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round((F.col("p_retailprice") + F.col("p_size")) / 2, 6).alias("middle"))


def vector_norms(spark, sf):
    v = F.col("embedding").cast("array<double>")
    zero = F.transform(v, lambda x: F.lit(0.0))
    norm = scalars.euclidean(v, zero)
    return table(spark, sf, "embeddings").select("vec_id", F.round(norm, 5).alias("norm"), F.round(F.exp(-norm), 5).alias("e"), F.round(F.log(norm), 5).alias("l"))


def json_fields(spark, sf):
    parsed = F.from_json("props", "k INT")
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("raw"), parsed["k"].alias("k"), F.to_json(parsed).alias("compact"))


QUERIES = {
    f.__name__: f
    for f in (
        lineage_join, left_lookup, known_labels, unseen_labels, group_ratio, contingency, grouped_values,
        mean_and_deviation, distinct_classes, next_version, time_quantile, series_sizes, pivot_counts,
        latest_state, ordered_events, preview_limits, text_preview, newest_listing, label_union, upsert_rows,
        trim_and_match, boolean_words, strict_numbers, timestamp_parse, iso_dates, factor_keys,
        text_fingerprints, text_lengths, safe_names, rounded_midpoints, vector_norms, json_fields,
    )
}

ORACLES = {
    "lineage_join": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "left_lookup": "SELECT d.doc_id, source, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "known_labels": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "unseen_labels": "SELECT p_name, count(*) AS rows FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 2) GROUP BY 1",
    "group_ratio": "SELECT c_mktsegment, count(*) AS count, round(count(*)::DOUBLE / (SELECT count(*) FROM customer), 6) AS ratio FROM customer GROUP BY 1",
    "contingency": """WITH t AS (SELECT event_type, (props->>'$.k')::INT % 7 AS k FROM events),
        u AS (SELECT event_type, CASE WHEN event_type = 'click' AND k = 3 THEN 4 ELSE k END AS k FROM t),
        a AS (SELECT DISTINCT event_type FROM u), b AS (SELECT DISTINCT k FROM u)
        SELECT a.event_type AS row, b.k::VARCHAR AS "column", count(u.k) AS count
        FROM a CROSS JOIN b LEFT JOIN u ON u.event_type = a.event_type AND u.k = b.k GROUP BY 1, 2""",
    "grouped_values": """SELECT l_returnflag AS flag, count(*) AS rows, round(min(l_quantity), 4) AS low, round(max(l_quantity), 4) AS high
        FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""",
    "mean_and_deviation": "SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events GROUP BY 1",
    "distinct_classes": "SELECT DISTINCT o_orderpriority AS label FROM orders",
    "next_version": """SELECT o_orderkey, (coalesce(max(l_linenumber), 0) + 1)::BIGINT AS next_version
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
    "time_quantile": """SELECT event_type, p AS prob, round(CASE WHEN p = 0.8 THEN quantile_cont(epoch_us(ts)::DOUBLE, 0.8) ELSE quantile_cont(epoch_us(ts)::DOUBLE, 0.5) END, 0)::BIGINT AS micros
        FROM events, (VALUES (0.8::DOUBLE), (0.5::DOUBLE)) v(p) GROUP BY 1, 2""",
    "series_sizes": "SELECT user_id, count(*) AS rows FROM events GROUP BY 1",
    "pivot_counts": "SELECT o_orderstatus AS actual, " + ", ".join(
        f"(count(*) FILTER (o_orderpriority LIKE '{i}-%')) AS p{i}" for i in range(1, 6)
    ) + " FROM orders GROUP BY 1",
    "latest_state": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "ordered_events": "SELECT user_id::VARCHAR AS series, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events",
    "preview_limits": "SELECT event_id, value FROM events ORDER BY event_id LIMIT 500",
    "text_preview": "SELECT doc_id, substr(text, 1, 4000) AS preview FROM documents",
    "newest_listing": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey",
    "label_union": "SELECT quality::VARCHAR AS label FROM labels UNION SELECT toxic::VARCHAR FROM labels",
    "upsert_rows": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS state FROM customer",
    "trim_and_match": "SELECT o_orderkey, o_orderpriority AS trimmed, regexp_full_match(o_orderpriority, '\\d-[A-Z]+') AS matches FROM orders",
    "boolean_words": "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS flag FROM orders",
    "strict_numbers": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS whole,
        CASE c_custkey % 3 WHEN 0 THEN c_custkey::DOUBLE WHEN 1 THEN c_custkey + 0.5::DOUBLE END AS number FROM customer""",
    "timestamp_parse": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN epoch_us(date_trunc('second', ts)) // 1000000 END AS seconds FROM events",
    "iso_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso_time FROM orders",
    "factor_keys": "SELECT l_returnflag || ' | ' || l_linestatus || ' | ' || l_linenumber AS factor, count(*) AS rows FROM lineitem GROUP BY 1",
    "text_fingerprints": "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes FROM pages",
    "text_lengths": "SELECT conv_id, turn, length(trim(text)) AS chars, length(trim(text)) < 100 AS short FROM conversations",
    "safe_names": "SELECT regexp_replace(o_orderpriority, '[^0-9a-zA-Z_]', '_', 'g') AS name, count(*) AS rows FROM orders GROUP BY 1",
    "rounded_midpoints": "SELECT p_partkey, round((p_retailprice + p_size) / 2, 6) AS middle FROM part",
    "vector_norms": """WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS v FROM embeddings)
        SELECT vec_id, round(v, 5) AS norm, round(exp(-v), 5) AS e, round(ln(v), 5) AS l FROM n""",
    "json_fields": """SELECT event_id, props->>'$.k' AS raw, (props->>'$.k')::INT AS k, '{"k":' || (props->>'$.k') || '}' AS compact FROM events""",
}
