"""Chart-data and document-page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anova, charts, documents
from .tables import table


def line_series(spark, sf):
    frame = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_custkey")
    return charts.xy_series(frame, "day", ["o_orderkey", "o_custkey"])


def bar_series_by_position(spark, sf):
    return charts.xy_series(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), None, ["s_acctbal"], ["s_suppkey"])


def scatter_points(spark, sf):
    return charts.xy_series(table(spark, sf, "part"), "p_size", ["p_retailprice"])


def filtered_bars(spark, sf):
    kept = charts.apply_filters(table(spark, sf, "customer"), {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": 3})
    return charts.xy_series(kept, "c_name", ["c_acctbal"])


def histogram_bins(spark, sf):
    return charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


def histogram_whole_numbers(spark, sf):
    return charts.histogram(table(spark, sf, "lineitem"), "l_linenumber")


def histogram_constant(spark, sf):
    return charts.histogram(table(spark, sf, "customer").select(F.lit(4.0).alias("v"), "c_custkey"), "v")


def boxplot_summary(spark, sf):
    boxes = charts.boxplot(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])
    return boxes.select("column", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "lower_whisker", "upper_whisker")], "outliers", "samples")


def heatmap_means(spark, sf):
    return charts.heatmap(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice").withColumn("value", F.round("value", 4))


def confusion_chart(spark, sf):
    predictions = table(spark, sf, "labels").select(F.col("quality").alias("actual"), (F.col("toxic") + 1).alias("predicted"))
    return charts.confusion_chart(predictions)


def residual_chart(spark, sf):
    from .evaluating import price_predictions
    from ..operators.evaluation import residuals

    rows = residuals(price_predictions(spark, sf), ["o_orderkey"])
    return charts.residual_chart(rows).select(F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def anova_effect_chart(spark, sf):
    table_ = anova.one_way_anova(table(spark, sf, "events"), "value", "event_type")
    return charts.anova_effect_chart(table_).withColumn("y", F.round("y", 6))


def _pages(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")


_PAGES = "SELECT conv_id, turn + 1 AS page, text FROM conversations"


def page_routing(spark, sf):
    return documents.route_pages(_pages(spark, sf), minimum=100).select("conv_id", "page", "routed_to_ocr")


def document_classes(spark, sf):
    pages = _pages(spark, sf).withColumn("recognised", F.when(F.length("text") > 60, F.col("text")))
    rows = documents.classify_documents(pages, "conv_id", "page", minimum=100, recognised="recognised")
    return rows.select("conv_id", "page_count", F.concat_ws(",", "ocr_pages").alias("ocr_pages"), F.concat_ws(",", "pages_needing_ocr").alias("pages_needing_ocr"), "document_type", "status")


def markdown_export(spark, sf):
    return documents.export_markdown(_pages(spark, sf), "conv_id", "page")


def text_export(spark, sf):
    return documents.export_text(_pages(spark, sf), "conv_id", "page")


def markdown_assembly(spark, sf):
    pages = _pages(spark, sf).withColumn("text", F.when(F.length("text") >= 60, F.col("text")).otherwise(""))
    return documents.assemble_markdown(pages, "conv_id", "page", preview_chars=500)


def page_search(spark, sf):
    return documents.search_pages(_pages(spark, sf), "the").select("conv_id", "page")


QUERIES = {
    f.__name__: f
    for f in (
        line_series, bar_series_by_position, scatter_points, filtered_bars, histogram_bins, histogram_whole_numbers,
        histogram_constant, boxplot_summary, heatmap_means, confusion_chart, residual_chart, anova_effect_chart,
        page_routing, document_classes, markdown_export, text_export, markdown_assembly, page_search,
    )
}


def _histogram_sql(source: str, column: str) -> str:
    return f"""WITH v AS (SELECT {column}::DOUBLE AS x FROM {source}),
        r AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                     CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
        b AS (SELECT i AS bin, lo + i * ((hi - lo) / 12) AS a, lo + (i + 1) * ((hi - lo) / 12) AS z, hi FROM r, range(12) t(i))
        SELECT bin, round((a + z) / 2, 6) AS midpoint,
               (SELECT count(*) FROM v WHERE (bin = 0 OR x >= a) AND (x < z OR bin = 11)) AS count FROM b"""


_BOX = """WITH q AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.5) AS m, quantile_cont({c}, 0.75) AS b FROM lineitem)
    SELECT '{c}' AS "column", round(a, 4) AS q1, round(m, 4) AS median, round(b, 4) AS q3,
        round(min({c}) FILTER ({c} >= a - 1.5 * (b - a)), 4) AS lower_whisker,
        round(max({c}) FILTER ({c} <= b + 1.5 * (b - a)), 4) AS upper_whisker,
        count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers, count(*) AS samples
    FROM lineitem, q GROUP BY a, m, b"""

_MARKDOWN_SQL = f"""SELECT conv_id, string_agg('## 第 ' || page || ' 页' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS markdown
    FROM ({_PAGES}) GROUP BY 1"""

ORACLES = {
    "line_series": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS x, 'o_orderkey' AS series, o_orderkey AS y FROM orders
        UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d'), 'o_custkey', o_custkey FROM orders""",
    "bar_series_by_position": "SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::VARCHAR AS x, 's_acctbal' AS series, s_acctbal AS y FROM supplier",
    "scatter_points": "SELECT p_size::VARCHAR AS x, 'p_retailprice' AS series, p_retailprice AS y FROM part",
    "filtered_bars": """SELECT c_name AS x, 'c_acctbal' AS series, c_acctbal AS y FROM customer
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3""",
    "histogram_bins": _histogram_sql("lineitem", "l_extendedprice"),
    "histogram_whole_numbers": _histogram_sql("lineitem", "l_linenumber"),
    "histogram_constant": _histogram_sql("(SELECT 4.0 AS v FROM customer)", "v"),
    "boxplot_summary": " UNION ALL ".join(f"({_BOX.format(c=c)})" for c in ("l_extendedprice", "l_quantity")),
    "heatmap_means": "SELECT o_orderstatus AS x, o_orderpriority AS y, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2",
    "confusion_chart": """WITH p AS (SELECT quality::VARCHAR AS a, (toxic + 1)::VARCHAR AS p FROM labels),
        l AS (SELECT a AS v FROM p UNION SELECT p FROM p)
        SELECT y.v AS x, x.v AS y, (SELECT count(*) FROM p WHERE p.a = x.v AND p.p = y.v) AS value FROM l x, l y""",
    "residual_chart": """WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i FROM orders)
        SELECT round(i + s * o_custkey, 4) AS x, round(o_totalprice - (i + s * o_custkey), 4) AS y
        FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500), f""",
    "anova_effect_chart": """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM events GROUP BY 1),
        t AS (SELECT avg(value) AS gm, count(*) AS total FROM events)
        SELECT 'C(event_type)' AS x, round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(w) / (any_value(total) - count(*))), 6) AS y FROM g, t""",
    "page_routing": "SELECT conv_id, turn + 1 AS page, length(trim(text)) < 100 AS routed_to_ocr FROM conversations",
    "document_classes": f"""WITH p AS (SELECT *, length(trim(text)) < 100 AS r, length(trim(text)) < 100 AND length(text) <= 60 AS o FROM ({_PAGES})),
        d AS (SELECT conv_id, count(*) AS n, count(*) FILTER (r) AS nr, count(*) FILTER (o) AS no,
              coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (r), '') AS ocr_pages,
              coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (o), '') AS pages_needing_ocr FROM p GROUP BY 1)
        SELECT conv_id, n AS page_count, ocr_pages, pages_needing_ocr,
            CASE WHEN nr = n THEN 'scanned' WHEN nr > 0 THEN 'mixed' ELSE 'text_based' END AS document_type,
            CASE WHEN no = 0 THEN 'parsed' WHEN no = n THEN 'ocr_required' ELSE 'partial' END AS status FROM d""",
    "markdown_export": _MARKDOWN_SQL,
    "text_export": f"""SELECT conv_id, string_agg('第 ' || page || ' 页' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS plain_text
        FROM ({_PAGES}) GROUP BY 1""",
    "markdown_assembly": f"""WITH m AS (SELECT conv_id, coalesce(string_agg('## 第 ' || page || ' 页' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page) FILTER (length(text) >= 60), '') AS markdown
        FROM ({_PAGES}) GROUP BY 1) SELECT conv_id, markdown, substr(markdown, 1, 500) AS markdown_preview FROM m""",
    "page_search": "SELECT conv_id, turn + 1 AS page FROM conversations WHERE contains(text, 'the')",
}
