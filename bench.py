"""Headline timings. Prints one JSON line; every query is fully executed through the noop sink."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "missing_profile", "column_profile", "correlation_profile", "text_conversion", "column_counts", "duplicate_rows", "row_index",
    "contingency", "latest_state", "histogram_bins", "boxplot_summary", "prepared_features", "random_split", "stratified_split", "time_split",
    "chi_square_test", "independent_t_test", "one_way_anova", "factorial_anova_type_2", "levene_test", "tukey_report",
    "linear_regression", "ridge_regression", "logistic_regression", "linear_discriminant_classifier", "naive_bayes_classifier",
    "random_forest_regressor", "xgboost_regressor", "pca", "truncated_svd", "sliding_windows", "rnn_regressor",
    "kmeans", "neighbour_graph", "dbscan", "kmedoids", "calinski_harabasz", "silhouette_squared", "markdown_export", "delimited_gb18030",
]


def main() -> None:
    from tablewright.plans import catalogue
    from tablewright.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tablewright-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(max(4, int(cpus))), "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tablewright-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.all_queries()
    wanted = sys.argv[1:] or HEADLINES
    queries["preview_head"](spark, sf_dir).collect()  # start the JVM paths before timing
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
