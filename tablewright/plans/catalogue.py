"""All registered queries with their SQL counterparts, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import registry
from . import charting, clustering, evaluating, learning, preparing, profiling, sequencing, sourcing, tabular, testing
from .tables import table

FAMILIES = (sourcing, profiling, tabular, charting, evaluating, preparing, testing, learning, sequencing, clustering)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line price from quantity, discount, tax and return flag: prepare, split, fit, score."""
    lines = table(spark, sf_dir, "lineitem")
    result = registry.run(
        lines,
        "linear_regression",
        key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        target="l_extendedprice",
        features=["l_quantity", "l_discount", "l_tax", "l_returnflag"],
    )
    return result.metrics


def all_queries() -> dict:
    found = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
    assert len(found) == sum(len(f.QUERIES) for f in FAMILIES), "query names must be unique"
    return found


def all_oracles() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
