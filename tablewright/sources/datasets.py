"""Immutable dataset versions, their registry, and sinks for results."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TableError

REGISTRY_SCHEMA = "source string, version long, path string, row_count long, columns string, created_at timestamp"


class DatasetStore:
    """Versions below ``base``; data in ``<base>/data/source=<s>/v=<n>``, one registry row per version."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def _registry_path(self) -> str:
        return f"{self.base}/registry"

    def registry(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._registry_path())
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(self._registry_path())

    def next_version(self, source: str) -> int:
        row = self.registry().filter(F.col("source") == source).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("n")).first()
        return int(row["n"])

    def write(self, df: DataFrame, source: str) -> int:
        """Stores a new version (zstd Parquet, never overwritten) and returns its number.

        A version that another writer created first makes the write fail instead of replacing it.
        The row count is taken from the stored files' footers.
        """
        version = self.next_version(source)
        path = f"{self.base}/data/source={source}/v={version}"
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        rows = self.spark.read.parquet(path).count()
        columns = json.dumps([{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields], ensure_ascii=False)
        entry = self.spark.range(1).select(
            F.lit(source).alias("source"), F.lit(version).cast("long").alias("version"), F.lit(path).alias("path"),
            F.lit(rows).cast("long").alias("row_count"), F.lit(columns).alias("columns"), F.current_timestamp().alias("created_at"),
        )
        entry.write.mode("append").parquet(self._registry_path())
        return version

    def history(self, source: str | None = None) -> DataFrame:
        """Registry rows, newest first."""
        rows = self.registry()
        rows = rows.filter(F.col("source") == source) if source else rows
        return rows.orderBy(F.desc("created_at"), F.desc("version"))

    def load(self, source: str, version: int | None = None) -> DataFrame:
        """One version (the latest by default); an empty or unknown dataset is an error."""
        rows = self.registry().filter(F.col("source") == source)
        rows = rows.filter(F.col("version") == version) if version else rows.orderBy(F.desc("version"))
        found = rows.limit(1).collect()
        if not found:
            raise TableError("the dataset version does not exist", source=source, version=version)
        return load_dataset(self.spark, found[0]["path"])


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise TableError("the dataset is empty", path=path)
    return df


def save_result(base: str, run_id: str, tables: Mapping[str, DataFrame], as_json: bool = True) -> None:
    """Every named table of a run below ``<base>/<table>/run_id=<id>``."""
    for name, table in tables.items():
        writer = table.write.mode("errorifexists")
        target = f"{base.rstrip('/')}/{name}/run_id={run_id}"
        writer.json(target) if as_json else writer.parquet(target)


def export_predictions(predictions: DataFrame, path: str, as_csv: bool = False) -> None:
    """Predictions as Parquet, or as CSV with a header."""
    writer = predictions.write.mode("errorifexists")
    writer.option("header", True).csv(path) if as_csv else writer.option("compression", "zstd").parquet(path)
