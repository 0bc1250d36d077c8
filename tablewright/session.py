"""Session settings and the two places where intermediate data may be written."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ParameterError

# Runtime SQL settings every operator assumes; all of them are Spark's own switches.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above. A cluster supplies its own master, memory and shared folder."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Zone-free test timestamps are read as UTC wherever an epoch value is taken from them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; without one, a folder below the warehouse if all executors
    see it, that is unless it is a local path on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local_path = warehouse.startswith(("file:", "/"))
    if local_path and not spark.sparkContext.master.startswith("local"):
        raise ParameterError("set spark.checkpoint.dir to a folder that all executors share", warehouse=warehouse)
    return f"{warehouse}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table that is written and read back."""
    return f"{shared_folder(spark)}/tablewright/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later rounds restart from stored files even if executors are lost."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")
    return df.checkpoint(eager=True)


SLICE_ROWS = 20_000
MOST_SLICE_ROWS = 500_000


def slices_for(df: DataFrame, rows: int, least: int = SLICE_ROWS) -> int:
    """Parts for repeated passes: one a core while a part keeps ``least`` rows, more once a part would grow too long."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(min(cores, rows // least), -(-rows // MOST_SLICE_ROWS), 1)


def spread(df: DataFrame, rows: int, key: Sequence[str], least: int = SLICE_ROWS) -> DataFrame:
    """The rows dealt by ``key`` and in its order, however few row groups the input has; small tables stay as they are."""
    parts = slices_for(df, rows, least)
    if parts == 1:
        return df
    names = [F.col("`" + k.replace("`", "``") + "`") for k in key]
    return df.repartition(parts, *names).sortWithinPartitions(*names)
