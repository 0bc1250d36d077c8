"""Train/test and train/validation/test splits; every split is reproducible from seed and row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TableError
from .ordering import keyed_digest, smallest_digest_cut
from .quantiles import global_quantile
from .shape import col


def random_split(df: DataFrame, key: Sequence[str], ratio: float, seed: int, flag: str = "is_test") -> DataFrame:
    """Mark ceil(n * ratio) rows as test: those with the smallest keyed digests.

    ``key`` must identify a row; rows that share the whole key fall on the same side.
    """
    hashed = df.withColumn("digest", keyed_digest(seed, key)).withColumn("stratum", F.lit(1))
    quota = F.ceil(F.col("stratum_rows") * F.lit(ratio))
    cut = smallest_digest_cut(hashed, "digest", quota, ["stratum"]).first()
    if cut is None:
        raise TableError("an empty dataset cannot be split")
    return hashed.withColumn(flag, F.col("digest") <= F.lit(cut["cut"])).drop("digest", "stratum")


def stratified_quotas(df: DataFrame, label: str, ratio: float) -> DataFrame:
    """(label, n, quota): test rows per class.

    Train sizes are shared out by largest remainder so that they add up to n - ceil(n * ratio);
    everything else is test. The table has one row per class.
    """
    classes = df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(everything)
    train_total = total - F.ceil(total * F.lit(ratio))
    share = F.col("n") * train_total / total
    ranked = (
        classes.withColumn("train_total", train_total)
        .withColumn("whole", F.floor(share))
        .withColumn("rest", F.round(share - F.floor(share), 9))
        .withColumn("missing", F.col("train_total") - F.sum("whole").over(everything))
        .withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rest"), "label")))
    )
    train = F.col("whole") + F.when(F.col("place") <= F.col("missing"), 1).otherwise(0)
    return ranked.select("label", "n", (F.col("n") - train).alias("quota"))


def stratified_split(
    df: DataFrame, key: Sequence[str], label: str, ratio: float, seed: int, flag: str = "is_test"
) -> DataFrame:
    """Class-proportional split; plain random split when some class has a single row."""
    quotas = stratified_quotas(df, label, ratio)
    if quotas.agg(F.min("n")).first()[0] < 2:
        return random_split(df, key, ratio, seed, flag)
    hashed = df.withColumn("digest", keyed_digest(seed, key)).withColumn("label_", col(label))
    wanted = quotas.select(F.col("label").alias("label_"), "quota")
    cuts = smallest_digest_cut(hashed, "digest", wanted, ["label_"])
    # One row per class: broadcast, so that the rows are not brought together by class.
    return (
        hashed.join(F.broadcast(cuts), "label_", "left")
        .withColumn(flag, F.coalesce(F.col("digest") <= F.col("cut"), F.lit(False)))
        .drop("digest", "label_", "cut")
    )


def three_way_split(
    df: DataFrame, key: Sequence[str], validation_ratio: float, test_ratio: float, seed: int, part: str = "part"
) -> DataFrame:
    """train / validation / test by digest rank: test first, then validation, the rest is train."""
    hashed = df.withColumn("digest", keyed_digest(seed, key))
    test = F.ceil(F.col("stratum_rows") * F.lit(test_ratio))
    both = test + F.ceil(F.col("stratum_rows") * F.lit(validation_ratio))
    one = hashed.withColumn("stratum", F.lit(1))
    cuts = {
        name: smallest_digest_cut(one, "digest", quota, ["stratum"]).first()["cut"]
        for name, quota in (("test", test), ("validation", both))
    }
    return hashed.withColumn(
        part,
        F.when(F.col("digest") <= F.lit(cuts["test"]), "test")
        .when(F.col("digest") <= F.lit(cuts["validation"]), "validation")
        .otherwise("train"),
    ).drop("digest")


def time_cutoff(df: DataFrame, time: str, ratio: float) -> int:
    """Microseconds since the epoch of the (1 - ratio) quantile of a timestamp column."""
    micros = df.select(F.unix_micros(col(time).cast("timestamp")).alias("micros"))
    return int(global_quantile(micros, "micros", 1.0 - ratio))


def time_split(df: DataFrame, time: str, ratio: float, flag: str = "is_train") -> DataFrame:
    """Rows up to the cutoff train, later rows test; both sides must exist."""
    cutoff = time_cutoff(df, time, ratio)
    marked = df.withColumn(flag, F.unix_micros(col(time).cast("timestamp")) <= F.lit(cutoff))
    sides = marked.agg(F.count_if(F.col(flag)), F.count_if(~F.col(flag))).first()
    if not sides[0] or not sides[1]:
        raise TableError("the time split leaves one side empty")
    return marked
