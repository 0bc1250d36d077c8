"""Type inference, column profiles, missing values, correlation and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import PREVIEW_ROWS, SAMPLE_ROWS
from ..errors import TableError
from .ordering import keyed_digest, smallest_digest_cut
from .shape import col, finite, numeric_columns, per_column

INTEGER_TEXT = r"\A\s*[+-]?\d+\s*\z"
NUMBER_TEXT = r"\A\s*[+-]?(\d+\.\d*|\d*\.\d+|\d+)\s*\z"


def is_blank(c: Column, is_text: bool = True) -> Column:
    """The null rule of the toolkit: null or the empty string. White space counts as a value."""
    return c.isNull() | (c == "") if is_text else c.isNull()


def _declared_type(field: T.StructField) -> str | None:
    if isinstance(field.dataType, T.BooleanType):
        return "boolean"
    if isinstance(field.dataType, T.IntegralType):
        return "integer"
    if isinstance(field.dataType, T.NumericType):
        return "number"
    if isinstance(field.dataType, T.StringType):
        return None
    return "text"


def column_profile(df: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """(column, inferred_type, null_count, rows) in one scan.

    By default every row is examined; ``sample_rows`` gives the quick preview mode that looks at
    the first rows of the frame only.
    """
    source = df.limit(sample_rows) if sample_rows else df
    fields = {f.name: f for f in df.schema.fields}

    def text(name: str) -> bool:
        return isinstance(fields[name].dataType, T.StringType)

    def inferred(name: str) -> Column:
        c = col(name)
        present = ~is_blank(c, text(name))
        declared = _declared_type(fields[name])
        if declared:
            kind: Column = F.lit(declared)
        else:
            kind = (
                F.when(F.bool_and(F.when(present, c.rlike(INTEGER_TEXT))), "integer")
                .when(F.bool_and(F.when(present, c.rlike(NUMBER_TEXT))), "number")
                .otherwise("text")
            )
        return F.when(F.count_if(present) == 0, "empty").otherwise(kind)

    return per_column(
        source,
        df.columns,
        {
            "inferred_type": inferred,
            "null_count": lambda c: F.count_if(is_blank(col(c), text(c))),
            "rows": lambda c: F.count(F.lit(1)),
        },
    )


def preview(df: DataFrame, order_by: list[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows in a stated order; Spark plans this as a distributed top-k."""
    return df.orderBy(*[col(c) for c in order_by]).limit(rows)


def missing_profile(df: DataFrame) -> DataFrame:
    """(column, missing, missing_ratio, rows) for every column; NaN is missing for floats."""
    if not numeric_columns(df):
        raise TableError("profiling needs at least one numeric column")
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def missing(name: str) -> Column:
        c = col(name)
        return F.count_if(c.isNull() | F.isnan(c)) if name in floats else F.count_if(c.isNull())

    return per_column(
        df,
        df.columns,
        {
            "missing": missing,
            "missing_ratio": lambda c: missing(c) / F.count(F.lit(1)),
            "rows": lambda c: F.count(F.lit(1)),
        },
    )


def numeric_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric columns only, NaN and infinities replaced by zero."""
    names = columns or numeric_columns(df)
    return df.select(*[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in names])


def correlation_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of all numeric columns in long form, undefined values as 0.

    One aggregate computes the upper triangle; the mirrored entries are laid out from that row.
    """
    names = columns or numeric_columns(df)
    matrix = numeric_matrix(df, names)
    aggs: list[Column] = []
    for i, a in enumerate(names):
        aggs.append(F.coalesce((F.var_pop(col(a)) > 0).cast("double"), F.lit(0.0)).alias(f"c{i}_{i}"))
        for j in range(i + 1, len(names)):
            b = names[j]
            spread = F.sqrt(F.var_pop(col(a))) * F.sqrt(F.var_pop(col(b)))
            value = F.try_divide(F.covar_pop(col(a), col(b)), spread)
            aggs.append(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias(f"c{i}_{j}"))
    cells = [
        F.struct(
            F.lit(a).alias("row"),
            F.lit(b).alias("column"),
            F.col(f"c{min(i, j)}_{max(i, j)}").alias("correlation"),
        )
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    return matrix.agg(*aggs).select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def hash_sample(df: DataFrame, key: list[str], seed: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Seeded sample of a fixed size: the rows with the smallest keyed hashes.

    The hash of the last sampled row is located first (counts per hash prefix), so that the final
    ordering only ever sees about ``rows`` rows instead of that many from every partition.
    """
    hashed = df.withColumn("__digest", keyed_digest(seed, key)).withColumn("__all", F.lit(1))
    cut = smallest_digest_cut(hashed, "__digest", F.lit(rows).cast("long"), ["__all"]).first()
    kept = hashed.filter(F.col("__digest") <= F.lit(cut["cut"])) if cut else hashed
    return kept.orderBy("__digest", *[col(c) for c in key]).limit(rows).drop("__digest", "__all")


# ---- documented data-quality checks -------------------------------------------------------------


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that occur more than once with their multiplicity."""
    names = columns or df.columns
    return df.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) over all columns; copies collapse map-side before the shuffle."""
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    return (
        df.select(F.explode(F.array(*cells)).alias("r"))
        .groupBy("r.column", "r.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def column_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, nulls, unique_values, duplicates) with exact distinct counts.

    Counting over (column, value) groups keeps the distinct sets distributed instead of building
    one set per column in a single task.
    """
    return (
        value_frequencies(df, columns or df.columns)
        .groupBy("column")
        .agg(
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
            F.count("value").alias("unique_values"),
            (F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)) - F.count("value")).alias(
                "duplicates"
            ),
        )
    )


def column_flags(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, is_constant, is_identifier, twin_of) — twin_of is the first column with equal content."""
    names = columns or df.columns
    freq = value_frequencies(df, names)
    counted = freq.groupBy("column").agg(
        F.count("value").alias("unique_values"),
        F.sum("n").alias("rows"),
        F.count_if(F.col("value").isNull()).alias("has_null"),
    )
    # Same content is tested row by row through a hash of (row hash, value), summed so that the
    # order of rows does not matter and nothing is collected.
    row = F.xxhash64(*[col(c) for c in names])
    prints = per_column(
        df,
        names,
        {
            "print_a": lambda c: F.sum(F.xxhash64(row, col(c).cast("string")).cast("decimal(20,0)")),
            "print_b": lambda c: F.sum(F.xxhash64(col(c).cast("string"), row).cast("decimal(20,0)")),
        },
    )
    position = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
    ranked = prints.withColumn("position", position[F.col("column")])
    twins = Window.partitionBy("print_a", "print_b").orderBy("position")
    first = F.first("column").over(twins)
    return counted.join(ranked.withColumn("first", first), "column").select(
        "column",
        (F.col("unique_values") + F.least(F.col("has_null"), F.lit(1)) == 1).alias("is_constant"),
        ((F.col("unique_values") == F.col("rows")) & (F.col("has_null") == 0)).alias("is_identifier"),
        F.when(F.col("first") != F.col("column"), F.col("first")).alias("twin_of"),
    )
