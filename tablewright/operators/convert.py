"""Strict conversion of text columns to the confirmed dataset types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DATASET_TYPES, TRUE_WORDS
from ..errors import DatasetSchemaError
from .shape import col

# Spellings accepted by the strict numeric readers (blanks around and single underscores inside).
INTEGER_CELL = r"\A\s*[+-]?\d+(_\d+)*\s*\z"
NUMBER_CELL = (
    r"(?i)\A\s*[+-]?(nan|inf|infinity|((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?)\s*\z"
)


def _compact(c: Column) -> Column:
    return F.regexp_replace(c, r"[_\s]", "")


def converted(c: Column, source: T.DataType, target: str) -> Column:
    """Typed value; null for null and "" and for cells that cannot be read."""
    if not isinstance(source, T.StringType):
        if target == "text":
            return c.cast("string")
        if target == "boolean" and isinstance(source, T.BooleanType):
            return c
        if target == "integer" and isinstance(source, T.NumericType):
            # fractions are cut towards zero; NaN and out-of-range values have no integer
            return c.try_cast("bigint")
        if target == "number" and isinstance(source, T.NumericType):
            return c.cast("double")
    text = F.when(c.cast("string") != "", c.cast("string"))
    if target == "integer":
        return F.when(text.rlike(INTEGER_CELL), _compact(text).try_cast("bigint"))
    if target == "number":
        return F.when(text.rlike(NUMBER_CELL), _compact(text).try_cast("double"))
    if target == "boolean":
        return F.lower(text).isin(*TRUE_WORDS)
    return text


def check_schema(df: DataFrame, types: Mapping[str, str]) -> None:
    """The confirmed fields must name exactly the source columns and use known types."""
    unknown = sorted(t for t in types.values() if t not in DATASET_TYPES)
    if set(types) != set(df.columns) or unknown:
        raise DatasetSchemaError(
            "confirmed fields do not match the source table",
            expected=sorted(df.columns),
            supplied=sorted(types),
            unknown_types=unknown,
        )


def convert_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """All confirmed columns with their types; unreadable cells become null (see ``bad_cells``)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[converted(col(n), kinds[n], t).alias(n) for n, t in types.items()])


def bad_cells(df: DataFrame, types: Mapping[str, str], row: Column) -> DataFrame:
    """(row, column, data_type, value) of every cell that has a value but no reading in its type."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for name, target in types.items():
        raw = col(name).cast("string")
        bad = (raw != "") & converted(col(name), kinds[name], target).isNull()
        cells.append(
            F.when(
                bad,
                F.struct(F.lit(name).alias("column"), F.lit(target).alias("data_type"), raw.alias("value")),
            )
        )
    return (
        df.select(row.alias("row"), F.explode(F.array_compact(F.array(*cells))).alias("r"))
        .select("row", "r.*")
    )


def convert_strict(df: DataFrame, types: Mapping[str, str], row: str | None = None) -> DataFrame:
    """Converted columns, or DatasetSchemaError naming the first unreadable cell.

    ``row`` is an optional column with the position of the data row (0-based); the reported number
    counts the header as row 1.
    """
    source_columns = [c for c in df.columns if c != row]
    check_schema(df.select(*[col(c) for c in source_columns]), types)
    number = col(row) + 2 if row else F.lit(None).cast("long")
    order = F.create_map(*[x for i, n in enumerate(types) for x in (F.lit(n), F.lit(i))])
    first = (
        bad_cells(df, types, number).orderBy(F.col("row").asc_nulls_last(), order[F.col("column")]).limit(1).collect()
    )
    if first:
        cell = first[0]
        raise DatasetSchemaError(
            f"row {cell['row']}: cannot convert column {cell['column']}",
            row=cell["row"],
            column=cell["column"],
            data_type=cell["data_type"],
            value=cell["value"],
        )
    return convert_columns(df, types)
