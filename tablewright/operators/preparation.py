"""Feature selection, imputation, scaling, one-hot and label encoding."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ParameterError
from .profiling import value_frequencies
from .quantiles import exact_quantiles
from .shape import col, quoted

FEATURES = "features"


def select_features(
    df: DataFrame, configured: Sequence[str] = (), excluded: Collection[str | None] = ()
) -> list[str]:
    """The configured feature names, or every column that has no other role."""
    names = list(configured) or [c for c in df.columns if c not in excluded]
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ParameterError(f"feature columns do not exist: {', '.join(missing)}", missing=missing)
    if not names:
        raise ParameterError("no feature column is left")
    return names


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value (not null, not NaN) in every named column."""
    return df.dropna(subset=list(columns))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    clean = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    rows = exact_quantiles(clean, columns, [0.5]).collect()
    found = {r["column"]: r["value"] for r in rows}
    return {c: found.get(c) for c in columns}


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): most frequent non-null value, ties to the smallest value."""
    return (
        value_frequencies(df, list(columns))
        .filter("value IS NOT NULL")
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("minus_n"), "value")).alias("best"))
        .select("column", F.col("best.value").alias("value"), (-F.col("best.minus_n")).alias("n"))
    )


@dataclass
class NumericScaling:
    """Fitted constants of one numeric column."""

    name: str
    fill: float
    mean: float
    scale: float

    def sql(self) -> str:
        filled = f"coalesce(nanvl(CAST({quoted(self.name)} AS DOUBLE), CAST(NULL AS DOUBLE)), {_number(self.fill)})"
        return f"({filled} - {_number(self.mean)}) / {_number(self.scale)}"


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_scaling(df: DataFrame, columns: Sequence[str], impute: bool = True) -> list[NumericScaling]:
    """Median fill, mean and population deviation (a zero deviation scales by 1)."""
    if not columns:
        return []
    fills = medians(df, columns) if impute else {c: None for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        value = F.nanvl(col(c).cast("double"), F.lit(None))
        value = F.coalesce(value, F.lit(fills[c])) if fills[c] is not None else value
        aggs += [F.avg(value).alias(f"a{i}"), F.stddev_pop(value).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    fitted = []
    for i, c in enumerate(columns):
        deviation = row[f"s{i}"]
        fitted.append(
            NumericScaling(c, fills[c] if fills[c] is not None else 0.0, row[f"a{i}"] or 0.0, deviation or 1.0)
        )
    return fitted


@dataclass
class Preparation:
    """A fitted preparation: a savable pipeline that adds a ``features`` vector, and the slot names."""

    model: PipelineModel
    names: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def route_columns(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric columns and category columns. A boolean column with nulls counts as a category."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    booleans = [c for c in columns if isinstance(kinds[c], T.BooleanType)]
    with_nulls: set[str] = set()
    if booleans:
        row = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(booleans)]).first()
        with_nulls = {c for i, c in enumerate(booleans) if row[f"n{i}"]}
    numeric = [c for c in columns if isinstance(kinds[c], T.NumericType) or (c in booleans and c not in with_nulls)]
    return numeric, [c for c in columns if c not in numeric]


def fit_preparation(df: DataFrame, columns: Sequence[str]) -> Preparation:
    """Impute, standardise and one-hot encode; fitted on ``df`` only.

    The numeric part is plain SQL with fitted literals, so it stays inside whole-stage codegen and
    saves with the model. Categories use sorted indexing with the unknown slot dropped, which turns
    unseen values into all zeros.
    """
    numeric, categories = route_columns(df, columns)
    scalings = fit_scaling(df, numeric)
    modes = {}
    if categories:
        modes = {r["column"]: r["value"] for r in most_frequent(df, categories).collect()}
    select = ["*"]
    select += [f"{s.sql()} AS __num{i}" for i, s in enumerate(scalings)]
    select += [
        f"coalesce(CAST({quoted(c)} AS STRING), {_text(modes.get(c) or '')}) AS __cat{i}"
        for i, c in enumerate(categories)
    ]
    stages: list = [SQLTransformer(statement=f"SELECT {', '.join(select)} FROM __THIS__")]
    inputs = [f"__num{i}" for i in range(len(numeric))]
    if categories:
        raw = [f"__cat{i}" for i in range(len(categories))]
        index = [f"__idx{i}" for i in range(len(categories))]
        hot = [f"__hot{i}" for i in range(len(categories))]
        stages += [
            StringIndexer(inputCols=raw, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        ]
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    model = Pipeline(stages=stages).fit(df)
    names = list(numeric)
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            for c, labels in zip(categories, stage.labelsArray):
                names += [f"{c}_{value}" for value in labels]
    return Preparation(model, names)


def encode_labels(df: DataFrame, label: str, output: str = "label_index") -> DataFrame:
    """Zero-based rank of the label text among the distinct labels, joined back to the rows."""
    from pyspark.sql import Window

    levels = df.select(col(label).cast("string").alias("level")).distinct()
    codes = levels.select("level", (F.row_number().over(Window.orderBy("level")) - 1).cast("long").alias(output))
    return df.join(codes, col(label).cast("string") == F.col("level"), "left").drop("level")


def prepared_frame(df: DataFrame, preparation: Transformer | Preparation, keep: Sequence[str]) -> DataFrame:
    return preparation.transform(df).select(*[col(c) for c in keep], FEATURES)
