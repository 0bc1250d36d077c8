"""Delimited text tables with detected charset, delimiter and header; all cells arrive as text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BLANK_HEADER_PREFIX, DELIMITERS
from ..errors import TableError
from .files import charsets, raw_lines, require_charsets


def normalise_headers(values: Iterable[str | None]) -> list[str]:
    """Distinct column names: trimmed, blanks named by their position. Of columns with the same name the first
    keeps it and the others take the lowest number from 2 on that no column has: ``a, a, a_2`` is ``a, a_3, a_2``."""
    trimmed = [re.sub(r"^[\s\ufeff]+|\s+$", "", value or "") for value in values]
    named = [name or f"{BLANK_HEADER_PREFIX}{place}" for place, name in enumerate(trimmed, start=1)]
    used, owner = set(named), {name: place for place, name in reversed(list(enumerate(named)))}
    numbers = {name: count(2) for name, times in Counter(named).items() if times > 1}
    for place, name in enumerate(named):
        if owner[name] != place:
            named[place] = next(free for n in numbers[name] if (free := f"{name}_{n}") not in used)
    return named


def delimiter_scores(lines: DataFrame) -> DataFrame:
    """(path, delimiter, per_line, share): the most common non-zero count per line and its share.

    ``lines`` has (path, line). Counting is a grouped aggregate over (file, delimiter, count), whose
    groups are few however long the file is.
    """
    candidates = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter"), (F.length("line") - F.length(F.replace("line", F.lit(d)))).alias("n"))
            for i, d in enumerate(DELIMITERS)
        ]
    )
    counted = (
        lines.filter(F.length("line") > 0)
        .select("path", F.explode(candidates).alias("c"))
        .groupBy("path", "c.rank", "c.delimiter", "c.n")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    per_delimiter = counted.groupBy("path", "rank", "delimiter").agg(
        F.max_by("n", F.struct(F.when(F.col("n") > 0, F.col("lines")).otherwise(0), "n")).alias("per_line"),
        F.max(F.when(F.col("n") > 0, F.col("lines")).otherwise(0)).alias("best"),
        F.sum("lines").alias("total"),
    )
    return per_delimiter.select("path", "rank", "delimiter", "per_line", (F.col("best") / F.col("total")).alias("share"))


def delimiters(lines: DataFrame) -> DataFrame:
    """(path, delimiter): the most constant candidate, then the more frequent one; comma if none occurs."""
    usable = F.struct("share", "per_line", (-F.col("rank")).alias("r"))
    return (
        delimiter_scores(lines)
        .groupBy("path")
        .agg(F.max_by("delimiter", usable).alias("d"), F.max("share").alias("s"))
        .select("path", F.when(F.col("s") > 0, F.col("d")).otherwise(",").alias("delimiter"))
    )


def _decoder(charset: str):
    @F.pandas_udf(T.StringType())
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: b.decode(charset, errors="replace"))

    return decode


@dataclass(frozen=True)
class Layout:
    charset: str
    delimiter: str
    multiline: bool


def file_layouts(spark: SparkSession, paths: str | list[str]) -> dict[Layout, list[str]]:
    """Files grouped by how they have to be read. One row per file reaches the driver, as in any file listing."""
    files = require_charsets(charsets(spark, paths))
    layouts: dict[Layout, list[str]] = {}
    for charset in sorted({c for _, c in files}):
        members = [p for p, c in files if c == charset]
        if charset.startswith("UTF-16"):
            lines = spark.read.option("encoding", charset).option("lineSep", "\n").csv(members, sep="\u0001", quote="").select(
                F.col("_metadata.file_path").alias("path"), F.coalesce("_c0", F.lit("")).alias("line")
            )
        else:
            lines = raw_lines(spark, members)
            if charset != "UTF-8":
                lines = lines.withColumn("line", _decoder(charset)("bytes"))
        quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
        open_quote = lines.groupBy("path").agg(F.bool_or(quotes % 2 == 1).alias("multiline"))
        for row in delimiters(lines).join(open_quote, "path").collect():
            layouts.setdefault(Layout(charset, row["delimiter"], bool(row["multiline"])), []).append(row["path"])
    return layouts


def _reader(spark: SparkSession, layout: Layout):
    reader = (
        spark.read.option("sep", layout.delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("encoding", layout.charset)
        .option("maxCharsPerColumn", "-1")
        .option("multiLine", layout.multiline)
    )
    # quoted cells may span lines; only files that contain such cells give up being split
    return reader if layout.multiline else reader.option("lineSep", "\n")


def read_delimited(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One table of text columns over all files, which must share the header.

    Short rows are padded with nulls, extra cells are dropped. Files in different charsets or with
    different delimiters are read by their own scan and put together.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    parts, names = [], None
    for layout, members in sorted(file_layouts(spark, paths).items(), key=lambda kv: kv[1][0]):
        head = _reader(spark, layout).csv(members[:1]).limit(1).collect()
        if not head:
            raise TableError("a delimited file holds no rows", file=members[0])
        found = normalise_headers([v.rstrip("\r") if v else v for v in head[0]])
        if names is None:
            names = found
        elif found != names:
            raise TableError("the files have different headers", expected=names, found=found)
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(found))])
        frame = _reader(spark, layout).option("header", True).option("enforceSchema", True).schema(schema).csv(members)
        if not layout.multiline:
            last = F.regexp_replace(f"c{len(found) - 1}", "\r$", "")
            frame = frame.withColumn(f"c{len(found) - 1}", last)
        parts.append(frame.toDF(*found))
    if not parts:
        raise TableError("no readable file was found")
    return reduce(DataFrame.unionByName, parts)
