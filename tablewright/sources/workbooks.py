"""Workbook sheets as rows of text cells; one task opens one workbook."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TableError
from .delimited import normalise_headers

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# number formats 14-22 and 45-47 are the built-in date and time formats
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}

SHEET_SCHEMA = "path string, sheet string, row_number long, cells array<string>"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    formats = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
    return {i for i, n in enumerate(ids) if n in _DATE_FORMATS or re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")), re.I)}


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    raw = cell.findtext(f"{_MAIN}v")
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind == "n":
        number = float(raw)
        if int(cell.get("s", 0)) in dates:
            return (datetime(1899, 12, 30) + timedelta(days=number)).isoformat()
        return str(int(number)) if number.is_integer() and "." not in raw else repr(number)
    return raw


def _sheet_rows(raw: bytes, wanted: str | None) -> Iterator[tuple[str, int, list[str | None]]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(_LINK)]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        name, target = next(((n, t) for n, t in sheets if wanted in (None, n)), sheets[0])
        dates = _date_styles(book)
        member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with book.open(member) as stream:
            for _, element in ElementTree.iterparse(stream):
                if element.tag == f"{_MAIN}row":
                    cells: dict[int, str | None] = {}
                    for cell in element.iter(f"{_MAIN}c"):
                        cells[_column(cell.get("r"))] = _value(cell, shared, dates)
                    yield name, int(element.get("r")), [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                    element.clear()


def read_sheets(spark: SparkSession, paths: str | list[str], sheet: str | None = None) -> DataFrame:
    """(path, sheet, row_number, cells) of the named or first sheet of every workbook."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                for name, number, cells in _sheet_rows(raw, sheet):
                    rows.append((path, name, number, cells))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=["path", "sheet", "row_number", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "sheet", "row_number", "cells"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(read, SHEET_SCHEMA)


def read_workbook(spark: SparkSession, paths: str | list[str], sheet: str | None = None) -> DataFrame:
    """One table of text columns; the first row of each sheet is the header and must be shared."""
    rows = read_sheets(spark, paths, sheet)
    headers = [r["cells"] for r in rows.filter("row_number = 1").select("cells").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise TableError("the workbooks need one common header row", headers=len(headers))
    names = normalise_headers(headers[0])
    data = rows.filter("row_number > 1")
    return data.select(*[F.get("cells", i).alias(n) for i, n in enumerate(names)])
