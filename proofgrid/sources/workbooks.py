"""Spreadsheet files as sheet rows: one file per task, rows streamed out in batches."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "workbook string, sheet string, row_idx bigint, values array<string>, error string"
BATCH_ROWS = 5_000

# Texts read as missing.
MISSING = {
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
}
# Number formats that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DATE_ORIGIN = datetime(1899, 12, 30)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(element) -> str:
    """Visible text of a string item; phonetic runs are left out."""
    parts = []
    for child in element:
        kind = _local(child.tag)
        if kind == "t":
            parts.append(child.text or "")
        elif kind == "r":
            parts.append(_text(child))
    return "".join(parts)


def _children(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else []


def _first_sheet(archive: zipfile.ZipFile) -> tuple[str, str]:
    book = _children(archive, "xl/workbook.xml")
    sheet = next(e for e in book.iter() if _local(e.tag) == "sheet")
    ref = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    for link in _children(archive, "xl/_rels/workbook.xml.rels"):
        if link.attrib["Id"] == ref:
            target = link.attrib["Target"]
            path = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
            return sheet.attrib["name"], posixpath.normpath(path)
    raise ValueError("first sheet not found")


def _shared_texts(archive: zipfile.ZipFile) -> list[str]:
    return [_text(e) for e in _children(archive, "xl/sharedStrings.xml") if _local(e.tag) == "si"]


def _date_styles(archive: zipfile.ZipFile) -> set[str]:
    custom, styles = set(), set()
    for element in _children(archive, "xl/styles.xml"):
        if _local(element.tag) == "numFmts":
            for f in element:
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.attrib.get("formatCode", ""))
                if re.search(r"[ymdhs]", code, re.IGNORECASE):
                    custom.add(int(f.attrib["numFmtId"]))
        if _local(element.tag) == "cellXfs":
            for i, xf in enumerate(element):
                if int(xf.attrib.get("numFmtId", 0)) in DATE_FORMATS | custom:
                    styles.add(str(i))
    return styles


def _number(raw: str, is_date: bool) -> str:
    value = float(raw)
    if is_date:
        return str(DATE_ORIGIN + timedelta(seconds=round(value * 86_400)))
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _column(reference: str) -> int:
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number - 1


def _cell_value(element, shared: list[str], dates: set[str]) -> str | None:
    kind = element.attrib.get("t", "n")
    raw = None
    for child in element:
        if _local(child.tag) == "v":
            raw = child.text
        elif _local(child.tag) == "is":
            raw = _text(child)
    if raw is None:
        return None
    if kind == "s":
        raw = shared[int(raw)]
    elif kind == "b":
        raw = "True" if raw == "1" else "False"
    elif kind == "n":
        raw = _number(raw, element.attrib.get("s") in dates)
    return None if raw in MISSING else raw


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list]]:
    """``(sheet, row_idx, values)`` of the first sheet, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        sheet, path = _first_sheet(archive)
        shared, dates = _shared_texts(archive), _date_styles(archive)
        number = -1
        with archive.open(path) as stream:
            for _, element in ElementTree.iterparse(stream):
                if _local(element.tag) != "row":
                    continue
                number = int(element.attrib.get("r", number + 2)) - 1
                values: list = []
                for cell in element:
                    at = _column(cell.attrib["r"]) if "r" in cell.attrib else len(values)
                    values.extend([None] * (at - len(values)))
                    values.append(_cell_value(cell, shared, dates))
                element.clear()
                yield sheet, number, values


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["workbook", "sheet", "row_idx", "values", "error"]
    for batch in batches:
        for name, content in zip(batch["path"], batch["content"]):
            waiting: list = []
            try:
                for sheet, number, values in sheet_rows(content):
                    waiting.append((name, sheet, number, values, None))
                    if len(waiting) >= BATCH_ROWS:
                        yield pd.DataFrame(waiting, columns=columns)
                        waiting = []
            except Exception as problem:  # a broken file becomes a row, the others go on
                waiting.append((name, None, None, None, f"{type(problem).__name__}: {problem}"))
            if waiting:
                yield pd.DataFrame(waiting, columns=columns)


def parse_workbooks(files: DataFrame) -> DataFrame:
    """Sheet rows of ``files(path, content)``; broken files give one row with ``error``."""
    return files.select("path", "content").mapInPandas(_parse, SCHEMA)


def read_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """All spreadsheet files of a folder; names that start with ``~`` are lock files."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
        .filter(~F.startswith(F.substring_index("path", "/", -1), F.lit("~")))
    )
    return parse_workbooks(files)


def good_rows(parsed: DataFrame) -> DataFrame:
    """Rows of the files that were read to their end.

    ``parsed`` is used twice here, so store it first (``plans.storage.stored``); every file is then
    parsed once.
    """
    broken = parsed.filter(F.col("error").isNotNull()).select("workbook")
    return parsed.filter(F.col("error").isNull()).join(broken, "workbook", "left_anti").select(
        "workbook", "row_idx", "values"
    )


def failed_files(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).select("workbook", "error")
