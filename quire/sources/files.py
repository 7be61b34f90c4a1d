"""Spreadsheets and tagged text as DataFrames.

A workbook is a zip archive and can't be split, so each is one task's; many spread over the
cluster.  Tagged text is read in splits: one file of any size spreads, too.
"""

from __future__ import annotations

import difflib
import io
import re
import tempfile
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

WORKS_HEADERS = {"Cat No": True, "Gallery": False, "Title": True, "Artist": True, "Price": False, "Edition": False, "Artwork": False, "Medium": False}
INDEX_HEADERS = {"Title": False, "First Name": False, "Last Name": True, "Quals": False, "Company": False, "Address 1": False, "Cat Nos": True}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _number(text: str) -> str:
    """A cell's number as text: whole numbers without a fraction."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The active sheet's rows with cached values; text that a style marks as quoted regains its apostrophe."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        read = lambda name: ET.fromstring(book.read(name)) if name in names else None
        shared = [("".join(t.text or "" for t in si.iter(f"{_MAIN}t"))) for si in read("xl/sharedStrings.xml") or ()] if "xl/sharedStrings.xml" in names else []
        styles = read("xl/styles.xml")
        formats = styles.find(f"{_MAIN}cellXfs") if styles is not None else None
        quoted = [xf.get("quotePrefix") in ("1", "true") for xf in formats] if formats is not None else []
        workbook, rels = read("xl/workbook.xml"), read("xl/_rels/workbook.xml.rels")
        view = workbook.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
        sheets = workbook.find(f"{_MAIN}sheets")
        sheet = sheets[min(int(view.get("activeTab", 0)) if view is not None else 0, len(sheets) - 1)]
        target = next(r.get("Target") for r in rels if r.get("Id") == sheet.get(_REL))
        data = read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        at = 0
        for row in data.find(f"{_MAIN}sheetData"):
            number = int(row.get("r", at + 1))
            for _ in range(at + 1, number):
                yield []
            at, cells = number, []
            for k, cell in enumerate(row):
                place = _column(cell.get("r")) if cell.get("r") else k
                cells.extend([None] * (place + 1 - len(cells)))
                kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
                text = None
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif v is not None and v.text is not None:
                    text = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "e") else ("True" if v.text == "1" else "False") if kind == "b" else _number(v.text)
                style = int(cell.get("s", 0))
                if text is not None and kind in ("s", "str", "inlineStr") and style < len(quoted) and quoted[style]:
                    text = "'" + text
                cells[place] = text
            yield cells


def read_workbooks(spark: SparkSession, path: str, skip_blank: bool = False, expected: dict[str, bool] | None = None) -> DataFrame:
    """(path, row_number, cells): all rows below the header, cells by header name as a map.

    With ``expected`` headers (name: whether it is required), a file without a required one is
    an error; ``header_report`` tells before.  ``skip_blank`` leaves out rows whose expected
    cells (all cells where nothing is expected) are empty.
    """

    def parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            for name, content in zip(part["path"], part["content"]):
                rows, head = [], None
                for number, cells in enumerate(sheet_rows(bytes(content)), 1):
                    if head is None:
                        head = [(c or "").strip() for c in cells]
                        if expected and (missing := header_problems(head, expected)[0]):
                            raise ValueError(f"{name} lacks {', '.join(missing)}")
                        continue
                    own = {h: c for h, c in zip(head, cells + [None] * len(head)) if h}
                    if not skip_blank or any(v for h, v in own.items() if not expected or h in expected):
                        rows.append((name, number, own))
                yield pd.DataFrame(rows, columns=["path", "row_number", "cells"])

    return _workbooks(spark, path).mapInPandas(parse, "path string, row_number long, cells map<string,string>")


def _workbooks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def header_report(spark: SparkSession, path: str, expected: dict[str, bool]) -> DataFrame:
    """(path, type, message): headers that files lack, ``missing_required`` or ``missing_column``, and ``empty_spreadsheet``."""

    def report(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            rows = []
            for name, content in zip(part["path"], part["content"]):
                sheet = sheet_rows(bytes(content))
                missing, optional = header_problems([(c or "").strip() for c in next(sheet, [])], expected)
                rows += [(name, "missing_required", m) for m in missing] + [(name, "missing_column", m) for m in optional]
                rows += [] if next(sheet, None) is not None else [(name, "empty_spreadsheet", "")]
            yield pd.DataFrame(rows, columns=["path", "type", "message"])

    return _workbooks(spark, path).mapInPandas(report, "path string, type string, message string")


def header_problems(headers: list[str], expected: dict[str, bool]) -> tuple[list[str], list[str]]:
    """Messages for missing required headers, with a close match if there is one, and the missing optional headers."""
    missing, optional = [], []
    for name, required in expected.items():
        if name not in headers:
            if required:
                near = difflib.get_close_matches(name, headers, n=1, cutoff=0.6)
                missing.append(f"{name}" + (f" (is it {near[0]}?)" if near else ""))
            else:
                optional.append(name)
    return missing, optional


_HIGH = bytes(range(128, 256))
_LATIN, _MAC = _HIGH.decode("latin-1"), _HIGH.decode("mac_roman")
#: What ends a paragraph of the long tags, and what begins one of the short ones.
LONG, SHORT = "\r", "<pstyle:"


def decoded_bytes(raw: Column, encoding: str = "mac_roman") -> Column:
    """Text from the bytes of a string column, without Python: Mac Roman, Latin-1 or UTF-8."""
    if encoding == "utf-8":
        return raw
    latin = F.decode(raw.cast("binary"), "ISO-8859-1")
    return F.translate(latin, _LATIN, _MAC) if encoding == "mac_roman" else latin


def encoded_bytes(text: Column) -> Column:
    """A string column whose bytes are the text in Mac Roman; it must have no other characters (see ``unicode.mac_roman``)."""
    return F.encode(F.translate(text, _MAC, _LATIN), "ISO-8859-1").cast("string")


def read_tagged_text(spark: SparkSession, path: str, encoding: str = "mac_roman", short: bool = False) -> DataFrame:
    """(path, ord, paragraph): paragraphs of tagged text files, which Spark reads in splits.

    Paragraphs of the long tags end at a carriage return, those of the ``short`` ones begin at
    their tag, and the reader splits files there; ``tagged_dialects`` tells which files have.
    ``ord`` grows along a file without being dense: where a split starts, and the row in its task.
    A task's rows are never more than its bytes and a file's full splits have tasks of their
    own, so no split's rows reach the next one's start.  ``spark.sql.files.maxPartitionNum``, which packs full
    splits together, must be unset for that.
    """
    if spark.conf.get("spark.sql.files.maxPartitionNum", None):
        raise ValueError("spark.sql.files.maxPartitionNum must be unset: places in files count on it")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.option("lineSep", SHORT if short else LONG).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") + row).alias("ord"), decoded_bytes(F.col("value"), encoding).alias("paragraph"))
    if short:  # what is before the first tag is the file's heading
        headed = F.col("paragraph").rlike(r"^\s*(?:<[A-Z0-9]+-[A-Z]+>\s*)?$")
        return rows.withColumn("paragraph", F.when(headed, F.col("paragraph")).otherwise(F.concat(F.lit(SHORT), "paragraph")))
    return rows.withColumn("paragraph", F.regexp_replace("paragraph", r"^\n|\n$", ""))


def tagged_dialects(spark: SparkSession, path: str) -> DataFrame:
    """(path, short): which tagged text files have the short tags."""
    lines = spark.read.option("lineSep", LONG).text(path)
    return lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.max(F.col("value").rlike("<(?:pstyle|cstyle):")).alias("short"))


def read_document(spark: SparkSession, path: str, encoding: str = "mac_roman", short: bool = False) -> DataFrame:
    """(document, ord, paragraph): the files below a path as one document, in order of their names."""
    rows = read_tagged_text(spark, path, encoding, short)
    files = rows.select("path").distinct()
    places = files.select(F.col("path").alias("_path"), F.row_number().over(Window.orderBy("path")).cast("long").alias("_place"))  # one row a file
    return rows.join(places, F.col("path") == F.col("_path")).select(F.lit(path).alias("document"), (F.col("_place") * F.lit(1 << 42) + F.col("ord")).alias("ord"), "paragraph")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; where it is unset and Spark runs on this machine alone, in one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
