"""Workbooks as a data source, ``spark.read.format("workbook")``, and their writer.

A file is a task: the driver lists paths, and a task opens its file where it is, on any file
system that pyarrow knows.  Only the columns of the schema are built.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .files import INDEX_HEADERS, WORKS_HEADERS, header_problems, sheet_rows

LAYOUTS = {"works": WORKS_HEADERS, "index": INDEX_HEADERS}
#: Rows of one workbook; a sheet holds at most 1048576.
ROWS_MOST = 100_000


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else posixpath.abspath(path))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = [f.name for f in schema]
        self.expected = LAYOUTS.get(options.get("layout", ""))
        self.skip_blank = options.get("skipBlank", "false").lower() == "true"
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        system, path = _open(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path, recursive=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [_File(f"{scheme}{f.path}") for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".xlsx")] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        system, path = _open(partition.path)
        with system.open_input_stream(path) as stream:
            content = stream.read()
        head: list[str] = []
        for number, cells in enumerate(sheet_rows(content), 1):
            if number == 1:
                head = [(c or "").strip() for c in cells]
                if self.expected and (missing := header_problems(head, self.expected)[0]):
                    raise ValueError(f"{partition.path} lacks {', '.join(missing)}")
                places = {h: k for k, h in reversed(list(enumerate(head))) if h}
                continue
            if self.skip_blank and not any(cells[k] for h, k in places.items() if k < len(cells) and (not self.expected or h in self.expected)):
                continue
            own = {"path": partition.path, "row_number": number}
            yield tuple(own[n] if n in own else cells[places[n]] if n in places and places[n] < len(cells) else None for n in self.names)


class WorkbookSource(DataSource):
    """Rows of the active sheets below a path: path, row_number and a string column for each header of the layout.

    Options: ``layout`` (works or index), whose required headers are checked, and ``skipBlank``.
    A schema of one's own names the headers that are read; those that a file lacks are null.  Of
    equal headers the first counts.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        headers = LAYOUTS[self.options.get("layout", "works")]
        return StructType([StructField("path", StringType()), StructField("row_number", LongType()), *(StructField(h, StringType()) for h in headers)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def workbook(headers: list[str], rows: list[list[str | None]]) -> bytes:
    """A workbook of one sheet with texts in its cells; null is no cell."""

    def column(k: int) -> str:
        name = ""
        while k >= 0:
            k, name = k // 26 - 1, chr(65 + k % 26) + name
        return name

    def cell(ref: str, value: str) -> str:
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    lines = "".join(f'<row r="{n}">{"".join(cell(f"{column(k)}{n}", v) for k, v in enumerate(r) if v is not None)}</row>' for n, r in enumerate([headers, *rows], 1))
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}', zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_workbooks(rows: DataFrame, folder: str, order: str = "ord", most: int = ROWS_MOST) -> DataFrame:
    """Writes the columns of ``rows`` but ``order`` as workbooks of up to ``most`` values of ``order`` each; (name, rows) of each.

    A file has its name from what it holds and appears by a rename, so a task that runs again
    replaces its own file.
    """
    headers = [c for c in rows.columns if c != order]

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        system, base = _open(folder)
        system.create_dir(base)
        name = f"{key[0]:012d}.xlsx"
        cells = [[None if pd.isna(v) else str(v) for v in r] for r in part.sort_values(order)[headers].itertuples(index=False)]
        with system.open_output_stream(f"{base}/.{name}.new") as stream:
            stream.write(workbook(headers, cells))
        system.move(f"{base}/.{name}.new", f"{base}/{name}")
        return pd.DataFrame([(name, len(part))], columns=["name", "rows"])

    placed = rows.withColumn("_book", F.floor(F.col(order) / most))
    return placed.groupBy("_book").applyInPandas(lambda key, part: write(key, part), "name string, rows long")
