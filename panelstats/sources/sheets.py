"""Reading and writing spreadsheet files (.xlsx) as a Python data source.

A folder of workbooks is one table: every file's first sheet, with the column names in its first
row.  A file is a partition; rows are parsed as a stream, and cells come as text, numbers as they
are stored and dates as ``yyyy-mm-dd`` (with a time where there is one), so that the cells a
spreadsheet has turned into dates reach the repair as what they are.  Writing gives a file per task
(more beyond the format's row limit), under temporary names until the whole job commits.

``spark.read.format("sheet").load(folder)`` after :func:`register`.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from panelstats.session import file_system, ship_package

MAX_ROWS = 1_048_575  # of a sheet, without the row of names

# --- fixed values: namespaces and the built-in date formats of the file format
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
    'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts>'
    '<fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


# --------------------------------------------------------------------------------- reading
def _position(reference: str) -> int:
    """Zero-based column of a cell reference such as ``AB12``."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _day(serial: float, from_1904: bool) -> str:
    """The date of a serial day number; days of the 1900 system before March count a day that
    never was."""
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) if serial >= 60 else datetime(1899, 12, 31)
    t = start + timedelta(seconds=round(serial * 86400))
    return t.strftime("%Y-%m-%d") if (t.hour, t.minute, t.second) == (0, 0, 0) else t.strftime("%Y-%m-%d %H:%M:%S")


def _is_date_format(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return bool(re.search(r"[dmyhs]", bare, re.I)) and "General" not in code


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if _is_date_format(f.get("formatCode", ""))}
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _text_of(element) -> str:
    """Text of a string item without its phonetic hints."""
    return "".join(t.text or "" for run in element for t in ([run] if run.tag == f"{_MAIN}t" else run.findall(f"{_MAIN}t") if run.tag == f"{_MAIN}r" else ()))


def _first_sheet(book: zipfile.ZipFile) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    rid = next(root.iter(f"{_MAIN}sheet")).get(_RELATION)
    for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == rid:
            target = r.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("the workbook names no sheet")


def sheet_rows(file) -> Iterator[list[str | None]]:
    """Rows of the first sheet of a workbook as text; empty cells are None."""
    with zipfile.ZipFile(file) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == f"{_MAIN}si":
                        shared.append(_text_of(e))
                        e.clear()
        dates = _date_styles(book)
        about = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
        from_1904 = about is not None and about.get("date1904") in ("1", "true")

        def value(cell) -> str | None:
            kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
            if kind == "inlineStr":
                inline = cell.find(f"{_MAIN}is")
                return None if inline is None else _text_of(inline)
            if v is None or v.text is None or kind == "e":
                return None
            if kind == "s":
                return shared[int(v.text)]
            if kind == "n" and int(cell.get("s", 0)) in dates:
                return _day(float(v.text), from_1904)
            return {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else v.text

        with book.open(_first_sheet(book)) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{_MAIN}row":
                    row: list[str | None] = []
                    for i, cell in enumerate(e.findall(f"{_MAIN}c")):
                        at = _position(cell.get("r")) if cell.get("r") else len(row)
                        row += [None] * (at - len(row))
                        row.append(value(cell))
                    yield row
                    e.clear()


def column_names(header: list[str | None]) -> list[str]:
    """Names of the first row; unnamed columns and repeated names are numbered, as pandas does."""
    out: list[str] = []
    for i, name in enumerate(header):
        name = name if name not in (None, "") else f"Unnamed: {i}"
        k, one = 0, name
        while one in out:
            k += 1
            one = f"{name}.{k}"
        out.append(one)
    return out


def _files(uri: str) -> list[str]:
    store, path = file_system(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(path))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".xlsx") and f.base_name[0] not in "._~")


@dataclass
class _File(InputPartition):
    path: str


class SheetReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.uri = schema.names, options["path"]

    def partitions(self) -> list[_File]:
        return [_File(p) for p in _files(self.uri)]

    def read(self, partition: _File) -> Iterator[tuple]:
        store, _ = file_system(self.uri)
        with store.open_input_file(partition.path) as f:
            rows = sheet_rows(f)
            place = {name: i for i, name in enumerate(column_names(next(rows, [])))}
            at = [place.get(n, -1) for n in self.names]
            for row in rows:
                if any(c is not None for c in row):
                    yield tuple(row[i] if 0 <= i < len(row) else None for i in at)


# --------------------------------------------------------------------------------- writing
def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, k = divmod(i - 1, 26)
        out = chr(65 + k) + out
    return out


def _cell(reference: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{reference}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, Decimal)) or (isinstance(v, float) and v == v and abs(v) != float("inf")):
        return f'<c r="{reference}"><v>{v!r}</v></c>' if not isinstance(v, Decimal) else f'<c r="{reference}"><v>{v}</v></c>'
    if isinstance(v, float):
        return ""
    if isinstance(v, (date, datetime)) and v.year >= 1901:
        t = v.replace(tzinfo=None) if isinstance(v, datetime) else datetime(v.year, v.month, v.day)
        days = (t - datetime(1899, 12, 30)) / timedelta(days=1)
        return f'<c r="{reference}" s="{2 if isinstance(v, datetime) else 1}"><v>{days!r}</v></c>'
    # characters that XML cannot hold are left out
    text = re.sub("[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]", "", str(v))
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</t></is></c>'


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SheetWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.uri, self.overwrite = schema.names, options["path"], overwrite
        self.rows = int(options.get("maxrows", MAX_ROWS))

    def write(self, iterator) -> _Written:
        store, folder = file_system(self.uri)
        store.create_dir(folder, recursive=True)
        done, part, row = [], None, next(iterator, None)
        while row is not None:
            name = f"{folder}/_temporary-{uuid.uuid4().hex}"
            with store.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
                for path, text in _PARTS.items():
                    book.writestr(path, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
                with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                    f.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                    letters, n = [_letters(i) for i in range(len(self.names))], 1
                    cells = "".join(_cell(f"{c}1", v) for c, v in zip(letters, self.names))
                    f.write(f'<row r="1">{cells}</row>'.encode())
                    while row is not None and n <= self.rows:
                        n += 1
                        cells = "".join(_cell(f"{c}{n}", v) for c, v in zip(letters, row))
                        f.write(f'<row r="{n}">{cells}</row>'.encode())
                        row = next(iterator, None)
                    f.write(b"</sheetData></worksheet>")
            done.append((name, f"{folder}/part-{uuid.uuid4().hex}.xlsx"))
        return _Written(done)

    def commit(self, messages) -> None:
        store, _ = file_system(self.uri)
        old = _files(self.uri) if self.overwrite and messages else []
        for m in messages:
            for temporary, final in m.files if m else ():
                store.move(temporary, final)
        for path in old:
            store.delete_file(path)

    def abort(self, messages) -> None:
        store, _ = file_system(self.uri)
        for m in messages:
            for temporary, _final in m.files if m else ():
                store.delete_file(temporary)


class SheetSource(DataSource):
    """The data source ``sheet``; option ``path`` is a folder of workbooks or one file."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> StructType:
        """Text columns named by the first row of the first workbook."""
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no workbook in {self.options['path']}")
        store, _ = file_system(self.options["path"])
        with store.open_input_file(files[0]) as f:
            return StructType([StructField(n, StringType()) for n in column_names(next(sheet_rows(f), []))])

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(SheetSource)


def read_sheets(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The workbooks of a folder (or one file) as a table of text cells; with a ``schema`` of text
    columns, those columns by name."""
    register(spark)
    reader = spark.read.format("sheet")
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_sheets(df: DataFrame, path: str, mode: str = "overwrite", **options) -> str:
    """Write a table as workbooks, one per task and row limit; returns the folder."""
    register(df.sparkSession)
    df.write.format("sheet").mode(mode).options(**options).save(path)
    return path
