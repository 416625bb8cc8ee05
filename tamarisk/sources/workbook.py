"""Spreadsheet workbooks (xlsx) as a data source: every workbook of a folder is read by tasks of its own, every task writes a part.

A workbook is a zip of XML parts. Rows are streamed out of a sheet's part, so that a task holds its workbook's shared texts and a
batch of rows, never a whole sheet. Register it once for a session (``register``), then ``spark.read.format("workbook")`` and
``df.write.format("workbook")``.
"""

from __future__ import annotations

import datetime as dt
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

#: Namespaces of the format, numbers of its built-in date formats, rows and characters that a sheet and a cell may have.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
DATES = {14, 15, 16, 17, 22, 27, 30, 36, 45, 46, 47, 50, 57}
SHEET_ROWS, CELL_CHARACTERS = 1_048_576, 32_767
#: Days are counted from here.
EPOCH = dt.datetime(1899, 12, 30)
#: Characters that XML has no place for; the format writes them as _xHHHH_.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_CODED = re.compile("_x([0-9A-Fa-f]{4})_")
#: Rows of an Arrow batch.
BATCH = 2000


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def column_number(ref: str) -> int:
    """0 for A, 25 for Z, 26 for AA: the column of a cell reference."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _plain(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text)


def _texts(element) -> str:
    """The text of a shared or inline string; runs are joined, hints on pronunciation left out."""
    parts = []
    for child in element:
        if child.tag == _tag("t"):
            parts.append(child.text or "")
        elif child.tag == _tag("r"):
            parts += [t.text or "" for t in child.findall(_tag("t"))]
    return _plain("".join(parts))


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets of a workbook, in their order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_tag("sheet")):
        target = links[s.get(f"{{{RELATIONS}}}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == _tag("si"):
                out.append(_texts(e))
                e.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = set()
    for f in root.iter(_tag("numFmt")):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode") or "")
        if re.search("[dmyhs]", code, re.IGNORECASE):
            own.add(int(f.get("numFmtId")))
    cells = root.find(_tag("cellXfs"))
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId") or 0) in DATES | own}


def _number(text: str) -> str:
    """A stored number as text: whole numbers without a fraction."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _moment(text: str) -> str:
    """A stored number of days as a date, or as a date and time if it isn't whole."""
    at = EPOCH + dt.timedelta(milliseconds=round(float(text) * 86_400_000))
    return at.date().isoformat() if at.time() == dt.time() else at.isoformat(sep=" ", timespec="seconds")


def _value(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t") or "n"
    if kind == "inlineStr":
        inline = cell.find(_tag("is"))
        return _texts(inline) if inline is not None else None
    text = cell.findtext(_tag("v"))
    if text is None:
        return None
    if kind == "s":
        return shared[int(text)]
    if kind == "b":
        return "true" if text.strip() == "1" else "false"
    if kind in ("str", "e", "d"):
        return _plain(text)
    try:
        return _moment(text) if int(cell.get("s") or 0) in dates else _number(text)
    except (ValueError, OverflowError):
        return text


def rows_of(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of one sheet (the first, if none is named) as texts; rows that the file leaves out are left out here too. A sheet
    that isn't there has no rows."""
    with zipfile.ZipFile(path) as book:
        part = next((p for n, p in sheets(book) if sheet in (None, n)), None)
        if part is None:
            return
        shared, dates = _shared(book), _date_styles(book)
        with book.open(part) as f:
            events = ElementTree.iterparse(f, events=("start", "end"))
            data = None
            for event, e in events:
                if event == "start":
                    data = e if e.tag == _tag("sheetData") else data
                elif e.tag == _tag("row"):
                    row: list[str | None] = []
                    for cell in e.findall(_tag("c")):
                        at = column_number(cell.get("r")) if cell.get("r") else len(row)
                        row += [None] * (at + 1 - len(row))
                        row[at] = _value(cell, shared, dates)
                    yield row
                    data.clear()


def _local(path: str) -> str:
    """The path of a mounted folder; the parts of a zip need a file that can be sought in."""
    found = re.match(r"file:/*(/.*)$", path)
    if not found and "://" in path:
        raise ValueError(f"workbooks are read and written through a mounted folder, not {path}")
    return found[1] if found else path


def files(path: str) -> list[str]:
    """The workbooks at a path, in order of their names; files that are being written, or hidden, aren't among them."""
    path = _local(path)
    if os.path.isfile(path):
        return [path]
    names = sorted(os.listdir(path)) if os.path.isdir(path) else []
    return [os.path.join(path, n) for n in names if n.endswith(".xlsx") and n[0] not in "._~"]


def _header(path: str, options) -> tuple[list[str], int]:
    """The names of the columns, and how many rows stand before the first one of data. A row whose first cell begins with the option
    ``meta`` is skipped; nameless columns and repeated names get a number."""
    meta, top = options.get("meta"), None
    for skip, row in enumerate(rows_of(path, options.get("sheet"))):
        if skip == 0 and meta and (row[0] if row else None) and row[0].lstrip("﻿").startswith(meta):
            continue
        top = row
        break
    if top is None:
        return [], 0
    names: list[str] = []
    for i, c in enumerate(top):
        name = (c or "").strip() or f"_c{i}"
        names.append(name if name.lower() not in {x.lower() for x in names} else f"{name}_{i}")
    return names, skip + 1


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.names, self.options = schema.names, options

    def partitions(self) -> list[_File]:
        return [_File(p) for p in files(self.options["path"])]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        found, skip = _header(partition.path, self.options)
        place = {n: i for i, n in enumerate(found)}
        at = [place.get(n) for n in self.names]
        out: list[list[str | None]] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(list(c), pa.string()) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays(columns, self.names)

        for i, row in enumerate(rows_of(partition.path, self.options.get("sheet"))):
            own = [row[k] if k is not None and k < len(row) else None for k in at]
            if i < skip or all(c is None for c in own):
                continue
            out.append(own)
            if len(out) == BATCH:
                yield batch()
                out = []
        if out:
            yield batch()


class _Part(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


def _cell(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        # Numbers of the format are doubles: longer ones stay texts.
        if not isinstance(value, int) or abs(value) < 10**15:
            return f'<c r="{ref}"><v>{value!r}</v></c>'
    if isinstance(value, dt.datetime):
        value = value.replace(tzinfo=None)
        if value >= dt.datetime(1900, 3, 1) and not value.microsecond:
            return f'<c r="{ref}" s="2"><v>{(value - EPOCH) / dt.timedelta(days=1)!r}</v></c>'
    elif isinstance(value, dt.date) and value >= dt.date(1900, 3, 1):
        return f'<c r="{ref}" s="1"><v>{(value - EPOCH.date()).days}</v></c>'
    text = str(value)
    if len(text) > CELL_CHARACTERS:
        raise ValueError(f"a cell holds {CELL_CHARACTERS} characters at most, this text has {len(text)}")
    text = escape(_NO_XML.sub(lambda m: f"_x{ord(m[0]):04X}_", text))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _frame(sheet: str) -> dict[str, str]:
    """The parts of a workbook of one sheet, but for the sheet itself."""
    office, sheetml = "application/vnd.openxmlformats-officedocument.spreadsheetml", f"{RELATIONS}"
    name = escape(sheet, {'"': "&quot;"})
    return {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/>'
        f'<Override PartName="/xl/styles.xml" ContentType="{office}.styles+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{office}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{sheetml}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name="{name}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{sheetml}/worksheet" Target="worksheets/sheet1.xml"/>'
        f'<Relationship Id="r2" Type="{sheetml}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/>'
        '<xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }


def sheet_name(name: str) -> str:
    """A name as the format wants it: 31 characters, without those that references use."""
    return re.sub(r"[\[\]:*?/\\]", " ", name).strip("' ")[:31] or "Sheet1"


class _Writer(DataSourceWriter):
    """Tasks write hidden files; the commit gives them their names, so that lost or repeated tasks leave nothing to be read."""

    def __init__(self, schema: StructType, options, overwrite: bool):
        self.names, self.options, self.overwrite = schema.names, options, overwrite
        self.path, self.run = _local(options["path"]), uuid.uuid4().hex
        self.rows = min(int(options.get("rows", SHEET_ROWS - 2)), SHEET_ROWS - 2)

    def write(self, rows) -> _Part:
        os.makedirs(self.path, exist_ok=True)
        made, rows = [], iter(rows)
        letters = [column_letters(i) for i in range(len(self.names))]
        row = next(rows, None)
        while row is not None:
            name = f".{self.run}-{uuid.uuid4().hex}"
            with zipfile.ZipFile(os.path.join(self.path, name), "w", zipfile.ZIP_DEFLATED) as book:
                for part, body in _frame(sheet_name(self.options.get("sheet", "Sheet1"))).items():
                    book.writestr(part, _HEAD + body)
                with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                    f.write(f'{_HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                    nth = 0

                    def put(cells) -> None:
                        inner = "".join(_cell(f"{c}{nth}", v) for c, v in zip(letters, cells, strict=True))
                        f.write(f'<row r="{nth}">{inner}</row>'.encode())

                    if self.options.get("meta"):
                        nth += 1
                        f.write(f'<row r="{nth}">{_cell(f"A{nth}", self.options["meta"])}</row>'.encode())
                    nth += 1
                    put(self.names)
                    left = self.rows
                    while row is not None and left:
                        nth += 1
                        put(row)
                        left -= 1
                        row = next(rows, None)
                    f.write(b"</sheetData></worksheet>")
            made.append(name)
        return _Part(made)

    def commit(self, messages: list[_Part | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = files(self.path) if self.overwrite else []
        made = [n for m in messages if m for n in m.names]
        for i, name in enumerate(made):
            os.replace(os.path.join(self.path, name), os.path.join(self.path, f"part-{i:05d}-{self.run}.xlsx"))
        for path in old:
            os.remove(path)

    def abort(self, messages: list[_Part | None]) -> None:
        for n in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if n.startswith(f".{self.run}-"):
                os.remove(os.path.join(self.path, n))


class Workbook(DataSource):
    """Options: ``path`` of a workbook or a folder of them, ``sheet``, ``meta`` (the start of a line above the header), and for
    writing ``rows`` of a workbook at most. All columns are read as text; without a schema, the first workbook's header is it.
    A workbook is one partition. Columns are found by name in each workbook: those that one lacks are null there."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        found = files(self.options["path"])
        if not found:
            raise ValueError(f"no workbook at {self.options['path']}")
        return StructType([StructField(n, StringType()) for n in _header(found[0], self.options)[0]])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Workbook)
    return spark


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, meta: str | None = None) -> DataFrame:
    """The rows of one sheet of a workbook, or of all workbooks of a folder, as text; rows without any value are dropped."""
    given = {k: v for k, v in (("sheet", sheet), ("meta", meta)) if v}
    return register(spark).read.format("workbook").options(**given).load(path)


def write_workbooks(df: DataFrame, path: str, sheet: str = "Sheet1", meta: str | None = None, mode: str = "append", rows: int | None = None) -> None:
    """One workbook for each partition that has rows, split where a sheet is full (or at ``rows``); a folder that can be read as one.
    Numbers, booleans, dates and times become typed cells, everything else text."""
    register(df.sparkSession)
    given = {k: v for k, v in (("sheet", sheet), ("meta", meta), ("rows", rows)) if v}
    df.write.format("workbook").mode(mode).options(**given).save(path)
