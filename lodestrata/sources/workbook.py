"""XLSX workbooks as tables, read and written from their XML with the standard library.

``spark.read.format("workbook")`` (after ``register``) gives a row for every row that holds a value:
path, sheet, row from 1, cells as text, their number formats, and an error for a file that cannot
be read. Small files share a partition, each sheet of a large one is a partition of its own.
Options: ``path`` (a file or folder), ``sheet`` (only this one), ``merged`` = ``fill`` (every cell of a
merged range has the range's value). ``df.write.format("workbook")`` writes a workbook a partition, and another
one for what a sheet does not hold.
The format reaches what pyarrow's file systems reach; for a store that only Spark reads,
``workbook_rows`` takes (path, content) rows as ``binaryFile`` gives them.

Bounds come from cells that hold a value; cells that only carry a format are ignored. A sheet is
passed twice, once for bounds, merged ranges and formats, once for its rows, and never held whole.
Whole numbers have no point; numbers with a date format are dates, or dates with times.
"""

from __future__ import annotations

import datetime
import io
import itertools
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, sheet string, row int, cells array<string>, error string"
FORMAT_SCHEMA = "path string, sheet string, row int, cells array<string>, formats array<string>, error string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats by id; those from 14 to 22 and 45 to 47 are dates and times.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
#: Bytes of small files in one partition; rows of one sheet at most.
PARTITION_BYTES, SHEET_ROWS = 8 << 20, 1 << 20


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isdigit():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _letters(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


def _text(node: ElementTree.Element | None) -> str:
    return "" if node is None else "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or time: a letter for one outside quotes, escapes and brackets."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0], flags=re.IGNORECASE)
    return bare.lower() != "general" and bool(re.search(r"[ymdhs]", bare, re.IGNORECASE))


def date_text(serial: float, from_1904: bool = False) -> str:
    """A serial number as ISO text: a date, or a date with its time if it has one."""
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
    at = start + datetime.timedelta(seconds=round(serial * 86400))
    return at.isoformat(sep=" ") if serial % 1 else at.date().isoformat()


@dataclass
class Sheet:
    """What a first pass finds: rows and width that hold values, and merged ranges (rows from 1, columns from 0)."""

    name: str
    part: str
    first: int = 0
    last: int = 0
    width: int = 0
    merged: list[tuple[int, int, int, int]] = field(default_factory=list)


class Workbook:
    """A workbook's parts; ``source`` is a file object that can seek."""

    def __init__(self, source) -> None:
        self.zip = zipfile.ZipFile(source)
        names = self.zip.namelist()
        self.shared = [_text(si) for si in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        properties = book.find(f"{_MAIN}workbookPr")
        self.from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.parts = [(s.get("name", ""), self._part(targets[s.get(_REL)])) for s in book.iter(f"{_MAIN}sheet")]
        self.formats = self._formats() if "xl/styles.xml" in names else ["General"]
        self.dates = [is_date_format(code) for code in self.formats]

    @staticmethod
    def _part(target: str) -> str:
        target = target.replace("../", "").lstrip("/")
        return target if target.startswith("xl/") else f"xl/{target}"

    def _formats(self) -> list[str]:
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(n.get("numFmtId", 0)): n.get("formatCode", "General") for n in styles.iter(f"{_MAIN}numFmt")}
        cells = styles.find(f"{_MAIN}cellXfs")
        return [own.get(i, BUILT_IN.get(i, "General")) for i in (int(x.get("numFmtId", 0)) for x in (() if cells is None else cells))] or ["General"]

    def _rows(self, part: str) -> Iterator[ElementTree.Element]:
        """Row and mergeCell elements in order; rows are emptied once they have been looked at."""
        with self.zip.open(part) as f:
            for event, node in ElementTree.iterparse(f, events=("start", "end")):
                if event == "start" and node.tag == f"{_MAIN}sheetData":
                    data = node
                if event == "end" and node.tag in (f"{_MAIN}row", f"{_MAIN}mergeCell"):
                    yield node
                    if node.tag == f"{_MAIN}row":
                        data.clear()

    def value(self, cell: ElementTree.Element) -> tuple[str | None, str]:
        """A cell's text and number format."""
        kind, v, style = cell.get("t"), cell.find(f"{_MAIN}v"), int(cell.get("s", 0))
        code, date = (self.formats[style], self.dates[style]) if style < len(self.formats) else ("General", False)
        if kind == "inlineStr":
            return _text(cell.find(f"{_MAIN}is")) or None, code
        if v is None or v.text is None:
            return None, code
        if kind == "s":
            return self.shared[int(v.text)], code
        if kind == "b":
            return ("TRUE" if v.text == "1" else "FALSE"), code
        if kind in (None, "n"):
            try:
                number = float(v.text)
                if date:
                    return date_text(number, self.from_1904), code
            except (ValueError, OverflowError):
                return v.text, code
            return (str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)), code
        return v.text, code

    def cells(self, node: ElementTree.Element) -> dict[int, tuple[str, str]]:
        found, at = {}, -1
        for c in node:
            at = _column(c.get("r")) if c.get("r") else at + 1
            value, code = self.value(c)
            if value is not None:
                found[at] = (value, code)
        return found

    def sheet(self, name: str, part: str) -> Sheet:
        out, n = Sheet(name, part), 0
        for node in self._rows(part):
            if node.tag == f"{_MAIN}mergeCell":
                ends = re.match(r"([A-Za-z]+)([0-9]+):([A-Za-z]+)([0-9]+)$", node.get("ref", ""))
                if ends:
                    out.merged.append((int(ends[2]), int(ends[4]), _column(ends[1]), _column(ends[3])))
                continue
            n = int(node.get("r", n + 1))
            if found := self.cells(node):
                out.first, out.last, out.width = out.first or n, n, max(out.width, max(found) + 1)
        return out

    def rows(self, sheet: Sheet, fill: bool = False) -> Iterator[tuple[int, list[str | None], list[str | None]]]:
        """(row, cells, formats) of every row that holds a value; with ``fill`` merged ranges are filled from their first cell."""
        tops: dict[tuple[int, int], tuple[str, str]] = {}
        ranges, n, width = (sheet.merged if fill else []), 0, max([sheet.width, *(m[3] + 1 for m in sheet.merged if fill and m[0] <= sheet.last)], default=0)
        for node in self._rows(sheet.part):
            if node.tag != f"{_MAIN}row":
                continue
            n = int(node.get("r", n + 1))
            found = self.cells(node)
            for top, bottom, left, right in ranges:
                if top <= n <= bottom:
                    if n == top and left in found:
                        tops[top, left] = found[left]
                    if (top, left) in tops:
                        found |= {c: tops[top, left] for c in range(left, right + 1)}
            ranges = [m for m in ranges if m[1] > n]
            if found:
                yield n, [found.get(i, (None,))[0] for i in range(width)], [found[i][1] if i in found else None for i in range(width)]


def sheets(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells) of every row that holds a value."""
    book = Workbook(io.BytesIO(content))
    for name, part in book.parts:
        for n, cells, _ in book.rows(book.sheet(name, part)):
            yield name, n, cells


UNREADABLE = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError)


def workbook_rows(files: DataFrame) -> DataFrame:
    """``SCHEMA`` rows of all workbooks in ``files`` (path, content)."""
    kind = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [{"path": path, "sheet": s, "row": n, "cells": c, "error": None} for s, n, c in sheets(content)]
                except UNREADABLE as x:
                    rows = [{"path": path, "sheet": None, "row": None, "cells": None, "error": f"{type(x).__name__}: {x}"}]
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 5000], schema=kind)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


# --- the format


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


@dataclass
class SheetsPartition(InputPartition):
    paths: list[str]
    sheet: str | None = None


_ROW = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("formats", pa.list_(pa.string())), ("error", pa.string())])


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.only, self.fill = options["path"], options.get("sheet"), options.get("merged", "") == "fill"

    def partitions(self) -> list[SheetsPartition]:
        store, root = store_of(self.path)
        info = store.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
        hidden = lambda f: any(p.startswith(("_", ".", "~")) for p in f.path[len(root) :].split("/"))
        out, group, size = [], [], 0
        for f in sorted((f for f in found if f.is_file and (info.is_file or (f.path.lower().endswith((".xlsx", ".xlsm")) and not hidden(f)))), key=lambda f: f.path):
            if f.size > PARTITION_BYTES and self.only is None:
                try:
                    with store.open_input_file(f.path) as source:
                        out += [SheetsPartition([f.path], name) for name, _ in Workbook(source).parts]
                    continue
                except UNREADABLE:
                    pass  # its row tells the error
            if group and size + f.size > PARTITION_BYTES:
                out, group, size = [*out, SheetsPartition(group)], [], 0
            group, size = [*group, f.path], size + f.size
        return [*out, SheetsPartition(group)] if group else out

    def read(self, partition: SheetsPartition) -> Iterator[pa.RecordBatch]:
        rows = self._rows(partition)
        while held := list(itertools.islice(rows, 2000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROW, strict=True)], schema=_ROW)

    def _rows(self, partition: SheetsPartition) -> Iterator[tuple]:
        store, _ = store_of(self.path)
        wanted = self.only or partition.sheet
        for path in partition.paths:
            try:
                with store.open_input_file(path) as source:
                    book = Workbook(source)
                    for name, part in book.parts:
                        if wanted is None or name == wanted:
                            for n, cells, formats in book.rows(book.sheet(name, part), self.fill):
                                yield path, name, n, cells, formats, None
            except UNREADABLE as x:
                yield path, None, None, None, None, f"{type(x).__name__}: {x}"


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class WorkbookWriter(DataSourceWriter):
    """A task streams its rows into staged workbooks, the next one begun when the sheet of one is full,
    header included: every row is in a sheet of the given name. The commit on the driver moves them into place."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool) -> None:
        self.path, self.sheet, self.columns = options["path"], options.get("sheet", "Sheet1"), columns
        self.header, self.overwrite, self.job = options.get("header", "true").lower() == "true", overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = store_of(self.path)
        staging, moves, room = f"{root}/_staging-{self.job}", [], SHEET_ROWS - self.header
        store.create_dir(staging, recursive=True)
        rows, more = iter(rows), True
        while more:
            name, first, n = f"part-{uuid.uuid4().hex}.xlsx", next(rows, None), 0
            if first is None and moves:
                break
            with store.open_output_stream(f"{staging}/{name}") as out, WorkbookFile(out) as book:
                if self.header:
                    book.append(self.sheet, self.columns)
                for n, row in enumerate(itertools.chain([] if first is None else [first], itertools.islice(rows, room - 1)), 1):
                    book.append(self.sheet, list(row))
            moves.append((f"{staging}/{name}", f"{root}/{name}"))
            more = n == room
        return Written(moves)

    def commit(self, messages: list) -> None:
        store, root = store_of(self.path)
        if self.overwrite:
            for f in store.get_file_info(pafs.FileSelector(root)):
                if f.is_file and f.path.lower().endswith(".xlsx"):
                    store.delete_file(f.path)
        for m in messages:
            for staged, final in m.moves if m is not None else ():
                store.move(staged, final)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, root = store_of(self.path)
        staging = f"{root}/_staging-{self.job}"
        if store.get_file_info(staging).type == pafs.FileType.Directory:
            store.delete_dir(staging)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return FORMAT_SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


# --- writing

_STYLES = f'<styleSheet xmlns="{_MAIN[1:-1]}"><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="yyyy-mm-dd hh:mm:ss"/></numFmts><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
_EPOCH = datetime.datetime(1899, 12, 30)
#: Characters that XML does not have.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\ud800-\udfff]")


def _cell(reference: str, v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{reference}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | float):
        return f'<c r="{reference}"><v>{v!r}</v></c>' if v == v and abs(v) != float("inf") else ""
    if isinstance(v, datetime.datetime):
        return f'<c r="{reference}" s="2"><v>{(v.replace(tzinfo=None) - _EPOCH) / datetime.timedelta(days=1)!r}</v></c>'
    if isinstance(v, datetime.date):
        return f'<c r="{reference}" s="1"><v>{(v - _EPOCH.date()).days}</v></c>'
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(_NO_XML.sub("", safe_cell(str(v))))}</t></is></c>'


class WorkbookFile:
    """A workbook that is written row by row; a full sheet goes on in one of the same name with a number."""

    def __init__(self, out) -> None:
        self.zip, self.names, self.part, self.rows, self.now = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), [], None, 0, None

    def __enter__(self) -> WorkbookFile:
        return self

    def __exit__(self, kind, *_: object) -> None:
        if kind is None:
            self.close()

    def open_sheet(self, name: str) -> None:
        self._end()
        self.now, self.rows = name, 0
        taken = sum(n == name or n.startswith(f"{name} (") for n in self.names)
        self.names.append(f"{name} ({taken + 1})" if taken else name)
        self.part = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self.part.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())

    def append(self, name: str, row: list[object]) -> None:
        if self.now != name or self.rows == SHEET_ROWS:
            self.open_sheet(name)
        self.rows += 1
        self.part.write(f'<row r="{self.rows}">{"".join(_cell(f"{_letters(c)}{self.rows}", v) for c, v in enumerate(row))}</row>'.encode())

    def _end(self) -> None:
        if self.part:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()
            self.part = None

    def close(self) -> None:
        self._end()
        ids = range(1, len(self.names) + 1)
        self.zip.writestr("xl/styles.xml", _STYLES)
        self.zip.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-3]}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, self.names, strict=True)) + "</sheets></workbook>")
        self.zip.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL[1:-3]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + f'<Relationship Id="rId{len(self.names) + 1}" Type="{_REL[1:-3]}/styles" Target="styles.xml"/></Relationships>')
        self.zip.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids) + '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        self.zip.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL[1:-3]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.zip.close()


def workbook_bytes(content: dict[str, list[list[object]]]) -> bytes:
    """A workbook in memory; text that a spreadsheet would take for a formula is quoted."""
    out = io.BytesIO()
    with WorkbookFile(out) as book:
        for name, rows in content.items():
            book.open_sheet(name)
            for row in rows:
                book.append(name, row)
    return out.getvalue()


def safe_cell(v: str) -> str:
    return "'" + v if v[:1] in ("=", "+", "-", "@") else v
