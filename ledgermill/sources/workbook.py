"""Spreadsheets (xlsx) as a Spark data source: one row per sheet row, cells as strings.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("path", "file:///folder/*.xlsx").load()

Files are listed and read by Spark's own binary reader in ``read_sheets``, so any
store works; the registered source reads and writes files on a path that executors see:

    made_workbooks(rows, "id").write.format("workbook").mode("append").save("/shared/folder")

Cells keep their text; numbers keep the form of the file.
"""

from __future__ import annotations

import io
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ledgermill.operators.retrieval import small
from ledgermill.operators.statistics import batches

ROWS = "file string, sheet string, sheet_no int, row int, cells array<string>"
HEADER_SCAN = 15


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parts(content: bytes) -> Iterator[tuple[str, int, bytes, bytes]]:
    """(sheet, number, its XML, the shared strings' XML) of one workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = book.read("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in book.namelist() else b""
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        for number, sheet in enumerate(sheets):
            target = rels[next(v for k, v in sheet.attrib.items() if _local(k) == "id")]
            yield sheet.get("name"), number, book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), shared


def _row_cells(sheet: bytes, shared_xml: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(1-based row number, cells) of a sheet; rows without a value are left out."""
    shared: list[str] = []
    for item in ElementTree.fromstring(shared_xml) if shared_xml else ():
        shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
    for _, node in ElementTree.iterparse(io.BytesIO(sheet)):
        if _local(node.tag) != "row":
            continue
        cells: list[str | None] = []
        for i, c in enumerate(x for x in node if _local(x.tag) == "c"):
            at = _column(c.get("r", "")) if c.get("r") else i
            kind = c.get("t")
            text = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
            value = shared[int(text)] if kind == "s" and text else text
            cells += [None] * (at + 1 - len(cells))
            cells[at] = value if value != "" else None
        if any(v is not None for v in cells):
            yield int(node.get("r", 0)), cells
        node.clear()


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, sheet number, 1-based row number, cells) of one workbook; rows without a value are left out."""
    for name, number, sheet, shared in _parts(content):
        for row, cells in _row_cells(sheet, shared):
            yield name, number, row, cells


_SHEETS = "file string, sheet string, sheet_no int, xml binary, shared binary"


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for name, number, sheet, shared in _parts(content):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([number], pa.int32()), pa.array([sheet], pa.binary()), pa.array([shared], pa.binary())], names=["file", "sheet", "sheet_no", "xml", "shared"])


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            file, sheet, number, xml, shared = (batch.column(k)[n].as_py() for k in range(5))
            rows = _row_cells(xml, shared)
            while part := list(islice(rows, 5_000)):
                m = len(part)
                columns = [pa.array([file] * m), pa.array([sheet] * m), pa.array([number] * m, pa.int32()), pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "sheet", "sheet_no", "row", "cells"])


#: Largest workbook that is taken.
MOST_BYTES = 200 << 20


def workbook_rows(books: DataFrame) -> DataFrame:
    """All rows of all sheets of workbooks (path, content); a sheet is a task, its cells go through no other."""
    sheets = books.select("path", "content").mapInArrow(_unpack, _SHEETS)
    return sheets.repartition("file", "sheet_no").mapInArrow(_parse, ROWS)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all sheets of the workbooks at ``path``, wherever Spark can read; a workbook over ``MOST_BYTES`` is an error."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.when(F.col("length") <= MOST_BYTES, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("too large: "), "path")).cast("binary"))
    return workbook_rows(files.select("path", fits.alias("content")))


# --- writing ----------------------------------------------------------------------------


def workbook_bytes(sheet: str, headers: list[str], rows: Iterable[list]) -> bytes:
    """An xlsx file of one sheet: headers in row 1; numbers as numbers, nulls as no cell, all else as text."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        put = lambda name, body: book.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + body, zipfile.ZIP_DEFLATED)
        put("[Content_Types].xml", _TYPES)
        put("_rels/.rels", _LINK.format(kind="officeDocument", target="xl/workbook.xml"))
        put("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        put("xl/_rels/workbook.xml.rels", _LINK.format(kind="worksheet", target="worksheets/sheet1.xml"))
        with book.open(zipfile.ZipInfo("xl/worksheets/sheet1.xml"), "w") as part:
            part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            for n, row in enumerate(chain([headers], rows), 1):
                part.write((f'<row r="{n}">' + "".join(_cell(f"{_letters(i)}{n}", v) for i, v in enumerate(row) if v is not None) + "</row>").encode())
            part.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _letters(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


def _cell(ref: str, value) -> str:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", str(value)))}</t></is></c>'


# Names of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_LINK = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_OFFICE}/{{kind}}" Target="{{target}}"/></Relationships>'
_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
)
#: Characters that XML 1.0 cannot hold.
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def made_workbooks(rows: DataFrame, order: str, size: int = 50_000, sheet: str = "Sheet1", name: str = "export") -> DataFrame:
    """(path, content): the columns of ``rows`` as workbooks of ``size`` rows each in ``order``; a workbook is a task."""
    columns = rows.columns
    plain = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{order}`").alias("by"))
    dealt = batches(plain, ["by"], size)

    def make(key: tuple, held: pa.Table) -> pa.Table:
        table = held.sort_by("by").column("row").to_pylist()
        content = workbook_bytes(sheet, columns, ([r[c] for c in columns] for r in table))
        return pa.table([pa.array([f"{name}-{key[0].as_py():05d}.xlsx"]), pa.array([content], pa.binary())], names=["path", "content"])

    return dealt.groupBy("batch").applyInArrow(make, "path string, content binary")


class _Writer(DataSourceWriter):
    """Files are written aside by the tasks and put in place by the commit, all or none."""

    def __init__(self, path: str):
        self._path, self._aside = path, os.path.join(path, f"_aside-{uuid.uuid4().hex}")

    def write(self, rows):
        os.makedirs(self._aside, exist_ok=True)
        names = []
        for row in rows:
            # a task that is run again writes files of its own; only those it reports are put in place
            aside = os.path.join(self._aside, uuid.uuid4().hex)
            with open(aside, "wb") as f:
                f.write(row.content)
            names.append((aside, os.path.basename(row.path)))
        return _Written(names=names)

    def commit(self, messages):
        for message in messages:
            for aside, name in message.names if message else ():
                os.replace(aside, os.path.join(self._path, name))
        shutil.rmtree(self._aside, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self._aside, ignore_errors=True)


@dataclass
class _Written(WriterCommitMessage):
    names: list


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self._path = path

    def partitions(self):
        return [InputPartition(self._path)]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            for sheet, number, row, cells in sheet_rows(f.read()):
                yield partition.value, sheet, number, row, cells


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def header_rows(rows: DataFrame) -> DataFrame:
    """(file, sheet, header_row, headers): within the first rows, most text cells x share of distinct ones; the earliest of equal ones.

    A cell is text if it is no number.  A blank header in column i is named ``col_i``.
    """
    first = Window.partitionBy("file", "sheet").orderBy("row")
    head = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= HEADER_SCAN)
    texts = F.filter("cells", lambda c: c.isNotNull() & c.try_cast("double").isNull())
    filled = F.filter("cells", lambda c: c.isNotNull())
    score = F.size(texts) * F.size(F.array_distinct(filled)) / F.size(filled)
    best = head.withColumn("score", score).groupBy("file", "sheet").agg(F.max_by(F.struct("row", "cells"), F.struct("score", -F.col("row"))).alias("best"))
    return best.select("file", "sheet", F.col("best.row").alias("header_row"), F.transform("best.cells", lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("col_"), i.cast("string")))).alias("headers"))


def list_sheets(rows: DataFrame) -> DataFrame:
    """(file, sheet, sheet_no, n_rows, n_columns, headers, preview_rows): data rows are those below the header."""
    sizes = rows.groupBy("file", "sheet", "sheet_no").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("cells")).alias("n_columns"), F.max("row").alias("last_row"))
    return sizes.join(header_rows(rows), ["file", "sheet"]).withColumn("preview_rows", F.greatest(F.col("last_row") - F.col("header_row"), F.lit(0)))


def records(rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """(file, sheet, row, fields map) of the named sheet or else each file's longest; an unknown name is an error.

    Of equal headers the last column counts.
    """
    sizes = rows.groupBy("file", "sheet", "sheet_no").agg(F.count(F.lit(1)).alias("n"))
    if sheet is None:
        chosen = sizes.groupBy("file").agg(F.max_by("sheet", F.struct("n", -F.col("sheet_no"))).alias("sheet"))
    else:
        chosen = sizes.where(F.col("sheet") == sheet).select("file", "sheet")
        if chosen.isEmpty():
            raise ValueError(f"no sheet named {sheet!r}")
    data = rows.join(small(chosen.join(header_rows(rows), ["file", "sheet"])), ["file", "sheet"]).where(F.col("row") > F.col("header_row"))
    pairs = F.transform("headers", lambda h, i: F.struct(h.alias("key"), F.get("cells", i).alias("value"), i.alias("at")))
    last = F.filter(pairs, lambda e: ~F.exists(pairs, lambda o: (o["key"] == e["key"]) & (o["at"] > e["at"])))
    return data.select("file", "sheet", "row", F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"]))).alias("fields"))
