"""Worksheets of .xlsx files as tables.

``read_sheets`` gives file, row_no, label, value: the first two columns of the named sheet as text, from any store that
Spark reads. A task inflates a workbook as a stream and cuts the sheet at row ends into segments of about a megabyte;
Spark deals these out, so the rows of one sheet are parsed by many tasks and none holds a whole sheet. Shared strings
are cut and parsed the same way and joined to the cells that name them. Row 1 holds the headers, row 2 the units, data
start in row 3. ``spark.read.format("xlsx_sheet")`` is the same as a data source for one-step reads of local files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridtide.sources.store import kept

SCHEMA = "file string, row_no long, label string, value string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
LEAST_BYTES = 1_000_000
MAGIC = b"PK\x03\x04"
#: Built-in number formats that show dates.
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 45, 46, 47, 50, 57}
#: Bytes of XML in a segment.
SEGMENT = 1 << 20
STRINGS = "xl/sharedStrings.xml"


def label_text(serial: float, epoch: datetime) -> str:
    """A date cell as the label it stands for."""
    return (epoch + timedelta(minutes=round(serial * 1440))).strftime("%d.%m.%Y %H:%M")


@dataclass(frozen=True)
class Book:
    """What the small parts of a workbook say: the sheet's part, the cell styles that show dates, and day zero."""

    part: str
    dated: tuple[int, ...]
    epoch: datetime
    strings: bool

    @classmethod
    def of(cls, book: zipfile.ZipFile, sheet: str) -> "Book":
        names, dated = book.namelist(), []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(book.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
            cells = styles.find(f"{MAIN}cellXfs")
            for i, xf in enumerate(cells if cells is not None else []):
                n = int(xf.get("numFmtId", 0))
                if n in DATE_FORMATS or re.search("[dyh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, ""))):
                    dated.append(i)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        found = [s.get(REL) for s in root.iter(f"{MAIN}sheet") if s.get("name") == sheet]
        if not found:
            raise ValueError(f"the workbook has no sheet {sheet}")
        late = any(p.get("date1904") in ("1", "true") for p in root.iter(f"{MAIN}workbookPr"))
        part = targets[found[0]].lstrip("/")
        return cls(part if part.startswith("xl/") else f"xl/{part}", tuple(dated), datetime(1904, 1, 1) if late else datetime(1899, 12, 30), STRINGS in names)


def segments(source: IO[bytes], holder: str, item: str, size: int = SEGMENT) -> Iterator[tuple[int, bytes]]:
    """(number before the first item, XML document) of the items below ``holder``, about ``size`` bytes each.

    The number is the last item's ``r`` attribute, or counted on where items have none.
    """
    opened = re.compile(rb"<((?:\w+:)?)" + holder.encode() + rb"(?:\s[^>]*)?>")
    each = re.compile(rb"<(?:\w+:)?" + item.encode() + rb"(?=[\s/>])(?:[^>]*?\sr=\"(\d+)\")?")
    data, head = b"", None
    while head is None:
        more = source.read(size)
        data += more
        if found := opened.search(data):
            head, prefix, data = data[: found.end()], found[1], data[found.end() :]
            if head.endswith(b"/>"):
                return
        elif not more:
            return
    closing = b"</" + prefix + item.encode() + b">"
    outer = re.findall(rb"<((?:\w+:)?[A-Za-z]\w*)[^>]*?(/?)>", head.split(b"?>", 1)[-1])
    tail = b"</" + prefix + holder.encode() + b">" + (b"" if outer[0][0] == prefix + holder.encode() else b"</" + outer[0][0] + b">")
    number, last = 0, False
    while not last:
        more = source.read(size)
        last, data = not more, data + more
        end = data.rfind(closing) + len(closing)
        if end >= len(closing):
            part, data = data[:end], data[end:]
            yield number, head + part + tail
            for found in each.finditer(part):
                number = int(found[1]) if found[1] else number + 1


def parsed_rows(number: int, document: bytes, dated: set[int], epoch: datetime) -> Iterator[tuple[int, list, list]]:
    """(row number, column A, column B) of a segment; a cell is [text, number of its shared string]."""
    for row in ElementTree.fromstring(document).iter(f"{MAIN}row"):
        number = int(row.get("r", number + 1))
        cells: dict[str, list] = {}
        for i, cell in enumerate(row):
            column = re.match("[A-Z]*", cell.get("r", "AB"[i] if i < 2 else "C"))[0]
            if column in ("A", "B"):
                value, kind = cell.find(f"{MAIN}v"), cell.get("t")
                text, shared = value.text if value is not None else None, None
                if kind == "s" and text is not None:
                    text, shared = None, int(text)
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                elif text is not None and column == "A" and int(cell.get("s", 0)) in dated and kind in (None, "n"):
                    text = label_text(float(text), epoch)
                cells[column] = [text, shared]
        if cells:
            yield number, cells.get("A", [None, None]), cells.get("B", [None, None])


def parsed_strings(number: int, document: bytes) -> Iterator[tuple[int, str]]:
    """(index, text) of a segment of shared strings."""
    for i, item in enumerate(ElementTree.fromstring(document).iter(f"{MAIN}si")):
        yield number + i, "".join(t.text or "" for t in item.iter(f"{MAIN}t"))


def sheet_rows(content: bytes | IO[bytes], sheet: str) -> Iterator[tuple[int, str | None, str | None]]:
    """(row number, column A, column B) of every row of a sheet, as text: a segment is in memory at a time, and the
    shared strings."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        about, shared = Book.of(book, sheet), {}
        if about.strings:
            with book.open(STRINGS) as source:
                shared = {i: t for n, d in segments(source, "sst", "si") for i, t in parsed_strings(n, d)}
        with book.open(about.part) as source:
            for n, document in segments(source, "sheetData", "row"):
                for number, a, b in parsed_rows(n, document, set(about.dated), about.epoch):
                    label, value = (text if at is None else shared[at] for text, at in (a, b))
                    yield number, (label or "").strip() or None, value


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_sheet"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(self.options)


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.options["path"]))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            for row in sheet_rows(f, self.options["sheet"]):
                yield (partition.value.rsplit("/", 1)[-1], *row)


SEGMENTS = "file string, kind string, number long, document binary, dated array<int>, epoch timestamp_ntz"
CELLS = "file string, row_no long, label string, label_at long, value string, value_at long"
TEXTS = "file string, at long, text string"


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "timestamp_ntz": pa.timestamp("us")}
    named = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def sheet_segments(spark: SparkSession, path: str, sheet: str, size: int = SEGMENT) -> DataFrame:
    """SEGMENTS of the sheet and of the shared strings of every workbook below ``path``: a task inflates a workbook."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(memoryview(content.as_buffer()))) as book:
                    about, n = Book.of(book, sheet), 0
                    with book.open(about.part) as source:
                        for number, document in segments(source, "sheetData", "row", size):
                            n += len(re.findall(rb"</(?:\w+:)?row>", document))
                            yield _table(SEGMENTS, [(file, "rows", number, document, about.dated, about.epoch)])
                    if n < 3:
                        raise ValueError(f"{file}: the sheet has fewer than three rows")
                    if about.strings:
                        with book.open(STRINGS) as source:
                            for number, document in segments(source, "sst", "si", size):
                                yield _table(SEGMENTS, [(file, "strings", number, document, (), about.epoch)])

    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, SEGMENTS)


def read_sheets(spark: SparkSession, path: str, sheet: str, size: int = SEGMENT) -> DataFrame:
    """file, row_no, label, value of the sheet of every workbook below ``path``, on any store that Spark reads.

    Date cells of the first column become labels. A workbook without the sheet or with fewer than three rows of it
    fails the job; empty cells are NULL, rows without a cell are left out.
    """
    parts = kept(sheet_segments(spark, path, sheet, size), "sheet-segments")
    count = parts.count()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                made = parsed_rows(one["number"], one["document"], set(one["dated"]), one["epoch"])
                yield _table(CELLS, [(one["file"], n, *a, *b) for n, a, b in made])

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                yield _table(TEXTS, [(one["file"], *t) for t in parsed_strings(one["number"], one["document"])])

    dealt = parts.repartition(max(1, count), "file", "kind", "number")  # a segment is a unit of work
    cells = dealt.filter("kind = 'rows'").mapInArrow(rows, CELLS)
    shared = dealt.filter("kind = 'strings'").mapInArrow(texts, TEXTS)
    for c in ("label", "value"):
        cells = cells.join(shared.select("file", F.col("at").alias(f"{c}_at"), F.col("text").alias(f"{c}_text")), ["file", f"{c}_at"], "left")

    def text(c: str) -> Column:
        return F.coalesce(c, f"{c}_text")

    label = F.regexp_replace(text("label"), r"^\s+|\s+$", "")
    return cells.select("file", "row_no", F.when(label != "", label).alias("label"), text("value").alias("value"))


def sheet_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per file the header and unit (rows 1 and 2, column B), and the data rows from row 3 on."""
    head = rows.filter("row_no <= 2").groupBy("file").agg(F.max(F.when(F.col("row_no") == 1, F.col("value"))).alias("header"), F.max(F.when(F.col("row_no") == 2, F.col("value"))).alias("unit"))
    return head, rows.filter("row_no > 2")


def valid_files(spark: SparkSession, path: str, least: int = LEAST_BYTES) -> DataFrame:
    """path, bytes, sha256, valid of every workbook: large enough and a zip archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), ((F.col("length") >= least) & (F.substring("content", 1, 4) == F.lit(bytearray(MAGIC)))).alias("valid"))
