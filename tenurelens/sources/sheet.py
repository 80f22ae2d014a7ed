"""Spreadsheets (.xlsx) as a Spark data source: one sheet, its first row the header.

A file is a zip of XML parts. A sheet's rows are read as a stream, one after the
other; the file's shared strings are held meanwhile. A file is one partition, as a sheet can't be split.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "tenurelens_sheet"
SUFFIX = ".xlsx"
_LETTERS = re.compile(r"[A-Z]+")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of an absolute path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The file, or the spreadsheets of a folder in the order of their names."""
    system, base = _opened(path)
    if system.get_file_info(base).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(base))
    names = sorted(i.base_name for i in found if i.base_name.endswith(SUFFIX) and not i.base_name.startswith(("~", ".", "_")))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def _sheet_part(book: zipfile.ZipFile, sheet: int) -> str:
    """Name of the part of the ``sheet``-th sheet, from 1, in the order of the tabs."""
    tabs = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
    if not 1 <= sheet <= len(tabs):
        raise ValueError(f"there is no sheet {sheet} of {len(tabs)}")
    relation = next(v for k, v in tabs[sheet - 1].attrib.items() if _local(k) == "id" and k != "sheetId")
    for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if e.get("Id") == relation:
            target = e.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"sheet {sheet} has no part")


def _text(element: ElementTree.Element) -> str:
    """The text of a string item, its runs put together; readings beside it are left out."""
    if _local(element.tag) == "rPh":
        return ""
    own = element.text or "" if _local(element.tag) == "t" else ""
    return own + "".join(_text(e) for e in element)


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, e in ElementTree.iterparse(part):
            if _local(e.tag) == "si":
                found.append(_text(e))
                e.clear()
    return found


def _value(cell: ElementTree.Element, strings: list[str]) -> str | None:
    """A cell as text; whole numbers without a point. Errors and empty cells are missing."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(_text(e) for e in cell if _local(e.tag) == "is")
    raw = next((e.text for e in cell if _local(e.tag) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind == "n":
        number = float(raw)
        return str(int(number)) if number.is_integer() and abs(number) < 1 << 53 else repr(number)
    return raw


def _column(cell: ElementTree.Element, after: int) -> int:
    """Place of a cell in its row, from its reference, or behind the cell before it."""
    found = _LETTERS.match(cell.get("r", ""))
    if not found:
        return after
    at = 0
    for c in found.group():
        at = at * 26 + ord(c) - ord("A") + 1
    return at - 1


def rows(path: str, sheet: int = 1) -> Iterator[list[str | None]]:
    """The rows of a sheet from the header on; empty rows are left out, short ones are not filled up."""
    system, base = _opened(path)
    with system.open_input_file(base) as file, zipfile.ZipFile(file) as book:
        strings = _strings(book)
        with book.open(_sheet_part(book, sheet)) as part:
            for _, e in ElementTree.iterparse(part):
                if _local(e.tag) != "row":
                    continue
                found: list[str | None] = []
                for cell in e:
                    at = _column(cell, len(found))
                    found += [None] * (at + 1 - len(found))
                    found[at] = _value(cell, strings)
                e.clear()
                if any(v is not None for v in found):
                    yield found


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SheetReader(DataSourceReader):
    def __init__(self, path: str, sheet: int, names: list[str]):
        self.path, self.sheet, self.names = path, sheet, names

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        found = rows(partition.path, self.sheet)
        header = next(found, [])
        missing = [n for n in self.names if n not in header]
        if missing and header:
            raise ValueError(f"{partition.path} has no column {', '.join(missing)}")
        places = [header.index(n) for n in self.names if n in header]
        for row in found:
            yield tuple(row[p] if p < len(row) else None for p in places)


class SheetSource(DataSource):
    """Options: ``path`` of a file or folder, ``sheet`` from 1. All columns are texts, named by the header."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _sheet(self) -> int:
        return int(self.options.get("sheet", "1"))

    def schema(self) -> T.StructType:
        header = next(rows(_files(self.options["path"])[0], self._sheet()), [])
        return T.StructType([T.StructField(n, T.StringType()) for n in header if n])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SheetReader(self.options["path"], self._sheet(), schema.fieldNames())


def _typed(field: T.StructField) -> Column:
    """``NA`` and blank numbers are missing, as in CSV; an empty cell is, too, also in a text column."""
    raw = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.when(raw != "NA", raw).alias(field.name)
    return F.when(~F.trim(raw).isin("", "NA"), raw.cast(field.dataType)).alias(field.name)


def read_sheet(spark: SparkSession, path: str, schema: T.StructType, sheet: int = 1) -> DataFrame:
    """The columns of ``schema`` by name; a malformed number and a missing column fail the job."""
    spark.dataSource.register(SheetSource)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.format(NAME).schema(texts).option("sheet", str(sheet)).load(path)
    return raw.select(*[_typed(f) for f in schema.fields])
