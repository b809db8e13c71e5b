"""Receipts from spreadsheet workbooks: each file is read by one task, its active sheet as a stream of rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from basketry.sources.files import named_rows, receipt_rows

#: The formats of numbers that are dates.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_EPOCH = datetime(1899, 12, 30)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(book: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """The elements of one name, one after the other; what was read is let go."""
    if name not in book.namelist():
        return
    with book.open(name) as f:
        for _, e in ElementTree.iterparse(f, events=("end",)):
            if _local(e.tag) == wanted:
                yield e
                e.clear()


def _texts(e: ElementTree.Element) -> str:
    """All runs of a text, without what only says how it is pronounced."""
    if _local(e.tag) == "rPh":
        return ""
    return (e.text or "" if _local(e.tag) == "t" else "") + "".join(_texts(x) for x in e)


def _sheet(book: zipfile.ZipFile) -> str | None:
    """The part of the active sheet."""
    names = book.namelist()
    tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = [e for e in tree.iter() if _local(e.tag) == "sheet"]
    active = next((int(e.get("activeTab", 0)) for e in tree.iter() if _local(e.tag) == "workbookView"), 0)
    if not sheets:
        return None
    own = sheets[active if active < len(sheets) else 0]
    link = next((v for k, v in own.attrib.items() if _local(k) == "id"), None)
    parts = {}
    if "xl/_rels/workbook.xml.rels" in names:
        parts = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = parts.get(link, "")
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of cell styles that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    tree = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(e.get("numFmtId", 0)) for e in tree.iter() if _local(e.tag) == "numFmt" and re.search(r"[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")).lower())}
    cells = next((e for e in tree.iter() if _local(e.tag) == "cellXfs"), [])
    return {i for i, e in enumerate(cells) if int(e.get("numFmtId", 0)) in DATE_FORMATS | own}


def _value(c: ElementTree.Element, shared: list[str], dates: set[int]) -> str | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return next((_texts(e) for e in c if _local(e.tag) == "is"), None)
    v = next((e.text for e in c if _local(e.tag) == "v"), None)
    if v is None:
        return None
    if kind == "s":
        return shared[int(v)]
    if kind == "n" and int(c.get("s", -1)) in dates:
        return (_EPOCH + timedelta(days=float(v))).strftime("%Y-%m-%d")
    return v


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's active sheet that say anything."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        name = _sheet(book)
        if not name:
            return
        shared, dates = [_texts(e) for e in _elements(book, "xl/sharedStrings.xml", "si")], _date_styles(book)
        for row in _elements(book, name, "row"):
            cells: list[str | None] = []
            for c in row:
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = 0
                for x in letters:
                    at = 26 * at + ord(x) - 64
                at = at - 1 if letters else len(cells)
                cells += [None] * (at - len(cells))
                cells.append(_value(c, shared, dates))
            if any((x or "").strip() for x in cells):
                yield cells


def receipt_workbook(spark: SparkSession, path: str) -> DataFrame:
    """path, date, store, name, qty, price, total of receipts in workbooks (a file, a folder or a pattern).

    The first row names the columns, as in a table in CSV; price and total complete one another. A file that is no workbook, or has no
    column for the name, has no rows. A file is one value, so it has to fit in a task.
    """

    return receipt_rows(named_rows(spark.read.format("binaryFile").load(path), sheet_rows, (zipfile.BadZipFile, KeyError, ElementTree.ParseError)), ["path"])
