"""First sheets of many .xlsx workbooks as one table of text cells."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _number(raw: str) -> str:
    value = float(raw)
    return str(int(value)) if value.is_integer() and abs(value) < 1e16 else repr(value)


def _column_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + ord(ch) - 64
    return n - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    if sheet is None:
        raise ValueError("workbook without sheets")
    wanted = sheet.get(f"{_REL}id")
    for rel in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == wanted:
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("first sheet has no part")


def _cell(cell: ET.Element, strings: list[str]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    raw = value.text if value is not None and value.text is not None else ""
    if raw == "":
        return ""
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind == "e":
        return f"#ERR:{raw}"
    return _number(raw) if kind == "n" else raw


def _elements(part, tag: str) -> Iterator[ET.Element]:
    """Elements of one kind as they end, each forgotten once it has been used."""
    parents: list[ET.Element] = []
    for event, node in ET.iterparse(part, ("start", "end")):
        if event == "start":
            parents.append(node)
            continue
        parents.pop()
        if node.tag == tag:
            yield node
            if parents:
                parents[-1].remove(node)


def sheet_rows(content: bytes | BinaryIO) -> Iterator[list[str]]:
    """Rows of the first sheet, read element by element from bytes or an open file; only shared strings are kept."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes | bytearray) else content) as book:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                strings = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in _elements(part, f"{_MAIN}si")]
        with book.open(_first_sheet(book)) as part:
            for node in _elements(part, f"{_MAIN}row"):
                cells: list[str] = []
                for cell in node.iter(f"{_MAIN}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([""] * (at - len(cells)))
                    cells.append(_cell(cell, strings))
                yield cells


def read_workbooks(files: DataFrame, batch_rows: int = 5000, parts: int | None = None) -> DataFrame:
    """``(path, row_no, cells, error)`` of workbooks given as ``(path, content)``.

    Files are independent, so this is one map-only stage; rows leave in batches.  ``parts`` asks for so many
    tasks where few input files hold much work.
    Legacy ``.xls`` files and unreadable ones yield a single row with an error.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "row_no", "cells", "error"]
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    if path.lower().endswith(".xls"):
                        raise ValueError("the old .xls format is not supported, only .xlsx is read")
                    for i, cells in enumerate(sheet_rows(content)):
                        out.append((path, i, cells, None))
                        if len(out) >= batch_rows:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                except Exception as exc:  # noqa: BLE001 - one bad workbook must not stop the job
                    out.append((path, -1, None, str(exc)))
            if out:
                yield pd.DataFrame(out, columns=names)

    slim = files.select("path", "content")
    return (slim if parts is None else slim.repartition(parts)).mapInPandas(
        parse, "path string, row_no long, cells array<string>, error string")


def workbook_records(files: DataFrame, open_file: Callable, batch_rows: int = 5000, parts: int | None = None) -> DataFrame:
    """``(path, start, no, fields, error)`` of workbooks given as ``(path)``: every row of their first sheets.

    Files are opened in the tasks and read as they are parsed, so neither a file nor its rows are held as a whole.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "start", "no", "fields", "error"]
        for batch in batches:
            for path in batch["path"]:
                out = []
                try:
                    with open_file(path) as handle:
                        for i, cells in enumerate(sheet_rows(handle)):
                            out.append((path, 0, i, cells, None))
                            if len(out) >= batch_rows:
                                yield pd.DataFrame(out, columns=names)
                                out = []
                except Exception as exc:  # noqa: BLE001 - the reader of the rows decides
                    out.append((path, 0, -1, None, f"{type(exc).__name__}: {exc}"))
                if out:
                    yield pd.DataFrame(out, columns=names)

    slim = files.select("path")
    return (slim if parts is None else slim.repartition(parts, "path")).mapInPandas(
        parse, "path string, start long, no long, fields array<string>, error string")


def csv_line(cells: Column) -> Column:
    """Cells joined to one CSV line; fields with commas, quotes or line ends are quoted."""
    quote = F.lit('"')
    return F.array_join(F.transform(cells, lambda c: F.when(
        c.rlike('[,"\n\r]'), F.concat(quote, F.replace(c, quote, F.lit('""')), quote)).otherwise(c)), ",")
