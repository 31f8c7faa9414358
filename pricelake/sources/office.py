"""Spreadsheets and word-processor tables as lines of cells, read from their zipped XML inside tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

LINES = "doc_id string, sheet string, row_idx int, cells array<string>, error string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _tree(data: bytes) -> ElementTree.Element:
    """Documents with entity declarations are refused: no price list needs them."""
    if b"<!ENTITY" in data:
        raise ValueError("entity declarations aren't accepted")
    return ElementTree.fromstring(data)


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def read_xlsx(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row, cells) of every sheet, in the workbook's order; all values as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in _tree(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in _tree(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in _tree(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_RELATION}id")].lstrip("/")
            for k, row in enumerate(_tree(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row")):
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value = c.find(f"{_MAIN}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                yield sheet.get("name"), int(row.get("r") or k + 1) - 1, cells


def read_docx(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(table, row, cells) of every table, with tracked changes accepted: deletions are gone, insertions are text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _tree(z.read("word/document.xml"))

    def text(node: ElementTree.Element) -> str:
        if node.tag == f"{_WORD}del":
            return ""
        if node.tag == f"{_WORD}t":
            return node.text or ""
        inner = "".join(map(text, node))
        return inner + "\n" if node.tag == f"{_WORD}p" else inner

    for n, table in enumerate(body.iter(f"{_WORD}tbl")):
        for k, row in enumerate(table.findall(f"{_WORD}tr")):
            yield f"{n:04d}", k, [text(c).rstrip("\n") for c in row.findall(f"{_WORD}tc")]


READERS = {"xlsx": read_xlsx, "docx": read_docx}
#: Formats that need a converter, which isn't here.
UNREADABLE = ("doc", "xls")


def lines(files: DataFrame) -> DataFrame:
    """Lines of the files (``path, content, file_format``) that a reader exists for. A file that can't be read is one row
    with its error, and stops no other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content, kind in zip(frame["path"], frame["content"], frame["file_format"], strict=True):
                try:
                    if kind in UNREADABLE:
                        raise ValueError(f"a .{kind} file has to be converted to .{kind}x first")
                    found = [(path, sheet, k, cells, None) for sheet, k, cells in READERS[kind](content)]
                except Exception as e:  # noqa: BLE001  whatever is wrong with one file
                    found = [(path, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                yield pd.DataFrame(found, columns=["doc_id", "sheet", "row_idx", "cells", "error"])

    return files.where(files["file_format"].isin(*READERS, *UNREADABLE)).select("path", "content", "file_format").mapInPandas(run, LINES)
