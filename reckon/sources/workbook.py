"""Workbook scan: xlsx files as rows, without a library. Sheets are read on the executors, one file a row of ``binaryFile``.

Columns are known by position. Text that is struck through, inside a cell or by the cell's own style, is split off into a
second column. Blank cells are null; rows without any cell are skipped. All rows are read, unless ``stop_after`` empty rows
in a row are asked to end a sheet; content behind them is then an error, never dropped in silence.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as X

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
CELL = re.compile(r"([A-Z]+)(\d+)")


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def _rich(node) -> tuple[str, str]:
    """Live and struck text of a string item."""
    live, struck = [], []
    for t in node.findall("m:t", NS):
        live.append(t.text or "")
    for run in node.findall("m:r", NS):
        mark = run.find("m:rPr/m:strike", NS)
        gone = mark is not None and mark.get("val", "1") not in ("0", "false")
        (struck if gone else live).append(run.findtext("m:t", "", NS))
    return "".join(live), "".join(struck)


def _struck_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles whose font is struck through."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    styles = X.fromstring(z.read("xl/styles.xml"))
    marks = [f.find("m:strike", NS) for f in styles.findall("m:fonts/m:font", NS)]
    struck = {i for i, m in enumerate(marks) if m is not None and m.get("val", "1") not in ("0", "false")}
    return {i for i, x in enumerate(styles.findall("m:cellXfs/m:xf", NS)) if int(x.get("fontId") or 0) in struck}


def sheet_rows(content: bytes, sheet: str | None = None, stop_after: int | None = None) -> Iterator[tuple[int, dict[int, tuple[str | None, str | None]]]]:
    """(row number, {column: (live, struck)}) of one sheet, by default the first."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, gone = z.namelist(), _struck_styles(z)
        shared = [_rich(x) for x in X.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS)] if "xl/sharedStrings.xml" in names else []
        book = X.fromstring(z.read("xl/workbook.xml"))
        targets = {x.get("Id"): x.get("Target") for x in X.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("p:Relationship", NS)}
        sheets = [(s.get("name"), targets[s.get(f"{{{NS['r']}}}id")]) for s in book.findall("m:sheets/m:sheet", NS)]
        target = next((t for n, t in sheets if sheet is None or n == sheet), None)
        if target is None:
            return
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        empty = last = 0
        for _, row in X.iterparse(z.open(path)):
            if row.tag != f"{{{NS['m']}}}row":
                continue
            number, cells = int(row.get("r") or last + 1), {}
            empty, last = empty + number - last - 1, number
            for at, c in enumerate(row.findall("m:c", NS)):
                where = CELL.fullmatch(c.get("r") or "")
                kind, value = c.get("t"), c.findtext("m:v", None, NS)
                if kind == "s" and value is not None:
                    pair = shared[int(value)]
                elif kind == "inlineStr":
                    pair = _rich(c.find("m:is", NS))
                else:
                    pair = (value or "", "")
                pair = tuple(x.strip() or None for x in pair)
                if int(c.get("s") or 0) in gone:
                    pair = (None, " ".join(x for x in pair if x) or None)
                if any(pair):
                    cells[column_number(where[1]) if where else at] = pair
            row.clear()
            if cells and stop_after is not None and empty >= stop_after:
                raise ValueError(f"row {number} lies behind {empty} empty rows; stop_after is {stop_after}")
            empty = 0 if cells else empty + 1
            if cells:
                yield number, cells


def workbooks(spark: SparkSession, path: str, columns: dict[int, str], sheet: str | None = None, stop_after: int | None = None, struck: tuple[str, ...] = ()) -> DataFrame:
    """All workbooks below ``path``: source_file, source_row, the named columns, and ``<name>_struck`` where asked for."""
    names = [columns[i] for i in sorted(columns)]
    schema = ", ".join(["source_file string", "source_row long", *[f"`{n}` string" for n in names], *[f"`{n}_struck` string" for n in struck]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(sheet_rows(content.as_py(), sheet, stop_after))
                pick = lambda i, k: pa.array([c.get(i, (None, None))[k] for _, c in rows], pa.string())
                number = {n: i for i, n in columns.items()}
                arrays = [pa.array([file.as_py()] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()), *[pick(number[n], 0) for n in names], *[pick(number[n], 1) for n in struck]]
                yield pa.RecordBatch.from_arrays(arrays, names=["source_file", "source_row", *names, *[f"{n}_struck" for n in struck]])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, schema)
