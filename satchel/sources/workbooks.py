"""Workbooks of spreadsheets as bytes: tables become files of a sheet each, and the first sheets of files become tables.

Files are made and read in tasks, one at a time; a table of any size is several files of at most ``rows`` rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.schemas import schema

#: Rows of a sheet besides its header, as programs read them.
ROWS = 1_048_575
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_FIXED = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
#: Characters that no such file can hold, written as _xHHHH_, and texts that look so already.
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_WRITTEN = re.compile("_x([0-9A-Fa-f]{4})_")


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) < 1e15 and value == value:
        return f"<c><v>{value!r}</v></c>"
    text = _UNWRITABLE.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _file(header: list[str], rows: list[tuple]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _FIXED.items():
            z.writestr(zipfile.ZipInfo(name), text)
        lines = "".join(f"<row>{''.join(map(_cell, row))}</row>" for row in [header, *rows])
        z.writestr(zipfile.ZipInfo("xl/worksheets/sheet1.xml"), f'<worksheet xmlns="{MAIN}"><sheetData>{lines}</sheetData></worksheet>', zipfile.ZIP_DEFLATED)
    return out.getvalue()


def workbooks(rows: DataFrame, per_file: int = 100_000) -> DataFrame:
    """``rows`` as files: ``content`` and ``n`` (rows). Numbers of fewer than 16 digits and truth values keep their kind, all
    else is text. No rows give no file."""
    names, per_file = rows.columns, min(per_file, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(part: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_file(names, part)], pa.binary()), pa.array([len(part)], pa.int64())], names=["content", "n"])

        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= per_file:
                yield made(held[:per_file])
                del held[:per_file]
        if held:
            yield made(held)

    return rows.mapInArrow(run, "content binary, n long")


def _place(reference: str, before: int) -> int:
    """The column of a cell, from 0; cells without reference follow the one before."""
    letters = re.match("[A-Z]+", reference or "")
    if not letters:
        return before + 1
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def read(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text. Fails on what is no workbook."""
    q = lambda tag: f"{{{MAIN}}}{tag}"
    text = lambda e: _WRITTEN.sub(lambda m: chr(int(m[1], 16)), "".join(t.text or "" for t in e.iter(q("t"))))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [text(e) for e in ElementTree.parse(z.open("xl/sharedStrings.xml")).iter(q("si"))] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        with z.open(sheets[0]) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != q("row"):
                    continue
                row: list[str | None] = []
                at = -1
                for c in e.iter(q("c")):
                    at = _place(c.get("r", ""), at)
                    row += [None] * (at + 1 - len(row))
                    v = c.find(q("v"))
                    kind = c.get("t")
                    if kind == "inlineStr":
                        row[at] = text(c)
                    elif v is not None and v.text is not None:
                        row[at] = shared[int(v.text)] if kind == "s" else ("false", "true")[int(v.text)] if kind == "b" else v.text
                yield row
                e.clear()


def import_workbooks(files: DataFrame, table: str, mapping: dict[str, str] | None = None, content: str = "content") -> DataFrame:
    """Rows of a table from the first sheets of workbooks, whose first rows name the columns; ``mapping`` renames them. Values
    that do not fit are null, and so are columns that are missing. A file that is no workbook gives no rows."""
    wanted = schema(table)
    names = [f.name for f in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                try:
                    lines = read(raw or b"")
                    header = [(mapping or {}).get(h, h) for h in next(lines, [])]
                    places = [header.index(n) if n in header else None for n in names]
                    rows = []
                    for line in lines:
                        rows.append([line[p] if p is not None and p < len(line) else None for p in places])
                        if len(rows) == 4096:
                            yield sent(rows)
                            rows = []
                    if rows:
                        yield sent(rows)
                except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError):
                    continue

    found = files.select(content).mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
    return found.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted))
