"""Spreadsheet files without a spreadsheet library: one sheet, a header row, text and numbers.

``XlsxSource`` reads them through ``spark.read.format("xlsx").schema(...)`` and writes
one file per task; a file is one unit of work.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StructType

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def read_rows(data: bytes) -> Iterator[list]:
    """Cells of the first sheet, row by row; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{_NS['m']}}}row"):
            cells: list = []
            for c in row.findall("m:c", _NS):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, v = c.get("t"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind == "str" else float(v.text)
            yield cells


def write_rows(header: list[str], rows: Iterator[tuple]) -> bytes:
    """A workbook of one sheet."""

    def cell(r: int, c: int, v) -> str:
        ref = f"{_letters(c)}{r}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        text = escape(_ILLEGAL.sub("", v if isinstance(v, str) else repr(v)))
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    lines = (f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([tuple(header), *rows], 1))
    sheet = f'<worksheet xmlns="{_NS["m"]}"><sheetData>' + "".join(lines) + "</sheetData></worksheet>"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_NS["m"]}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def _cast(value, kind):
    if value is None:
        return None
    if isinstance(kind, (DoubleType, FloatType)):
        return float(value)
    if isinstance(kind, (IntegerType, LongType)):
        return int(float(value))
    if isinstance(kind, BooleanType):
        return bool(value)
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self):
        import glob

        return [_File(p) for p in sorted(glob.glob(self.options["path"]))]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            rows = read_rows(f.read())
        header = next(rows, [])
        at = {name: i for i, name in enumerate(header)}
        for row in rows:
            row = row + [None] * (len(header) - len(row))
            yield tuple(_cast(row[at[f.name]], f.dataType) if f.name in at else None for f in self.schema.fields)


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def write(self, iterator):
        import os

        from pyspark import TaskContext

        os.makedirs(self.options["path"], exist_ok=True)
        data = write_rows(self.schema.names, (tuple(r) for r in iterator))
        with open(f"{self.options['path']}/part-{TaskContext.get().partitionId():05d}.xlsx", "wb") as f:
            f.write(data)
        return WriterCommitMessage()


class XlsxSource(DataSource):
    """``spark.dataSource.register(XlsxSource)``; paths are of a file system that all executors mount."""

    @classmethod
    def name(cls):
        return "xlsx"

    def reader(self, schema):
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return _Writer(schema, self.options)


def read_sheets(files, schema: str, number: str | None = None):
    """Rows of workbooks read by the ``binaryFile`` source, from any store, with their ``path`` and, if asked, their number in the sheet; bad files give none."""
    want = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else schema

    def run(parts):
        import pandas as pd

        for pdf in parts:
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows = list(read_rows(data))
                except Exception:
                    continue
                at = {n: i for i, n in enumerate(rows[0])} if rows else {}
                out = [[_cast(r[at[f.name]], f.dataType) if f.name in at and at[f.name] < len(r) else None for f in want.fields] for r in rows[1:]]
                made = pd.DataFrame([(path, *r) for r in out], columns=["path", *want.names]).astype(object)
                yield made if number is None else made.assign(**{number: range(len(made))})

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}" + (f", `{number}` long" if number else ""))
