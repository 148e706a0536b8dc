"""Spreadsheets of the open XML kind: one sheet by its number as rows of text, and a report-sized table as a workbook.

A workbook is a zip of XML parts, so each is read in one task; the sheets of
many workbooks are spread.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"

#: Rows of a workbook that this engine writes at most; larger results stay Parquet.
REPORT_ROWS = 100_000


def column_number(name: str) -> int:
    """The place of a column from 0: A, B, ..., Z, AA, ..."""
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def sheet_rows(data: bytes, index: int):
    """``(row, cells)`` of the index-th sheet from 1: cells as text by column, empty ones missing."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = book.findall(f"{MAIN}sheets/{MAIN}sheet")
        if not 1 <= index <= len(sheets):
            raise ValueError(f"there is no sheet {index} of {len(sheets)}")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall(f"{PACKAGE}Relationship")}
        target = links[sheets[index - 1].get(LINK)]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")]
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with z.open(part) as f:
            at = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                at = int(row.get("r") or at + 1)
                cells, place = {}, -1
                for c in row.findall(f"{MAIN}c"):
                    name = re.match(r"[A-Z]+", c.get("r") or "")
                    place = column_number(name[0]) if name else place + 1
                    value, kind = c.find(f"{MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[place] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    elif value is not None and value.text is not None:
                        cells[place] = shared[int(value.text)] if kind == "s" else value.text
                row.clear()
                yield at, cells


def read_sheet(spark: SparkSession, path: str, index: int, key: str | None = None) -> DataFrame:
    """One sheet of a workbook as text columns named by its header row: the first one, or the first with ``key`` in column one."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                rows = list(sheet_rows(bytes(data), index))
                yield pd.DataFrame({"at": [a for a, _ in rows], "cells": [[c.get(k) for k in range(max(c, default=-1) + 1)] for _, c in rows]})

    rows = files.mapInPandas(run, "at bigint, cells array<string>")
    heads = rows.where(F.trim(F.get("cells", F.lit(0))) == key) if key is not None else rows.where(F.size("cells") > 0)
    head = heads.orderBy("at").limit(1).collect()
    if not head:
        raise ValueError("the sheet has no header row")
    from tessera.functions.labels import unique_names

    names = unique_names([(c or "").strip() or f"col_{k}" for k, c in enumerate(head[0]["cells"], 1)])
    return rows.where(F.col("at") > head[0]["at"]).select(*[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook of named sheets, each a header and rows of numbers, texts and nulls."""
    def cell(r, c, v):
        at = f"{column_name(c)}{r}"
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{k}" Type="{LINK[1:-3]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    out, top = io.BytesIO(), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{top}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{top}<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{LINK[1:-3]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{top}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-3]}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{top}<Relationships xmlns="{PACKAGE[1:-1]}">{links}</Relationships>')
        for k, (head, rows) in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate([tuple(head), *rows], 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{top}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """Report-sized tables as the sheets of one workbook; larger ones are refused."""
    sheets = {}
    for name, df in tables.items():
        rows = df.limit(REPORT_ROWS + 1).collect()
        if len(rows) > REPORT_ROWS:
            raise ValueError(f"{name} has more than {REPORT_ROWS} rows")
        sheets[name] = (df.columns, [tuple(r) for r in rows])
    spark = next(iter(tables.values())).sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(workbook(sheets)))
    finally:
        stream.close()
