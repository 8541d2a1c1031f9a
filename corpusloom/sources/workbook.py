"""Workbooks of paper records in, report sheets out.

A workbook is a zip of XML parts. Each file is read by one task (``binaryFile``), as a sheet of a review
is small; many files are read side by side.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.papers import ALIASES, blank_to_null, sheet_type, year_of

#: Further accepted column names, in order of priority.
LIBRARY = ["Library", "library", "Source", "source", "Base de Dados"]
KEYWORDS = ["Keywords", "keywords", "Palavra-Chave", "Palavra-Chaves"]
DETECTED = ["Detected_Source", "Source_File", "source_file", "Source File", "Library", "source"]
GL_ABSTRACT = [*ALIASES["abstract"], "Summary", "summary"]

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, sheet_no int, sheet string, row int, cells map<string,string>"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = 26 * n + ord(c) - 64
    return n


def sheets(content: bytes) -> Iterator[tuple[int, str, int, dict[str, str]]]:
    """(sheet number, sheet name, row from 0, header to cell); the first row is the header, empty cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")):
            target = targets[sheet.get(_REL)]
            header: dict[int, str] | None = None
            at = 0
            for row in ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_NS}row"):
                cells = {}
                for place, c in enumerate(row.iter(f"{_NS}c"), 1):
                    value = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else c.findtext(f"{_NS}v")
                    if value is not None:
                        cells[_column(c.get("r")) if c.get("r") else place] = shared[int(value)] if c.get("t") == "s" else value
                if header is None:
                    header = cells
                    continue
                yield number, sheet.get("name"), at, {header[k]: v for k, v in cells.items() if k in header}
                at += 1


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            yield pd.DataFrame([(path, *r) for r in sheets(content)], columns=["path", "sheet_no", "sheet", "row", "cells"])


def _first(names: list[str]) -> Column:
    """The first of the cells that are there; an empty string counts."""
    return F.coalesce(*[F.col("cells")[n] for n in names])


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Papers of all sheets named after white or grey literature; others are left out.

    Rows whose year is no number are dropped. Missing ids and titles are made from the row's number, and of several files
    also from the file's, in order of their paths; so are ordinals.
    """
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path")
    named = [r["path"] for r in files.collect()]  # names alone, a row a file
    cells = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_cells, CELLS)
    typed = cells.withColumn("source_type", sheet_type(F.col("sheet"))).where("source_type is not null")
    wl = F.col("source_type") == "WL"
    number = spark.createDataFrame([(p, i) for i, p in enumerate(named)], "path string, file_no long")
    typed = typed.join(number, "path")
    name = F.concat("source_type", F.lit("-"), F.col("row") + 1)
    if len(named) > 1:
        name = F.concat(name, F.lit("@"), F.col("file_no") + 1)
    raw_year = _first(ALIASES["year"])
    abstract = F.when(wl, blank_to_null(_first(ALIASES["abstract"]))).otherwise(blank_to_null(_first(GL_ABSTRACT)))
    kept = F.when(wl, F.create_map(F.lit("Library"), blank_to_null(_first(LIBRARY)), F.lit("Keywords"), blank_to_null(_first(KEYWORDS)), F.lit("Sheet"), F.col("sheet")))
    metadata = kept.otherwise(F.create_map(F.lit("Detected_Source"), blank_to_null(_first(DETECTED)), F.lit("Sheet"), F.col("sheet")))
    return typed.where(raw_year.isNull() | year_of(raw_year).isNotNull()).select(
        (F.col("file_no") * (1 << 34) + F.col("sheet_no").cast("long") * (1 << 24) + F.col("row")).alias("ordinal"), F.coalesce(_first(ALIASES["id"]), name).alias("id"),
        F.coalesce(blank_to_null(_first(ALIASES["title"])), F.concat(F.lit("Untitled "), name)).alias("title"), F.coalesce(abstract, F.lit("")).alias("abstract"),
        blank_to_null(_first(ALIASES["url"])).alias("url"), year_of(raw_year).alias("publication_year"), "source_type", F.map_filter(metadata, lambda _, v: v.isNotNull()).alias("metadata"),
    )


#: Rows that the format allows a sheet, and what XML doesn't allow in a text.
MOST_ROWS = 1_048_576
_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
#: Style of a header, and of a cell by what it holds.
_HEADER, _STYLES = 1, {"YES": 2, "INCLUDED": 2, "NO": 3, "EXCLUDED": 3, "NEEDS_REVIEW": 4}
_COLOURS = ("1F3864", "C6EFCE", "FFC7CE", "FFEB9C")


def _row_xml(number: int, row: list[object], styles: list[int]) -> str:
    cells = []
    for v, style in zip(row, styles, strict=True):
        mark = f' s="{style}"' if style else ""
        cells.append(f'<c{mark} t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", str(v)))}</t></is></c>' if v is not None else f"<c{mark}/>")
    return f'<row r="{number}">{"".join(cells)}</row>'


def _sheet_parts(header: list[str], rows: Iterator[list[object]], filled: set[int]) -> Iterator[str]:
    """The sheet's XML in parts, a row at a time; columns in ``filled`` are coloured by what they hold."""
    yield f'<worksheet xmlns="{_NS[1:-1]}"><sheetData>{_row_xml(1, list(header), [_HEADER] * len(header))}'
    for n, row in enumerate(rows, 2):
        if n > MOST_ROWS:
            raise ValueError(f"a sheet has {MOST_ROWS} rows at most; write CSV instead")
        yield _row_xml(n, row, [_STYLES.get(v, 0) if i in filled else 0 for i, v in enumerate(row)])
    yield "</sheetData></worksheet>"


def _styles_xml() -> str:
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in _COLOURS)
    formats = '<xf fontId="0" fillId="0"/><xf fontId="1" fillId="2" applyFill="1" applyFont="1"/>' + "".join(f'<xf fontId="0" fillId="{i}" applyFill="1"/>' for i in range(3, 6))
    return f'<styleSheet xmlns="{_NS[1:-1]}"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="6"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5">{formats}</cellXfs></styleSheet>'


def write_workbook(tables: dict[str, DataFrame], path: str, headers: dict[str, list[str]] | None = None, filled: tuple[str, ...] = ()) -> None:
    """A report of one sheet a table, for people, on the driver's disk: rows go through the driver a partition at a time and into the file one by one.

    ``headers`` names columns otherwise than the table; columns in ``filled`` are coloured by their decision.
    """
    office = _REL[1:].rsplit("}", 1)[0]
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(tables) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        named = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(tables, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS[1:-1]}" xmlns:r="{office}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tables) + 1))
        links += f'<Relationship Id="rId{len(tables) + 1}" Type="{office}/styles" Target="styles.xml"/>'
        z.writestr("xl/styles.xml", _styles_xml())
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, df in enumerate(tables.values(), 1):
            header = (headers or {}).get(list(tables)[i - 1], df.columns)
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                for part in _sheet_parts(header, map(list, df.toLocalIterator()), {k for k, c in enumerate(df.columns) if c in filled}):
                    out.write(part.encode())


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with a header each, written side by side."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
