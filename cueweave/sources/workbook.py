"""Dialogue workbooks (xlsx, ods) as tables: raw cells first, then headers and rows as window expressions."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The columns' names in headers.
HEADERS = {
    "quest": ("quest",),
    "context": ("context", "topic text"),
    "context_fallback": ("topic",),
    "line": ("line to speak", "line", "dialogue", "text", "response text"),
    "acting_note": ("acting note", "acting notes", "note", "script notes"),
    "emotion": ("facial emotion", "emotion"),
    "filename": ("filename", "file name", "output filename"),
    "voice_type": ("voice type", "voicetype"),
}
CELLS = "path string, sheet string, sheet_index int, row int, col int, value string, is_ods boolean"
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_T = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_X = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_O = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref).group():
        n = n * 26 + ord(c) - 64
    return n


def xlsx_cells(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for k, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet")):
            target = targets[sheet.get(_R)].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for i, row in enumerate(root.iter(f"{_M}row"), 1):
                for j, c in enumerate(row.iter(f"{_M}c"), 1):
                    kind, v = c.get("t"), c.find(f"{_M}v")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                    elif v is None or v.text is None:
                        continue
                    else:
                        value = shared[int(v.text)] if kind == "s" else v.text
                    yield sheet.get("name"), k, int(row.get("r") or i), _column(c.get("r") or "") or j, value, False


def _ods_text(e: ET.Element) -> str:
    out = e.text or ""
    for c in e:
        out += {f"{_X}s": " " * int(c.get(f"{_X}c", "1")), f"{_X}tab": "\t", f"{_X}line-break": "\n"}.get(c.tag, "") or _ods_text(c)
        out += c.tail or ""
    return out


def ods_cells(content: bytes) -> Iterator[tuple]:
    """Repeats are counted, not written out, where the cell is empty; so a million empty rows cost nothing."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("content.xml"))
    for k, sheet in enumerate(root.iter(f"{_T}table")):
        row = 0
        for r in sheet.iter(f"{_T}table-row"):
            times, cells, col = int(r.get(f"{_T}number-rows-repeated", "1")), [], 0
            for c in r:
                if c.tag not in (f"{_T}table-cell", f"{_T}covered-table-cell"):
                    continue
                wide = int(c.get(f"{_T}number-columns-repeated", "1"))
                value = "\n".join(_ods_text(p) for p in c.findall(f"{_X}p"))
                for name in ("string-value", "value", "date-value", "time-value", "boolean-value"):
                    value = value or c.get(f"{_O}{name}") or ""
                if value:
                    cells += [(col + j + 1, value) for j in range(wide)]
                col += wide
            for i in range(times if cells else 0):
                for at, value in cells:
                    yield sheet.get(f"{_T}name"), k, row + i + 1, at, value, True
            row += times


def cells(files: DataFrame) -> DataFrame:
    """Raw cells of workbooks; files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                read = ods_cells if path.lower().endswith(".ods") else xlsx_cells
                yield pd.DataFrame([(path, *c) for c in read(content)], columns=["path", "sheet", "sheet_index", "row", "col", "value", "is_ods"])

    return files.select("path", "content").mapInPandas(run, CELLS)


def script_lines(raw: DataFrame) -> DataFrame:
    """(line_id, sheet, sheet_index, excel_row, quest, context, line, acting_note, emotion, target_filename).

    A row that names a line and a filename column is a header: it binds columns until the next one, and clears the
    quest, which otherwise holds on from row to row. Of several columns of a name the last counts. Rows without line and
    filename are skipped; a blank line takes the acting note.
    """
    pairs = [(a, name) for name, aliases in HEADERS.items() for a in aliases]
    alias = F.create_map(*[F.lit(x) for p in pairs for x in p])
    plain = F.trim(F.regexp_replace(F.lower(F.trim("value")), r"\s+", " "))
    named = raw.withColumn("name", F.try_element_at(alias, plain))
    sheet = ["path", "sheet", "sheet_index"]
    heads = named.where("name is not null").groupBy(*sheet, "row", "name").agg(F.max("col").alias("col")).groupBy(*sheet, "row").agg(F.map_from_entries(F.collect_list(F.struct("name", "col"))).alias("head"))
    heads = heads.where(F.map_contains_key("head", "line") & F.map_contains_key("head", "filename"))
    rows = raw.groupBy(*sheet, "row", "is_ods").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("cell"))
    order = W.partitionBy(*sheet).orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    bound = rows.join(heads, [*sheet, "row"], "left").withColumn("is_head", F.col("head").isNotNull())
    bound = bound.withColumn("section", F.sum(F.col("is_head").cast("int")).over(order)).withColumn("head", F.last("head", True).over(order)).where("head is not null and not is_head")
    value = lambda n: F.trim(F.coalesce(F.try_element_at("cell", F.try_element_at("head", F.lit(n))), F.lit("")))
    bound = bound.select(*sheet, "row", "section", "is_ods", *[value(n).alias(n) for n in HEADERS])
    within = W.partitionBy(*sheet, "section").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    bound = bound.withColumn("quest", F.coalesce(F.last(F.nullif("quest", F.lit("")), True).over(within), F.lit("")))
    spoken = F.coalesce(F.nullif("line", F.lit("")), F.col("acting_note"))
    out = bound.where("line <> '' or filename <> ''").select(F.format_string("%s::R%d", "sheet", "row").alias("line_id"), "sheet", "sheet_index", F.col("row").alias("excel_row"), "quest", F.coalesce(F.nullif("context", F.lit("")), F.col("context_fallback")).alias("context"), spoken.alias("line"), "acting_note", "emotion", F.col("filename").alias("target_filename"))
    return out


def script_violations(lines: DataFrame) -> DataFrame:
    """(line_id, violation): half-blank rows, and file names used more than once."""
    half = lines.where("line = '' or target_filename = ''").select("line_id", F.lit("HALF_BLANK_ROW").alias("violation"))
    many = lines.where("target_filename <> ''").withColumn("n", F.count("*").over(W.partitionBy("target_filename"))).where("n > 1").select("line_id", F.lit("DUPLICATE_FILENAME").alias("violation"))
    return half.unionByName(many)


def read_script(spark: SparkSession, folder: str, pattern: str = "*.{xlsx,xlsm,ods}") -> DataFrame:
    from .tables import files

    return script_lines(cells(files(spark, folder, pattern)))
