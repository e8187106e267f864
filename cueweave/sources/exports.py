"""Files out: JSON and reports replaced in one step, retake workbooks, and the takes that a review chose.

Reports and workbooks hold a row a script line and are written by the driver; takes are copied by the executors. All
paths are of a folder that driver and executors share.
"""

from __future__ import annotations

import csv
import filecmp
import io
import json
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import review as R

#: The reports' columns, and the retake list's headers.
ERROR_COLUMNS = ("line_id", "error", "detail")
EXPORT_COLUMNS = ("line_id", "target_filename", "selected_segment_id", "segment_file", "output_file", "source_audio", "start_seconds", "end_seconds", "transcript")
RETAKE_HEADERS = {"shown_quest": "Quest", "context": "Context", "line": "Line to speak", "acting_note": "Acting note", "emotion": "Facial emotion", "target_filename": "Filename"}
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _replaced(path: str, write: Callable[[str], object]) -> None:
    """write(a new path beside `path`), then that file in the place of `path`: readers see the old or the new one."""
    folder, name = os.path.split(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    beside = os.path.join(folder, f".{name}.{uuid.uuid4().hex}.tmp")
    try:
        write(beside)
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.unlink(beside)


def write_json(path: str, value: object) -> None:
    """One JSON document."""

    def write(to: str) -> None:
        with open(to, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
            f.flush()
            os.fsync(f.fileno())

    _replaced(path, write)


def write_report(rows: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """One tab-separated file with a byte order mark and a header; rows come a partition at a time, nulls are empty."""

    def write(to: str) -> None:
        with open(to, "w", encoding="utf-8-sig", newline="") as f:
            out = csv.writer(f, delimiter="\t")
            out.writerow(columns)
            out.writerows(rows.select(*columns).toLocalIterator())

    _replaced(path, write)


def _letters(n: int) -> str:
    return (_letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)


def _cell(ref: str, value: object) -> str:
    plain = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(value))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(plain)}</t></is></c>'


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of text cells; a filter covers each sheet's rows. Null and empty cells are left out; equal input, equal bytes."""
    files = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    named: list[str] = []
    for k, (name, rows) in enumerate(sheets.items(), 1):
        short = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
        while short.lower() in map(str.lower, named):
            short = f"{short[:26]}~{k}" if not short.endswith(f"~{k}") else f"{short[:25]}_~{k}"
        named.append(short)
        body = "".join(f'<row r="{i}">' + "".join(_cell(f"{_letters(j)}{i}", v) for j, v in enumerate(r, 1) if v not in (None, "")) + "</row>" for i, r in enumerate(rows, 1))
        covered = f'<autoFilter ref="A1:{_letters(len(rows[0]))}{len(rows)}"/>' if rows and rows[0] else ""
        files[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData>{covered}</worksheet>'
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(named, 1))
    files["xl/workbook.xml"] = f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_retakes(review: DataFrame, lines: DataFrame, path: str) -> int:
    """The lines to record again as a workbook, a sheet for each of the script's that has any; returns their number."""
    sheets: dict[str, list[list]] = {}
    for row in R.retake_listing(review, lines).select("sheet", *RETAKE_HEADERS).toLocalIterator():
        sheets.setdefault(row["sheet"], [list(RETAKE_HEADERS.values())]).append([row[c] for c in RETAKE_HEADERS])

    def write(to: str) -> None:
        with open(to, "wb") as f:
            f.write(xlsx(sheets or {"Retakes": [list(RETAKE_HEADERS.values())]}))

    _replaced(path, write)
    return sum(len(rows) - 1 for rows in sheets.values())


def _placed(source: str, target: str, overwrite: bool) -> str | None:
    """Copies a file; why it couldn't, or nothing. A target of the same bytes counts as placed, so a task may be run again."""
    try:
        if os.path.exists(target) and filecmp.cmp(source, target, shallow=False):
            return None
        if os.path.exists(target) and not overwrite:
            return "OUTPUT_EXISTS"
        _replaced(target, lambda to: shutil.copyfile(source, to))
    except OSError as e:
        return f"COPY_FAILED: {e.strerror}"
    return None


def copied(plan: DataFrame, overwrite: bool = False) -> DataFrame:
    """(line_id, output_file, error) of plan (line_id, segment_file, output_file), each file copied by an executor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"line_id": b["line_id"], "output_file": b["output_file"], "error": [_placed(s, t, overwrite) for s, t in zip(b["segment_file"], b["output_file"])]})

    kind = plan.schema["line_id"].dataType.simpleString()
    return plan.select("line_id", "segment_file", "output_file").mapInPandas(run, f"line_id {kind}, output_file string, error string")


def finalized(review: DataFrame, segments: DataFrame, folder: str, expected: dict[str, int] | None = None, extension: str = ".wav", overwrite: bool = False, allow_incomplete: bool = False, allow_reuse: bool = False, dry_run: bool = False) -> tuple[int, int]:
    """Copies the selected takes to `folder` under their lines' names; returns the numbers of exports and errors.

    segments: export_errors' columns, and segment_file, source_audio, start_seconds, end_seconds, transcript. Both
    reports are always written; any error stops the copying unless allow_incomplete, and raises ValueError.
    """
    spark = review.sparkSession
    os.makedirs(folder, exist_ok=True)
    there = [] if overwrite else [(n,) for n in os.listdir(folder)]
    errors = R.export_errors(review, segments, spark.createDataFrame(there, "filename string"), expected, extension, allow_reuse).cache()
    name = T.target_filename(F.col("target_filename"), extension)["name"]
    chosen = R.exports(review, errors).withColumn("target_filename", name).withColumn("output_file", F.concat(F.lit(os.path.join(folder, "")), name))
    facts = segments.select(F.col("segment_id").alias("sid"), *[c for c in EXPORT_COLUMNS if c in segments.columns])
    plan = chosen.select("line_id", "target_filename", "selected_segment_id", "output_file").join(facts, F.col("selected_segment_id") == F.col("sid")).cache()
    bad, many = errors.count(), plan.count()
    try:
        write_report(errors.orderBy("line_id", "error"), os.path.join(folder, "finalization_errors.tsv"), ERROR_COLUMNS)
        write_report(plan.orderBy("line_id"), os.path.join(folder, "final_export_manifest.tsv"), EXPORT_COLUMNS)
        if bad and not allow_incomplete:
            raise ValueError(f"{bad} errors, listed in finalization_errors.tsv; allow_incomplete exports the rest")
        # An aggregate, so that every file is tried whatever fails.
        failed = None if dry_run else copied(plan, overwrite).agg(F.count("error").alias("n"), F.max("error").alias("error")).first()
        if failed and failed["n"]:
            raise OSError(f"{failed['n']} takes were not copied: {failed['error']}")
    finally:
        errors.unpersist()
        plan.unpersist()
    return many, bad
