import io
import math
import zipfile

import numpy as np
import pytest

from cueweave.sources import tables, wav, workbook


def tone(seconds, rate=48000, spans=((0.25, 0.9), (1.4, 2.05))):
    t = np.arange(int(seconds * rate)) / rate
    on = np.zeros(len(t), bool)
    for a, b in spans:
        on |= (t >= a) & (t < b)
    return np.rint(8000 * np.sin(2 * np.pi * 440 * t) * on).astype(np.int64)[:, None]


def test_wav_kernels():
    s = tone(2.5)
    w = wav.parse(wav.written(s, 48000))
    assert (w.rate, w.channels, w.bits, w.frames) == (48000, 1, 16, 120000) and (w.samples() == s).all()
    found = wav.silences(s, 48000)
    assert [(round(a, 1), round(b, 1)) for a, b in found] == [(0.0, 0.2), (0.9, 1.4), (2.1, 2.5)] or len(found) == 3
    b = wav.quietest_boundary(s, 48000, 48000, 43200, 67200)
    assert 43200 <= b <= 67200 and wav.first_quiet_boundary(s, 48000, 12000, 60000) >= 43000
    part = wav.cut(s, 48000, 12000, 43200)
    assert len(part) == 31200 and part[0, 0] == 0 and abs(part[-1, 0]) == 0
    m = wav.metrics(np.full((10, 1), 32767), 10)
    assert m["clipping_samples"] == 10 and m["peak_dbfs"] == pytest.approx(0, abs=1e-3) and wav.metrics(np.zeros((4, 1)), 4)["rms_dbfs"] == -math.inf
    with pytest.raises(ValueError):
        wav.parse(b"RIFFxxxxWAVE")


def test_inventory_and_cuts(spark, tmp_path):
    (tmp_path / "b.wav").write_bytes(wav.written(tone(1.0), 48000))
    (tmp_path / "A.wav").write_bytes(b"nothing")
    rows = wav.inventory(spark, str(tmp_path)).collect()
    assert [r["name"] for r in rows] == ["A.wav", "b.wav"] and rows[0]["shape"]["error"] and rows[1]["shape"]["frame_count"] == 48000
    df = tables.files(spark, str(tmp_path), "b.wav").selectExpr("content", "12000L as start_sample", "24000L as end_sample")
    assert wav.cut_metrics(df).first()["metrics"]["frame_count"] == 12000


def xlsx(rows):
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(64 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r, 1) if v) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Main" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook_with_two_sections(spark, tmp_path):
    rows = [["x"], ["Quest", "Line to speak", "Filename"], ["Q1", "Hello.", "a"], ["", "Again.", "b"], [], ["File name", "Acting note", "Dialogue"], ["c", "shout", ""], ["d", "", "Bye"]]
    (tmp_path / "s.xlsx").write_bytes(xlsx(rows))
    got = {r["line_id"]: (r["quest"], r["line"], r["target_filename"]) for r in workbook.read_script(spark, str(tmp_path)).collect()}
    assert got == {"Main::R3": ("Q1", "Hello.", "a"), "Main::R4": ("Q1", "Again.", "b"), "Main::R7": ("", "shout", "c"), "Main::R8": ("", "Bye", "d")}


def test_ods_counts_repeats(spark, tmp_path):
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    cell = lambda v: f"<table:table-cell><text:p>{v}</text:p></table:table-cell>"
    row = lambda *v: f"<table:table-row>{''.join(map(cell, v))}</table:table-row>"
    body = row("Topic", "Response text", "Filename") + row("t", "One<text:s text:c=\"2\"/>two", "a") + '<table:table-row table:number-rows-repeated="1048572"><table:table-cell table:number-columns-repeated="9"/></table:table-row>' + row("", "Last", "b")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f'<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="E">{body}</table:table></office:spreadsheet></office:body></office:document-content>')
    (tmp_path / "s.ods").write_bytes(out.getvalue())
    got = [(r["line_id"], r["context"], r["line"]) for r in workbook.read_script(spark, str(tmp_path)).orderBy("excel_row").collect()]
    assert got == [("E::R2", "t", "One  two"), ("E::R1048575", "", "Last")]
