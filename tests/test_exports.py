import json
import os

import pytest

from cueweave.functions import fuzzy
from cueweave.operators import assignment, prompts
from cueweave.sources import exports, tables, workbook


def test_json_and_workbook_round_trips(spark, tmp_path):
    exports.write_json(str(tmp_path / "x" / "a.json"), {"é": [1, None]})
    assert json.loads((tmp_path / "x" / "a.json").read_text(encoding="utf-8")) == {"é": [1, None]} and os.listdir(tmp_path / "x") == ["a.json"]
    data = exports.xlsx({"One/Two": [["a", "b<&"], [None, " x\n\x01"]], "One:Two": [["z" * 3] + [""] * 27 + ["ab"]]})
    cells = list(workbook.xlsx_cells(data))
    assert cells == [("One_Two", 0, 1, 1, "a", False), ("One_Two", 0, 1, 2, "b<&", False), ("One_Two", 0, 2, 2, " x\n", False), ("One_Two~2", 1, 1, 1, "zzz", False), ("One_Two~2", 1, 1, 29, "ab", False)]
    assert data == exports.xlsx({"One/Two": [["a", "b<&"], [None, " x\n\x01"]], "One:Two": [["z" * 3] + [""] * 27 + ["ab"]]})


def test_retake_workbook_reads_back_as_a_script(spark, tmp_path):
    lines = spark.createDataFrame([(i, k, f"S{k}", i, q, "c", f"line {i}", None, "", f"f{i}") for i, k, q in [(3, 0, "q"), (4, 0, "q"), (5, 0, "r"), (6, 1, "q"), (7, 1, "q")]], "line_id int, sheet_index int, sheet string, excel_row int, quest string, context string, line string, acting_note string, emotion string, target_filename string")
    review = spark.createDataFrame([(i, "AUTO_OK" if i == 7 else "RETAKE") for i in range(3, 8)], "line_id int, status string")
    assert exports.write_retakes(review, lines, str(tmp_path / "r.xlsx")) == 4
    back = workbook.script_lines(workbook.cells(tables.files(spark, str(tmp_path), "r.xlsx"))).orderBy("sheet_index", "excel_row").collect()
    assert [(r["sheet"], r["quest"], r["line"], r["target_filename"]) for r in back] == [("S0", "q", "line 3", "f3"), ("S0", "q", "line 4", "f4"), ("S0", "r", "line 5", "f5"), ("S1", "q", "line 6", "f6")]
    assert exports.write_retakes(review.where("status = 'none'"), lines, str(tmp_path / "r.xlsx")) == 0


def test_finalized_copies_and_reports(spark, tmp_path):
    out = tmp_path / "final"
    for n in ("a", "b", "c"):
        (tmp_path / f"{n}.wav").write_bytes(n.encode() * 9)
    segments = spark.createDataFrame([(n, n != "c", f"{tmp_path}/{n}.wav", "s.wav", 0.5, None, "said\there") for n in "abc"], "segment_id string, file_exists boolean, segment_file string, source_audio string, start_seconds double, end_seconds double, transcript string")
    review = spark.createDataFrame([("1", "One", "AUTO_OK", "a"), ("2", "two.wav", "MANUALLY_REVIEWED", "b"), ("3", "three", "AUTO_OK", "c"), ("4", "four", "MISSING", None)], "line_id string, target_filename string, status string, selected_segment_id string")
    with pytest.raises(ValueError):
        exports.finalized(review, segments, str(out))
    assert sorted(os.listdir(out)) == ["final_export_manifest.tsv", "finalization_errors.tsv"]
    assert (out / "finalization_errors.tsv").read_bytes().decode("utf-8-sig") == "line_id\terror\tdetail\r\n3\tSEGMENT_FILE_MISSING\tc\r\n"
    assert exports.finalized(review, segments, str(out), allow_incomplete=True, dry_run=True) == (2, 1) and not (out / "One.wav").exists()
    assert exports.finalized(review, segments, str(out), allow_incomplete=True) == (2, 1)
    assert (out / "One.wav").read_bytes() == b"a" * 9 and (out / "two.wav").read_bytes() == b"b" * 9
    listed = (out / "final_export_manifest.tsv").read_bytes()
    assert listed[:3] == b"\xef\xbb\xbf" and listed.decode("utf-8-sig").splitlines()[1] == f'1\tOne.wav\ta\t{tmp_path}/a.wav\t{out}/One.wav\ts.wav\t0.5\t\t"said\there"'
    assert exports.finalized(review, segments, str(out), allow_incomplete=True) == (0, 3)  # both are there now
    (tmp_path / "a.wav").write_bytes(b"new")
    assert exports.finalized(review, segments, str(out), allow_incomplete=True, overwrite=True) == (2, 1) and (out / "One.wav").read_bytes() == b"new"


def test_copies_may_run_again(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"a")
    plan = lambda to: spark.createDataFrame([(1, f"{tmp_path}/a", f"{tmp_path}/{to}"), (2, f"{tmp_path}/none", f"{tmp_path}/y")], "line_id int, segment_file string, output_file string")
    error = lambda to: [r["error"] for r in exports.copied(plan(to)).orderBy("line_id").collect()]
    assert error("x") == error("x") == [None, "COPY_FAILED: No such file or directory"]
    (tmp_path / "z").write_bytes(b"other")
    assert error("z")[0] == "OUTPUT_EXISTS" and not [n for n in os.listdir(tmp_path) if n.endswith(".tmp")]


def test_prompts_and_script_scores_against_loops(spark):
    said = ["we go now", "stop there", "", None, "...", "ＷＥ go", "we go now"]
    script = ["We go now!", "Stop (angry) there", "(grunts)", "a much longer line of the script that has many words", "We go", "we go now", None]
    segments = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)] + [(2, 90, "we go")], "session_id int, segment_id int, transcript string")
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(script)], "session_id int, line_index int, line string")
    plain = {0: "we go now", 1: "stop there", 4: "we go", 5: "we go now"}
    heard = ["we go now", "stop there", None, None, "", "we go", "we go now"]
    got = {}
    for r in prompts.prompt_candidates(segments, lines, 5, 2).orderBy("segment_id", "rank").collect():
        got.setdefault(r["segment_id"], []).append(r["line_index"])
    want = {i: sorted(plain, key=lambda k: (-fuzzy.weighted_ratio(plain[k], t), k))[:2] if t is not None else [0, 1] for i, t in enumerate(heard)}
    assert got == want
    scores = {r["segment_id"]: r["script_score"] for r in prompts.best_script_score(segments, lines).collect()}
    every = [*plain.values(), script[3]]
    assert scores == {90: 0.0} | {i: max(fuzzy.ratio(p, t) for p in every) if t else 0.0 for i, t in enumerate(heard)}


def test_full_width_letters_score_as_their_plain_forms(spark):
    spans = spark.createDataFrame([(1, 0, "Ｗe ﬁnd it")], "session_id int, start_index int, transcript string")
    lines = assignment.matchable_lines(spark.createDataFrame([(1, 0, "we find it")], "session_id int, line_index int, line string"))
    assert assignment.line_scores(spans, lines).first()["match_score"] == 100.0
