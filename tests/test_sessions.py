from cueweave.operators import sessions


def test_sessions_by_file_name(spark):
    sheets = spark.createDataFrame([("Fight A", 0, 120, "Combat"), ("Talks A", 1, 200, "Elf"), ("Warden Hall", 2, 12, ""), ("Bandits", 3, 40, "Bandit Male"), ("Bandit War", 4, 30, "bandit combat")], "name string, sheet_index int, line_count int, voice_header string")
    audio = spark.createDataFrame([(n,) for n in ("WardenHall_pickup_row 7.wav", "bandit_BanditGeneric.wav", "CombatGenerics_SpeakingGenerics.wav", "x_generic_louder.wav", "misctabs.wav", "combat2.wav", "other.wav")], "name string")
    got = {r["audio"]: r for r in sessions.infer_sessions(audio, sheets).collect()}
    view = {k: (r["sheets"], r["needs_mapping_review"], r["pass"]) for k, r in got.items()}
    assert view["WardenHall_pickup_row 7.wav"] == (["Warden Hall"], False, "pickup") and got["WardenHall_pickup_row 7.wav"]["excel_rows"] == [7]
    assert view["bandit_BanditGeneric.wav"] == (["Bandits"], False, "main") or view["bandit_BanditGeneric.wav"][0] == ["Bandits"]
    assert view["CombatGenerics_SpeakingGenerics.wav"] == (["Fight A", "Talks A"], False, "speaking+combat")
    assert view["x_generic_louder.wav"] == (["Talks A", "Fight A"], True, "louder")
    assert view["combat2.wav"] == (["Fight A"], False, "combat")
    assert view["other.wav"][1] and len(view["other.wav"][0]) == 5
    assert view["misctabs.wav"][0] == ["Bandits", "Bandit War"]
    lines = spark.createDataFrame([("Warden Hall", 7, "l7"), ("Warden Hall", 8, "l8"), ("Talks A", 1, "s1")], "sheet string, excel_row int, line_id string")
    out = sessions.lines_for_sessions(sessions.infer_sessions(audio, sheets), lines).where("session_id like 'warden%'").collect()
    assert [(r["line_id"], r["line_index"]) for r in out] == [("l7", 0)]
    assert {(r["id"], r["violation"]) for r in sessions.mapping_violations(sessions.infer_sessions(audio, sheets), sheets).collect()} == {("x_generic_louder", "NEEDS_REVIEW"), ("other", "NEEDS_REVIEW")}
