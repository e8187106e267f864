import random

import pytest
from pyspark.sql import functions as F

from cueweave.functions import fuzzy, scoring
from cueweave.functions import text as T
from cueweave.settings import DEFAULTS, Settings, merged


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t")).alias("x")).collect()]


def test_common_length_and_partial_ratio_against_brute_force():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ("".join(draw.choice("abc ") for _ in range(draw.randint(0, 12))) for _ in range(2))
        assert fuzzy.common_length(a, b) == lcs(a, b)
        if a and b:
            s, long = sorted((a, b), key=len)
            best = max(200 * lcs(s, long[i:j]) / (len(s) + j - i) for i in range(len(long)) for j in range(i + 1, len(long) + 1) if j - i == len(s) or (j - i < len(s) and (i == 0 or j == len(long))))
            assert fuzzy.partial_ratio(a, b) == pytest.approx(best)


def test_token_operations_cost_what_the_cheapest_edits_cost():
    ops = fuzzy.token_operations("the cat sat on the mat".split(), "well the cats sat the mat now".split())
    assert [o for o, _, _ in ops] == ["insert", "match", "match", "match", "delete", "match", "match", "insert"]
    assert fuzzy.edge_edits([o for o, _, _ in ops]) == {"leading_missing_token_count": 0, "leading_extra_token_count": 1, "leading_substitution_count": 0, "trailing_missing_token_count": 0, "trailing_extra_token_count": 1, "trailing_substitution_count": 0}
    assert fuzzy.edge_edits(["delete", "insert"])["trailing_extra_token_count"] == 1
    empty = fuzzy.fidelity("", "a b")
    assert empty["extra_word_count"] == 2 and empty["token_coverage"] == 0.0


def test_text_forms(spark):
    assert one(spark, T.normalized, "It’s  a Test_1 — é!", None, "") == ["it's a test_1 é", "", ""]
    assert one(spark, T.spoken, "I can't; we'd've gonna y'all'll 'em won't shouldn't", "plain words") == ["i can not we'd have going to y'all will them will not should not", "plain words"]
    assert one(spark, T.folded, "Um, well uh no") == ["hesitation well hesitation no"]
    assert one(spark, T.verbal, "(sighs) Go [door]  now") == ["Go now"]
    assert one(spark, T.is_vocalization, "(grunt)", "Oof!", "Oof there", " (a) b", "(x)\n") == [True, True, False, False, True]
    assert one(spark, T.is_paralinguistic, "ha haha hmmm", "ha no", "") == [True, False, False]
    assert one(spark, T.clauses, "I... err... I misspoke. Maybe over here... No, nothing.", "", "Um. Go.") == [["I err I misspoke", "Maybe over here", "No, nothing"], [], ["Um Go"]]
    assert one(spark, T.slug, "Élan Vital--2", "…") == ["elan_vital_2", "item"]
    assert one(spark, T.row_ranges, "12, 18-20,13", "5-3", "x", "", "0") == [[12, 13, 18, 19, 20], None, None, [], None]
    assert one(spark, lambda c: T.written_rows(T.row_ranges(c)), "1,2,3,7,9-10", "4") == ["1-3, 7, 9-10", "4"]
    assert one(spark, lambda c: T.target_filename(c)["name"], " a ", "b.WAV", "x/y", "c.mp3", "") == ["a.wav", "b.WAV", None, None, None]
    assert one(spark, T.context_display, "Used in multiple contexts:\nA\nused in  MULTIPLE contexts:\nB") == ["Used in multiple contexts:\nA\nB"]
    assert one(spark, T.capitalised, "The Éa Bob's tall; Al Tim-Tom I You") == [["Bob's", "Tim-Tom"]]


@pytest.mark.parametrize(("expected", "observed"), [("I'm here", "I am here"), ("We're gonna go", "we are going to go"), ("can't", "can not"), ("It's late", "it is late")])
def test_spoken_forms_score_full(spark, expected, observed):
    df = spark.createDataFrame([(expected, observed)], "e string, o string")
    assert df.select(fuzzy.similarity_of(T.folded(F.col("e"), cues=True), T.folded(F.col("o")))).first()[0] == 100.0


def test_clause_agreement_and_reasons(spark):
    line = "Stand back from the gate. Nobody may enter the city tonight."
    texts = [line, "Nobody may enter the city tonight. Stand back from the gate.", "Stand back from the gate", "well well Stand back from the gate. Nobody may enter the city tonight.", "Stand back from the gate. Nobody may enter the city tonight okay then"]
    df = spark.createDataFrame([(i, line, t) for i, t in enumerate(texts)], "i int, e string, o string")
    cs = T.clauses(F.col("e"))
    said = df.select("i", "e", T.folded(F.col("o")).alias("o"), T.folded(F.col("e"), cues=True).alias("x"), F.transform(cs, lambda c: T.folded(c)).alias("cs"), F.transform(cs, lambda c: T.word_count(c)).alias("ns"), T.spoken_count(F.col("e")).alias("n")).localCheckpoint()
    scored = said.withColumn("m", fuzzy.similarity_of(F.col("x"), F.col("o"))).withColumn("f", fuzzy.fidelity_of(F.col("x"), F.col("o"))).withColumn("s", fuzzy.sentence_fidelity_of(F.col("cs"), F.col("ns"), F.col("o")))
    reason = scoring.reliability_reason(F.col("e"), F.col("n"), F.col("m"), F.lit(50.0), F.col("f"), F.col("s"), Settings())
    got = [r[0] for r in scored.select("i", reason.alias("r")).orderBy("i").select("r").collect()]
    assert got == ["", "LOW_MATCH_SCORE", "LOW_MATCH_SCORE", "EXTRA_LINE_START", "EXTRA_LINE_END"]


def test_scores(spark):
    row = spark.range(1).select(
        scoring.technical_score(F.lit(1), F.lit(float("-inf")), F.lit(None).cast("double"), F.lit(0.5)).alias("a"),
        scoring.technical_score(F.lit(0), F.lit(-3.0), F.lit(-20.0), F.lit(None).cast("double")).alias("b"),
        scoring.sample_of(F.lit(2.5), F.lit(1)).alias("c"),
        scoring.shared_time(F.lit(0.0), F.lit(10.0), F.lit(9.0), F.lit(30.0)).alias("d"),
        scoring.duration_plausibility(F.lit(27), F.lit(0.0), F.lit(10.0)).alias("e"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (0.0, 100.0, 2, 0.0) and row["e"] == pytest.approx(100.0)


def test_settings():
    assert len(DEFAULTS) == 49 and Settings().short_line_min_score == 88.0
    assert merged({"short_line": {"min_score": 90}}).short_line_min_score == 90
    for bad in ({"reliable_min_score": 120}, {"duplicate_line_policy": "x"}, {"candidate_top_k": 1.5}, {"auto_reject_clipping": 1}):
        with pytest.raises(ValueError):
            Settings(**bad)
    with pytest.raises(KeyError):
        Settings(nothing=1)
    with pytest.raises(AttributeError):
        Settings().candidate_top_k = 3
