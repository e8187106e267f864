"""Scores of many texts: the batch kernels against loops, and that their work stays bounded."""

import random
import time

from pyspark.sql import functions as F

from cueweave.functions import fuzzy
from cueweave.operators import assignment, intervals, prompts, spans, takes


def drawn(draw, n, letters="abcdefg é"):
    return "".join(draw.choice(letters) for _ in range(n))


def test_lines_in_one_integer_and_words_in_machine_words():
    draw = random.Random(1)
    lines = [drawn(draw, draw.randint(0, 200)) for _ in range(700)]  # several blocks
    said = [drawn(draw, n, "abcdxyz ") for n in (0, 1, 300)]
    for text in said:
        assert fuzzy.Lines(lines).similarities(text).tolist() == [fuzzy.similarity(x, text) for x in lines]
    pairs = [(x, y) for x in lines[:20] for y in said] + [("abc", "abd"), ("", "")]
    assert fuzzy.similarities(pairs) == [fuzzy.similarity(*p) for p in pairs]
    words = [drawn(draw, draw.randint(1, 9), "abc") for _ in range(30)] + ["", "ab" * 32, "ba" * 33]
    assert fuzzy.ratios(words, words[::-1]).tolist() == [[fuzzy.ratio(x, y) for y in words[::-1]] for x in words]


def test_all_windows_of_long_texts_at_once():
    draw = random.Random(2)
    pairs = [(drawn(draw, draw.randint(0, 12), "ab "), drawn(draw, draw.randint(0, 12), "ab ")) for _ in range(400)]
    assert fuzzy.partial_ratios(pairs) == [fuzzy.partial_ratio(*p) for p in pairs]
    a, b = drawn(draw, 1500), drawn(draw, 4000)
    began = time.time()
    score = fuzzy.partial_ratio(a, b)
    assert time.time() - began < 10  # windows one by one take minutes
    assert score >= max(fuzzy.ratio(a, b[i : i + 1500]) for i in range(0, 2501, 250))


def test_edits_of_tables_together_are_those_of_each():
    draw = random.Random(3)
    rows = [[[drawn(draw, draw.randint(1, 5), "abc") for _ in range(draw.randint(0, 20))] for _ in range(2)] for _ in range(60)]
    tables = [fuzzy.TokenCosts(*r).match for r in rows]
    assert fuzzy.edits(tables) == [fuzzy.token_operations(*r) for r in rows]
    pairs = [(" ".join(e), " ".join(o)) for e, o in rows]
    assert fuzzy.fidelities(pairs) == [fuzzy.fidelity(*p) for p in pairs]
    given = [(e[:3] + [" ".join(e[3:])], [1, 1, 1, 2], " ".join(o)) for e, o in rows if len(e) > 3]
    assert fuzzy.sentence_fidelities(given) == [fuzzy.sentence_fidelity(*g) for g in given]


def test_best_line_is_that_of_margins_over_all_rows(spark):
    draw = random.Random(4)
    lines = [(i, i, drawn(draw, draw.randint(1, 12), "ab ")) for i in range(12)]
    spans = [(draw.randint(0, 3), f"s{draw.randint(0, 25)}", drawn(draw, draw.randint(0, 12), "ab ")) for _ in range(40)]  # ids repeat
    held = spark.createDataFrame(spans, "session_id int, segment_id string, transcript string")
    script = assignment.matchable_lines(spark.createDataFrame(lines, "line_id int, line_index int, line string"))
    got = {r[0]: tuple(r)[1:] for r in assignment.best_line(held, script, ["segment_id"], "line_id").collect()}
    rows = assignment.with_margin(assignment.line_scores(held, script), ["segment_id"])
    want = assignment.top_per_group(rows, ["segment_id"], 1, F.desc("match_score"), F.asc("line_index")).select("segment_id", "line_index", "line_id", "match_score", "confidence_margin").collect()
    assert got == {r[0]: tuple(r)[1:] for r in want} and len(got) == len({s[1] for s in spans})


def test_a_session_of_many_texts_is_scored_in_many_tasks(spark):
    turns = spark.createDataFrame([(0, f"s{i}", f"we go to the {i} now") for i in range(200)], "session_id int, segment_id string, transcript string")
    lines = spark.createDataFrame([(0, i, f"go to the {i}") for i in range(20)], "session_id int, line_index int, line string")
    plan = prompts.prompt_candidates(turns, lines, 40, 3)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_long_edits_are_dealt_into_few_buckets(spark):
    hour = 48_000 * 3600
    base = [("s", i * hour, (i + 30) * hour, i) for i in range(400)]
    edits = [("s", i * hour + 5, (i + 30 + i % 3) * hour, i % 4) for i in range(400)]
    began = time.time()
    out = spans.manual_segments(spark.createDataFrame(edits, "session_id string, start_sample long, end_sample long, line_id long"), spark.createDataFrame(base, "session_id string, start_sample long, end_sample long, base_index int")).collect()
    assert time.time() - began < 30  # in buckets of a minute each interval has 1,800 rows, and each bucket all pairs
    got = {(r["start_sample"], r["end_sample"]): r["base_indices"] for r in out}
    assert got == {(a, b): [i for _, x, y, i in base if a < y and b > x] for _, a, b, _ in edits}


def test_roots_by_bisection_are_those_of_a_loop():
    draw = random.Random(5)
    for _ in range(200):
        a = [draw.randint(0, 40) for _ in range(draw.randint(1, 30))]
        b = [x + draw.randint(1, 9) for x in a]
        by = [float(draw.randint(0, 3)) for _ in a]
        shared = lambda i, j: max(0, min(b[i], b[j]) - max(a[i], a[j]))  # noqa: B023, E731
        roots = []
        for i in range(len(a)):
            if not any(shared(i, r) for r in roots):
                roots.append(i)
        assert takes.root_of(a, b, by) == [min(roots, key=lambda r: (-shared(i, r), abs(a[i] + b[i] - a[r] - b[r]), by[r], r)) for i in range(len(a))]


def test_nodes_without_length_are_still_grouped(spark):
    rows = [(1, f"x{i}", "s", 50.0 + i, 0.0, False, i, at, end, alone, False) for i, (at, end, alone) in enumerate([(1.0, 4.0, 1.0), (2.0, 2.0, 0.5), (3.0, 6.0, 0.0), (None, 5.0, 0.0)])]
    df = spark.createDataFrame(rows, "line_id int, segment_id string, session_id string, score double, selection_score double, manual_edit boolean, ordinal int, start_seconds double, end_seconds double, isolation double, repeated boolean")
    timed = {r["segment_id"]: r["group"] for r in takes.take_groups(df.where("start_seconds is not null")).collect()}
    assert timed == {"x0": 1, "x1": 2, "x2": 1}


def test_nearest_sorts_shares_of_the_input(spark):
    rows = spark.createDataFrame([(k, float(i), i) for k in range(3) for i in range(9)], "k int, start double, id int")
    anchors = rows.select("k", F.col("start").alias("anchor_start"), F.col("id").alias("anchor_order")).where("id % 4 = 0")
    assert "REPARTITION_BY_NUM" in intervals.nearest(rows, anchors, ["k"])._jdf.queryExecution().executedPlan().toString()
