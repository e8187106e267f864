import itertools
import random

from pyspark.sql import functions as F

from cueweave.operators import assignment, intervals, review, spans
from cueweave.functions import scoring
from cueweave.settings import Settings


def brute_path(start, count, utility, skip, n):
    """The best total over all sets of spans that don't overlap."""
    best = None
    for k in range(len(start) + 1):
        for rows in itertools.combinations(range(len(start)), k):
            used = [i for r in rows for i in range(start[r], start[r] + count[r])]
            if len(used) == len(set(used)):
                total = sum(utility[r] for r in rows) - skip * (n - len(used))
                best = total if best is None else max(best, total)
    return best


def test_best_path_against_all_subsets():
    draw = random.Random(3)
    for _ in range(60):
        found = sorted({(s, c) for s, c in ((draw.randint(0, 5), draw.randint(1, 3)) for _ in range(7)) if s + c <= 6})
        start, count = [s for s, _ in found], [c for _, c in found]
        utility = [draw.uniform(-4, 6) for _ in found]
        rows = assignment.best_path(start, count, utility, 2.2)
        used = [i for r in rows for i in range(start[r], start[r] + count[r])]
        assert len(used) == len(set(used))
        low, high = min(start), max(s + c for s, c in found)
        got = sum(utility[r] for r in rows) - 2.2 * (high - low - len(used))
        assert abs(got - brute_path([s - low for s in start], count, utility, 2.2, high - low)) < 1e-9
    assert assignment.best_path([0], [1], [-2.2], 2.2) == []  # leaving out wins ties


def segments(spark, texts, gap=0.2, length=2.0):
    rows = [(0, f"s{i}", t, i * (length + gap), i * (length + gap) + length, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "session_id int, segment_id string, transcript string, start_seconds double, end_seconds double, asr_probability double")


def test_takes_are_matched_in_any_order(spark):
    lines = spark.createDataFrame([(0, i, t) for i, t in enumerate(["The harbor is closed until morning.", "Bring me the silver lantern now.", "Nobody crosses the bridge tonight.", "(grunt)"])], "session_id int, line_index int, line string")
    said = ["nobody crosses the bridge tonight", "the harbor is closed until morning", "nobody crosses the bridge tonight", "bring me the silver lantern now"]
    out = assignment.align(segments(spark, said), lines, Settings()).orderBy("start_index").collect()
    assert [(r["start_index"], r["count"], r["line_index"]) for r in out] == [(0, 1, 2), (1, 1, 0), (2, 1, 2), (3, 1, 1)]
    assert all(r["match_score"] == 100.0 and r["confidence_margin"] > 30 for r in out)


def test_spans_are_those_of_a_loop_that_stops_at_the_first_invalid_one(spark):
    draw = random.Random(5)
    at, rows = 0.0, []
    for i in range(60):
        at += draw.choice([0.1, 0.5, 2.4, 3.0])
        end = at + draw.uniform(0.5, 12.0)
        rows.append((0, f"s{i:03}", "t", at, end, None))
        at = end
    s = Settings(max_merge_segments=5, fragment_join_max_segments=4)
    want = set()
    for i in range(60):
        for n in range(1, 6):
            if i + n > 60 or rows[i + n - 1][4] - rows[i][3] > 35.0 or any(b[3] - a[4] > 2.5 for a, b in zip(rows[i : i + n], rows[i + 1 : i + n])):
                break
            want.add((i, n))
    df = spark.createDataFrame(rows, segments(spark, ["x"]).schema)
    assert {(r["start_index"], r["count"]) for r in spans.enumerate_spans(df, s).collect()} == want


def test_word_gap_pieces():
    assert intervals._pieces(0.0, 10.0, [(0.5, 2.0), (0.4, 4.0), (0.3, 6.0)], 2, 20.0) == [2.0, 4.0]
    found = [(0.3 + i / 100, float(i)) for i in range(1, 30)]
    cuts = [0.0, *intervals._pieces(0.0, 30.0, found, 2, 8.0), 30.0]
    assert max(b - a for a, b in zip(cuts, cuts[1:])) <= 8.0


def test_padded_regions_meet_in_the_middle(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 1.25), (0, 1.2, 2.0, 1.05, 2.25)], "session_id int, speech_start double, speech_end double, start double, end double")
    got = intervals.without_overlaps(df).orderBy("speech_start").collect()
    assert round(got[0]["end"], 6) == round(got[1]["start"], 6) == 1.1


def test_regions_follow_a_loop_over_silences(spark):
    draw = random.Random(9)
    silences = sorted((round(draw.uniform(0, 50), 3), round(draw.uniform(0.05, 4), 3)) for _ in range(25))
    rows = [(0, a, a + d, d) for a, d in silences]
    got = intervals.regions_from_silences(spark.createDataFrame(rows, "session_id int, start double, end double, duration double"), spark.createDataFrame([(0, 60.0)], "session_id int, duration_seconds double"))
    at, want = 0.0, []
    for _, a, b, d in rows:
        if d >= 0.2:
            if max(at, a) - at >= 0.15:
                want.append((at, max(at, a)))
            at = max(at, b)
    if 60.0 - at >= 0.15:
        want.append((at, 60.0))
    assert [(r[1], r[2]) for r in got.orderBy("speech_start").collect()] == want


def test_nearest_anchor_prefers_the_first_on_ties(spark):
    rows = spark.createDataFrame([(0, "a", 5.0), (0, "b", 1.0), (1, "c", 3.0)], "k int, id string, start double")
    anchors = spark.createDataFrame([(0, 0.0, 1), (0, 10.0, 2)], "k int, anchor_start double, anchor_order int")
    got = {r["id"]: r["anchor"] and r["anchor"]["anchor_order"] for r in intervals.nearest(rows, anchors, ["k"]).collect()}
    assert got == {"a": 1, "b": 1, "c": None}


def shown(spark, lines):
    names = ["line_id", "segment_id", "session_id", "base_indices", "match_score", "selection_score", "reliable", "reliability_reason", "missing_clause_count", "fragment_join", "fragment_join_provisional", "ordinal"]
    rows = [(k, *c, i) for k, cs in enumerate(lines) for i, c in enumerate(cs)]
    kinds = ["long", "string", "string", "array<int>", "double", "double", "boolean", "string", "int", "boolean", "boolean", "int"]
    found = review.pruned(spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, kinds)))).collect()
    return [[r["segment_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["line_id"] == k] for k in range(len(lines))]


def candidate(i, score, bases, reliable=True, reason="", join=False, provisional=False, missing=0, selection=None):
    return i, "s", bases, float(score), float(score if selection is None else selection), reliable, reason, missing, join, provisional


def test_candidates_worth_showing(spark):
    assert shown(spark, [
        [candidate("a", 99, [1], False), candidate("b", 96, [2], False), candidate("c", 88, [3], False), candidate("d", 70, [4], False)],
        [candidate("a", 99, [1]), candidate("far", 60, [9]), candidate("over", 61, [1, 2])],
        [candidate("big", 95, [1, 2]), candidate("part", 90, [1])],
        [candidate("a", 95, [1]), candidate("bad", 94, [1, 2], False, "MISSING_LINE_END")],
        [candidate("a", 95, [1], False), candidate("j", 50, [2, 3], False, join=True)],
        [candidate("big", 95, [1, 2]), candidate("x", 94, [1]), candidate("x", 93, [5])],
    ]) == [["a", "b", "c"], ["a", "far"], ["big"], ["a"], ["a", "j"], ["big"]]


def test_candidates_against_a_step_by_step_model(spark):
    draw = random.Random(3)
    reasons = ["", "", "AMBIGUOUS_MATCH", "MISSING_LINE_END", "LOW_MATCH_SCORE"]
    lines = []
    for _ in range(150):
        cs = []
        for _ in range(draw.randint(1, 8)):
            at = draw.randint(0, 6)
            cs.append(candidate(f"x{draw.randint(0, 9)}", draw.choice([95, 90, 88, 80, 74, 60, 50, 40]), list(range(at, at + draw.randint(1, 3))), draw.random() < 0.4, draw.choice(reasons), draw.random() < 0.2, draw.random() < 0.5, draw.randint(0, 1), draw.choice([1, 2, 3])))
        lines.append(cs)

    def model(cs):
        best = sorted(range(len(cs)), key=lambda i: (-cs[i][3], -cs[i][4], i))
        one, ids = [], set()
        for i in best:
            if cs[i][0] not in ids:
                ids.add(cs[i][0])
                one.append(i)
        whole = lambda i: cs[i][5] or not (cs[i][7] or cs[i][6] in scoring.INCOMPLETE_REASONS)
        left = [i for k, i in enumerate(one) if not any(set(cs[i][2]) < set(cs[j][2]) and whole(j) for j in one[:k])]
        steps = [(cs[a][3] - cs[b][3], k, (cs[a][3] + cs[b][3]) / 2) for k, (a, b) in enumerate(zip(left, left[1:]))]
        cut = max([cs[left[0]][3] - 15.0] + [m for d, _, m in [max(steps)] if d >= 12.0] if steps else [cs[left[0]][3] - 15.0])
        on = {i for i in left if cs[i][3] >= cut}
        sure = lambda: {i for i in on if cs[i][5]}
        if not sure():
            on |= set(sorted((i for i in left if cs[i][8]), key=lambda i: (cs[i][9], left.index(i)))[:1])
        if not sure():
            on |= set([i for i in left if cs[i][5]][:1])
        meets = lambda i, j: bool(set(cs[i][2]) & set(cs[j][2]))
        for i in left:
            if cs[i][5] and i not in on and not any(meets(i, j) for j in sure()):
                on.add(i)
        return [cs[i][0] for i in left if i in on and (cs[i][5] or cs[i][6] not in scoring.INCOMPLETE_REASONS or not any(meets(i, j) for j in sure()))]

    assert shown(spark, lines) == [model(cs) for cs in lines]


def test_review_merge_and_status(spark):
    kept = review.pruned(spark.createDataFrame([("l1", "x", [1], 95.0, 95.0, True), ("l1", "y", [5], 94.9, 94.9, True), ("l2", "z", [2], 50.0, 50.0, False)], "line_id string, segment_id string, base_indices array<int>, match_score double, selection_score double, reliable boolean"))
    lines = spark.createDataFrame([("l1", "Go."), ("l2", "Stay here."), ("l3", "None."), ("l4", "(sigh)")], "line_id string, line string")
    got = {r["line_id"]: (r["status"], r["type"], r["selected_segment_id"]) for r in review.line_review(lines, kept).collect()}
    assert got == {"l1": ("AUTO_OK", "normal", "x"), "l2": ("REVIEW", "normal", None), "l3": ("MISSING", "normal", None), "l4": ("REVIEW", "nonverbal", None)}


def test_duplicate_rows_share_takes_in_order(spark):
    lines = spark.createDataFrame([(0, i, t) for i, t in ((0, "We march at dawn."), (1, "Other words."), (2, "We march at dawn!"))], "session_id int, line_index int, line string")
    at = [(0.0, 90.0), (3.0, 90.0), (100.0, 90.0), (104.0, 50.0)]
    actions = spark.createDataFrame([(0, i, 1, s, s + 2.0, 0, m) for i, (s, m) in enumerate(at)] + [(0, 9, 1, 300.0, 302.0, 1, 99.0)], "session_id int, start_index int, count int, start_seconds double, end_seconds double, line_index int, match_score double")
    got = {r["start_index"]: r["line_index"] for r in assignment.spread_over_duplicates(actions, lines, Settings()).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 9: 1}


def test_edit_sources_follow_chains_and_leave_out_cycles(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone"), ("w", "x"), *[(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(200)]], "segment_id string, edited_from_segment_id string")
    got = {r["segment_id"]: (r["source_id"], r["steps"]) for r in review.edit_sources(df).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "z": ("z", 0)} | {f"n{i:03}": ("n000", i) for i in range(200)}
    rows = spark.createDataFrame([(1,), (2,), (3,), (7,)], "n int").withColumn("k", F.lit("a"))
    assert sorted((r["first"], r["last"]) for r in intervals.islands(rows, ["k"], "n").collect()) == [(1, 3), (7, 7)]
