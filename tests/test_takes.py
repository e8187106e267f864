import random

from pyspark.sql import functions as F

from cueweave.operators import display, recovery, takes
from cueweave.settings import Settings


def test_budgets_against_a_loop(spark):
    draw = random.Random(2)
    rows = [(g, draw.randint(0, 5), draw.randint(0, 3), draw.randint(0, 20), i) for g in range(6) for i in range(draw.randint(1, 40))]
    df = spark.createDataFrame(rows, "g int, a int, b int, score int, i int").repartition(3)
    got = {(r["g"], r["i"]) for r in recovery.within_budgets(df, ["g"], "a", "b", F.struct(-F.col("score"), F.col("i")), 2, 5).collect()}
    want, had = set(), {}
    for g, a, b, score, i in sorted(rows, key=lambda r: (r[0], -r[3], r[4])):
        if had.get((g, "a", a), 0) < 2 and had.get((g, "b", b), 0) < 5:
            for k in ((g, "a", a), (g, "b", b)):
                had[k] = had.get(k, 0) + 1
            want.add((g, i))
    assert got == want


def test_take_groups_against_a_loop(spark):
    draw = random.Random(4)
    rows = []
    for line in range(25):
        for i in range(draw.randint(1, 9)):
            at = draw.randint(0, 12)
            rows.append((line, f"x{i}", draw.choice("st"), float(draw.randint(50, 99)), 0.0, False, i, float(at), float(at + draw.randint(1, 4)), draw.choice([0.0, 0.5, 2.0]), draw.random() < 0.2))
    df = spark.createDataFrame(rows, "line_id int, segment_id string, session_id string, score double, selection_score double, manual_edit boolean, ordinal int, start_seconds double, end_seconds double, isolation double, repeated boolean")
    got = {(r["line_id"], r["segment_id"]): (r["group"], r["place"]) for r in takes.take_groups(df).collect()}
    assert len(got) == len(rows)
    for line in range(25):
        mine, groups = [r for r in rows if r[0] == line], []
        order = lambda r: (-r[3], -r[4], r[5], r[6])
        for session in sorted({r[2] for r in mine}):
            nodes = {}
            for r in mine:
                if r[2] == session:
                    nodes.setdefault((r[7], r[8]), []).append(r)
            facts = []
            for span, rs in nodes.items():
                rs.sort(key=order)
                facts.append((not any(r[10] for r in rs), -(rs[0][3] + 4.0 * rs[0][9]), -rs[0][9], min(r[6] for r in rs), span))
            shared = lambda x, y: max(0.0, min(x[1], y[1]) - max(x[0], y[0]))
            roots = []
            for f in sorted(facts):
                if not any(shared(f[4], r[4]) for r in roots):
                    roots.append(f)
            held = {r[4]: [] for r in roots}
            for f in facts:
                if f[4] not in held:
                    owner = max(roots, key=lambda r: (shared(f[4], r[4]), -abs(sum(f[4]) - sum(r[4])), -r[1]))
                    held[owner[4]] += nodes[f[4]]
            groups += [nodes[span] + sorted(rest, key=order) for span, rest in held.items()]
        groups.sort(key=lambda g: min(r[6] for r in g))
        assert {r[1]: (k + 1, p + 1) for k, g in enumerate(groups) for p, r in enumerate(g)} == {s: v for (ln, s), v in got.items() if ln == line}


def test_pools_clauses_and_manual_candidates(spark):
    lines = spark.createDataFrame([("nonverbal", "AUTO_OK", 3), ("normal", "REVIEW", 0), ("normal", "AUTO_OK", 0), ("normal", "REVIEW", 1)], "t string, s string, n int")
    assert [r[0] for r in lines.select(display.shows_pool(F.col("t"), F.col("s"), F.col("n"))).collect()] == [True, True, False, False]
    one = spark.createDataFrame([(([50.0, 90.0, 90.0, 90.0], [1.0, 0.9, 0.9, 1.0], [9, 3, 9, 2]),), (([], [], []),)], "s struct<clause_scores:array<double>,clause_token_coverages:array<double>,clause_word_counts:array<int>>")
    assert [r[0] for r in one.select(recovery.missing_clauses(F.col("s"), Settings())).collect()] == [[0, 1], []]
    held = spark.createDataFrame([(1, "a", "s", [1], False)], "line_id int, segment_id string, session_id string, base_indices array<int>, manual boolean")
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "c"), (2, "a"), (2, "gone")], "line_id int, segment_id string")
    segments = spark.createDataFrame([("a", "s", [1]), ("b", "s", [1]), ("c", "s", [2])], "segment_id string, session_id string, base_indices array<int>")
    got = sorted((r["line_id"], r["segment_id"], r["manual"]) for r in display.with_manual_candidate(held, wanted, segments).collect())
    assert got == [(1, "a", False), (1, "c", True), (2, "a", True)]
