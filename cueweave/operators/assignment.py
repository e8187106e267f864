"""Matching spans to script lines: scores, margins, proposals, the global resolver, duplicate rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fuzzy, scoring
from ..functions import text as T
from ..settings import Settings
from . import intervals


def matchable_lines(lines: DataFrame, key: str = "session_id") -> DataFrame:
    """Lines with words: (key, line_index, line, folded, n_words, position, line_count). Cries and directions are left out.

    line_index stays that of the whole script; position counts the lines that are left. Lines may have no key.
    """
    plain = lines.withColumn("__plain", T.nfkc(F.col("line")))
    out = plain.where(~T.is_vocalization(F.col("__plain"))).withColumns({"folded": T.folded(F.col("__plain"), cues=True), "n_words": T.spoken_count(F.col("__plain"))}).drop("__plain")
    whole = W.partitionBy(*([key] if key in lines.columns else [F.lit(0)]))
    return out.withColumn("position", F.row_number().over(whole.orderBy("line_index")) - 1).withColumn("line_count", F.count("*").over(whole))


#: Texts to score are dealt into so many chunks, and these to so many tasks: a script goes to a chunk, not to a text.
CHUNKS, TASKS = 4096, 120


def scored_spans(spans: DataFrame, lines: DataFrame, key: str = "session_id") -> DataFrame:
    """Every span with said and found: an array of its session's lines (all columns but key and folded) with match_score.

    Lines without the key are in every session's scope. Distinct transcripts are scored, each against the whole script
    in one pass; a script is one row, and pairs of texts are never rows. Spans of sessions without lines go.
    """
    scope = [key] if key in lines.columns else []
    said = spans.withColumn("__plain", T.nfkc(F.col("transcript"))).withColumn("said", T.folded(F.col("__plain"))).drop("__plain")
    rest = [c for c in lines.columns if c not in (key, "line_index", "folded")]
    script = lines.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("line_index", "folded", *rest))).alias("script"))

    def beside(rows: DataFrame) -> DataFrame:
        return rows.join(script, scope) if scope else rows.crossJoin(F.broadcast(script))

    texts = said.select(*scope, "said", F.pmod(F.xxhash64("said"), F.lit(CHUNKS)).alias("chunk")).repartition(TASKS, *scope, "chunk")
    chunks = beside(texts.groupBy(*scope, "chunk").agg(F.collect_set("said").alias("texts")))
    scored = chunks.select(*scope, "texts", fuzzy.script_scores_of(F.col("texts"), F.col("script.folded")).alias("scores"))
    scored = scored.select(*scope, F.explode(F.arrays_zip("texts", "scores")).alias("x")).select(*scope, F.col("x.texts").alias("said"), F.col("x.scores").alias("scores"))
    found = F.zip_with("script", "scores", lambda x, y: F.struct(x["line_index"].alias("line_index"), *[x[c].alias(c) for c in rest], y.alias("match_score")))
    return beside(said.join(scored, [*scope, "said"])).withColumn("found", found).drop("script", "scores")


def line_scores(spans: DataFrame, lines: DataFrame, key: str = "session_id") -> DataFrame:
    """Every span beside every line of its session, with match_score: scored_spans as rows."""
    return scored_spans(spans, lines, key).withColumn("found", F.explode("found")).select("*", "found.*").drop("said", "found")


def best_line(spans: DataFrame, lines: DataFrame, group: list[str], *columns: str, key: str = "session_id") -> DataFrame:
    """(group, line_index, columns, match_score, confidence_margin): the best line of each group's spans, the first in a tie.

    What with_margin and top_per_group find over rows of spans and lines: a span's two best lines are all that counts.
    """
    held = scored_spans(spans, lines, key)
    pair = lambda x: F.struct(x["match_score"].alias("match_score"), x["line_index"].alias("line_index"))
    first = F.array_max(F.transform("found", lambda x: F.struct(x["match_score"].alias("match_score"), (-x["line_index"]).alias("nth"), *[x[c].alias(c) for c in ("line_index", *columns)])))
    two = T.let(F.transform("found", pair), lambda ps: T.let(F.array_max(ps), lambda one: F.array_compact(F.array(one, F.array_max(F.filter(ps, lambda p: p["line_index"] != one["line_index"]))))))
    rows = held.where(F.size("found") > 0).select(*group, first.alias("first"), two.alias("two"))
    best = rows.groupBy(*group).agg(F.max("first").alias("first"), F.flatten(F.collect_list("two")).alias("two"))
    other = F.array_max(F.transform(F.filter("two", lambda p: p["line_index"] != F.col("first.line_index")), lambda p: p["match_score"]))
    return best.select(*group, "first.line_index", *[f"first.{c}" for c in columns], "first.match_score", (F.col("first.match_score") - F.coalesce(other, F.lit(0.0))).alias("confidence_margin"))


def with_margin(scores: DataFrame, group: list[str], score: str = "match_score", item: str = "line_index", name: str = "confidence_margin") -> DataFrame:
    """Adds a row's score less the best of the group's other items, over all of them.

    Two passes over one window partition; equal best scores give a margin of zero.
    """
    whole = W.partitionBy(*group)
    rows = scores.withColumn("__one", F.max(F.struct(score, item)).over(whole))
    rows = rows.withColumn("__second", F.max(F.when(F.col(item) != F.col("__one")[item], F.col(score))).over(whole))
    other = F.when(F.col(item) == F.col("__one")[item], F.coalesce("__second", F.lit(0.0))).otherwise(F.col("__one")[score])
    return rows.withColumn(name, F.col(score) - other).drop("__one", "__second")


def top_per_group(rows: DataFrame, group: list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def proposals(spans: DataFrame, lines: DataFrame, s: Settings, key: str = "session_id") -> DataFrame:
    """A row for each span whose best line scores enough: its line, margin, utility and top matches."""
    spans = spans.where(F.col("count") <= int(s.max_merge_segments))
    if s.merge_require_text_boundaries:
        spans = spans.where((F.col("count") == 1) | F.col("edges_spoken"))
    rows = scored_spans(spans, lines, key).where(F.size("found") > 0)

    def ranked(x: Column) -> Column:
        """A line's place by struct order: the better rank, then match, then the earlier line."""
        duration = scoring.duration_plausibility(x["n_words"], F.col("start_seconds"), F.col("end_seconds"))
        hint = scoring.order_hint(F.col("start_index"), F.col("segment_count"), x["position"], x["line_count"]) if s.order_hint_weight else F.lit(0.0)
        return F.struct((-scoring.ranking_score(x["match_score"], duration, hint, s)).alias("by"), (-x["match_score"]).alias("less"), x["line_index"].alias("line_index"), x["match_score"].alias("match_score"), duration.alias("duration_plausibility"), hint.alias("order_hint"))

    # A line's margin is its score less the best of the other lines; the best one's, less the second.
    pairs = F.transform("found", lambda x: F.struct(x["match_score"].alias("match_score"), x["line_index"].alias("line_index")))
    two = T.let(pairs, lambda ps: T.let(F.array_max(ps), lambda one: F.struct(one.alias("one"), F.array_max(F.transform(F.filter(ps, lambda p: p["line_index"] != one["line_index"]), lambda p: p["match_score"])).alias("second"))))
    top = F.slice(F.array_sort(F.transform("found", ranked)), 1, max(1, int(s.candidate_top_k)))
    margin = lambda x, two: x["match_score"] - F.when(x["line_index"] == two["one"]["line_index"], F.coalesce(two["second"], F.lit(0.0))).otherwise(two["one"]["match_score"])
    match = lambda x, i, two: F.struct((i + 1).alias("rank"), x["line_index"].alias("line_index"), x["match_score"].alias("match_score"), (-x["by"]).alias("ranking_score"), margin(x, two).alias("confidence_margin"), x["duration_plausibility"].alias("duration_plausibility"), x["order_hint"].alias("order_hint"))
    rows = rows.withColumn("__top", T.let(two, lambda t: F.transform(top, lambda x, i: match(x, i, t)))).drop("found", "said")
    first = F.get("__top", F.lit(0))
    named = ("rank", "line_index", "match_score", "ranking_score", "confidence_margin", "duration_plausibility")
    good = F.filter("__top", lambda x: x["match_score"] >= float(s.candidate_min_score))
    best = rows.select(key, "start_index", "count", *[first[c].alias(c) for c in (*named[1:], "order_hint")], "transcript", "start_seconds", "end_seconds", "probability", F.transform(good, lambda x: F.struct(*[x[c].alias(c) for c in named])).alias("top_matches"))
    return best.where(F.col("match_score") >= float(s.candidate_min_score)).withColumn("path_utility", scoring.path_utility(F.col("ranking_score"), F.col("count"), s))


def best_path(start: list[int], count: list[int], utility: list[float], skip: float) -> list[int]:
    """Rows of the best set of spans that don't overlap: utilities less `skip` for each segment left out.

    From the right; leaving a segment out wins ties, then the first of the rows, which come by start and count.
    """
    if not start:
        return []
    low, high = min(start), max(s + c for s, c in zip(start, count))
    at: dict[int, list[int]] = {}
    for row, s in enumerate(start):
        at.setdefault(s, []).append(row)
    best, choice = {high: 0.0}, {}
    for i in range(high - 1, low - 1, -1):
        best[i], choice[i] = best[i + 1] - skip, None
        for row in at.get(i, ()):
            total = utility[row] + best[i + count[row]]
            if total > best[i]:
                best[i], choice[i] = total, row
    out, i = [], low
    while i < high:
        row = choice[i]
        if row is not None:
            out.append(row)
        i += 1 if row is None else count[row]
    return out


def resolved(found: DataFrame, segments: DataFrame, s: Settings, key: str = "session_id") -> DataFrame:
    """The proposals on the best path of each session.

    No span crosses a wide gap, so the path of a session is that of its runs one by one: a group is a run between
    gaps, not a session.
    """
    runs = intervals_runs(segments, s, key)
    held = found.join(runs, [key, "start_index"])
    skip = float(s.noise_penalty)

    @F.pandas_udf("array<int>")
    def places(rows: pd.Series) -> pd.Series:
        return pd.Series([best_path([r["start_index"] for r in x], [r["count"] for r in x], [r["path_utility"] for r in x], skip) for x in rows])

    # The rows themselves go through the groups, so that what made them is worked out once.
    one = held.select(key, "run_id", F.struct("start_index", "count", "path_utility", *[c for c in found.columns if c not in (key, "start_index", "count", "path_utility")]).alias("p"))
    runs_of = one.groupBy(key, "run_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    facts = F.transform("ps", lambda p: F.struct(p["start_index"].alias("start_index"), p["count"].alias("count"), p["path_utility"].alias("path_utility")))
    at = runs_of.withColumn("at", places(facts)).select(key, F.explode(F.transform("at", lambda i: F.get("ps", i))).alias("p"))
    return at.select(key, "p.*").select(*found.columns)


def intervals_runs(segments: DataFrame, s: Settings, key: str) -> DataFrame:
    from .spans import base_positions

    return base_positions(segments, float(s.max_merge_gap_seconds), key).select(key, "start_index", "run_id")


def align(segments: DataFrame, lines: DataFrame, s: Settings, key: str = "session_id") -> DataFrame:
    """Spans matched to lines in any order: a row for each chosen span; a line may be chosen many times."""
    from .spans import enumerate_spans

    spans = enumerate_spans(segments, s, int(s.max_merge_segments), key)
    return resolved(proposals(spans, matchable_lines(lines, key), s, key), segments, s, key)


def span_key(start: Column, count: Column, trim_start: Column, trim_end: Column) -> Column:
    """One value for a span and its trims; an untrimmed edge is -1."""
    return F.struct(start.alias("start_index"), count.alias("count"), F.coalesce(trim_start, F.lit(-1)).alias("trim_start"), F.coalesce(trim_end, F.lit(-1)).alias("trim_end"))


def one_action_per_span(actions: DataFrame, exact: DataFrame, s: Settings, key: str = "session_id") -> DataFrame:
    """Of the actions of a span the one with the best exact line, where that scores enough; else the best preliminary one.

    exact: (key, span, line_index, exact_score) for every line. The kept action is moved to the span's best exact line.
    """
    best = exact.groupBy(key, "span").agg(F.max(F.struct("exact_score", (-F.col("line_index")).alias("nth"))).alias("b"))
    joined = actions.join(best, [key, "span"], "left").withColumn("exact_line", F.when(F.col("b.exact_score") >= float(s.candidate_min_score), -F.col("b.nth")))
    order = W.partitionBy(key, "span").orderBy(F.desc(F.coalesce(F.col("line_index") == F.col("exact_line"), F.lit(False))), F.desc("match_score"), "ordinal")
    kept = joined.withColumn("__nth", F.row_number().over(order)).where("__nth = 1")
    moved = F.col("exact_line").isNotNull() & (F.col("exact_line") != F.col("line_index"))
    return kept.withColumn("rerouted", moved).withColumn("line_index", F.coalesce("exact_line", "line_index")).withColumn("match_score", F.when(F.col("exact_line").isNotNull(), F.col("b.exact_score")).otherwise(F.col("match_score"))).drop("__nth", "b", "exact_line")


def spread_over_duplicates(actions: DataFrame, lines: DataFrame, s: Settings, key: str = "session_id") -> DataFrame:
    """The weak-order policy for script rows with equal words.

    actions (key, start_index, count, start_seconds, end_seconds, line_index, match_score); lines (key, line_index,
    line). Well-scored actions are anchors; anchors near in time form takes; takes (or single anchors, if there are
    fewer takes than rows) are spread evenly over the rows in order; other actions follow their nearest anchor. Adds
    duplicate_resolved. Other policies leave actions as they are.
    """
    if s.duplicate_line_policy != "weak_order":
        return actions.withColumn("duplicate_resolved", F.lit(False))
    said = lines.select(key, "line_index", T.spoken(F.col("line"), cues=True).alias("said")).where("said <> ''")
    groups = said.groupBy(key, "said").agg(F.array_sort(F.collect_list("line_index")).alias("rows")).where(F.size("rows") > 1)
    of_line = groups.select(key, "said", "rows", F.explode("rows").alias("line_index"))
    mine = actions.join(of_line, [key, "line_index"], "left").repartition(intervals.PARTS, key, "said")
    least = F.when(F.size(T.words(F.col("said"))) <= scoring.SHORT_WORDS, float(s.short_line_min_score)).otherwise(float(s.reliable_min_score))
    mine = mine.withColumn("anchor_row", F.col("said").isNotNull() & (F.col("match_score") >= least))
    anchors = mine.where("anchor_row").select(key, "said", "rows", "start_index", "count", "start_seconds", "end_seconds")
    order = W.partitionBy(key, "said").orderBy("start_index", "count")
    new = F.coalesce((F.col("start_seconds") - F.lag("end_seconds").over(order) > float(s.take_group_gap_seconds)).cast("int"), F.lit(0))
    whole = W.partitionBy(key, "said")
    anchors = anchors.withColumn("new", new).withColumn("take", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    anchors = anchors.withColumn("takes", F.max("take").over(whole) + 1).withColumn("nth", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(whole))
    few = F.col("takes") < F.size("rows")
    position, positions = F.when(few, F.col("nth")).otherwise(F.col("take")), F.when(few, F.col("n")).otherwise(F.col("takes"))
    place = F.when(positions == 1, 0).otherwise(F.bround(position * (F.size("rows") - 1) / (positions - 1), 0))
    anchors = anchors.withColumn("to_line", F.get("rows", place.cast("int"))).select(key, "said", F.col("start_index").alias("anchor_order"), F.col("start_seconds").alias("anchor_start"), F.col("count").alias("anchor_count"), "to_line")
    followers = mine.where("said is not null and not anchor_row").drop("rows")
    followed = intervals.nearest(followers, anchors.select(key, "said", "anchor_order", "anchor_start", "to_line"), [key, "said"], at="start_seconds")
    moved = followed.select(*[c for c in actions.columns if c != "line_index"], F.coalesce(F.col("anchor.to_line"), F.col("line_index")).alias("line_index"), F.col("anchor").isNotNull().alias("duplicate_resolved"))
    set_down = mine.where("anchor_row").join(anchors.select(key, "said", F.col("anchor_order").alias("start_index"), F.col("anchor_count").alias("count"), "to_line"), [key, "said", "start_index", "count"]).withColumn("line_index", F.col("to_line")).withColumn("duplicate_resolved", F.lit(True))
    plain = mine.where("said is null").withColumn("duplicate_resolved", F.lit(False))
    columns = [*actions.columns, "duplicate_resolved"]
    return plain.select(*columns).unionByName(set_down.select(*columns)).unionByName(moved.select(*columns))


def expanded_to_duplicates(actions: DataFrame, lines: DataFrame, s: Settings, key: str = "session_id") -> DataFrame:
    """Under review and reuse, an action stands for every row with its line's words; resolved under reuse alone."""
    said = lines.select(key, "line_index", T.spoken(F.col("line"), cues=True).alias("said"))
    if s.duplicate_line_policy == "weak_order":
        return actions.withColumn("target_index", F.col("line_index"))
    to = said.where("said <> ''").select(key, "said", F.col("line_index").alias("target_index"))
    out = actions.join(said, [key, "line_index"], "left").join(to, [key, "said"], "left").withColumn("target_index", F.coalesce("target_index", "line_index")).drop("said")
    many = F.count("*").over(W.partitionBy(key, "start_index", "count", "line_index")) > 1
    return out.withColumn("duplicate_resolved", many & F.lit(s.duplicate_line_policy == "reuse"))


def unmatched_segments(segments: DataFrame, actions: DataFrame, key: str = "session_id") -> DataFrame:
    """Base segments that no reliable action covers: an anti-join on the covered positions."""
    covered = actions.where("reliable").select(key, F.explode(F.sequence(F.col("start_index"), F.col("start_index") + F.col("count") - 1)).alias("start_index"))
    return segments.join(covered, [key, "start_index"], "left_anti")


def unmatched_reason(transcript: Column, best_score: Column, s: Settings) -> Column:
    return F.when(F.trim(T.text(transcript)) == "", "TRANSCRIPTION_FAILED_OR_NONVERBAL").when(best_score >= float(s.candidate_min_score), "AMBIGUOUS_OR_LOW_CONFIDENCE").otherwise("NO_RELIABLE_MATCH")
