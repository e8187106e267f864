"""Queries of segments, review logs and predicates over the driver's tables; each takes (spark, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scoring
from ..operators import assignment, display, intervals, prompts, recovery, review, spans, takes
from ..settings import Settings
from ..sources.tables import parquet
from . import bindings
from .bindings import timeline

HOUR = 3600.0
RATE = 48_000


def _base(spark: SparkSession, d: str) -> DataFrame:
    """The timeline as base segments with samples from each session's first second on."""
    t = timeline(spark, d)
    whole = W.partitionBy("session_id")
    order = whole.orderBy("start", "end", "segment_id")
    low = F.floor(F.min("start").over(whole))
    t = t.withColumn("base_index", (F.row_number().over(order) - 1).cast("int"))
    samples = lambda c: F.floor((F.floor(c) - low) * RATE).cast("long")
    return t.withColumns({"start_sample": samples(F.col("start")), "end_sample": samples(F.col("end")) + RATE, "start_seconds": F.col("start"), "end_seconds": F.col("end")})


def _joined(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


def q35_manual_segments(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d)
    edits = base.where("event_type = 'purchase'").select(F.col("session_id").cast("string"), (F.col("start_sample") + 600 * RATE).alias("start_sample"), (F.col("end_sample") + 600 * RATE).alias("end_sample"), (F.col("base_index") % 7).cast("long").alias("line_id"))
    out = spans.manual_segments(edits, base.withColumn("session_id", F.col("session_id").cast("string")))
    return out.select("segment_id", "kind", "session_id", "start_sample", "end_sample", _joined("base_indices"), _joined("manual_line_ids"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    base = _base(spark, d).select(F.col("session_id").cast("string").alias("session_id"), F.col("segment_id").cast("string").alias("segment_id"), "base_index", "start_sample", "end_sample", "start_seconds", "end_seconds", F.when(F.col("event_type") != "view", F.concat(F.lit(" "), "event_type")).alias("transcript"), (F.col("value") / 500.0).alias("asr_probability"))
    wanted = base.select("session_id", F.col("base_index").alias("start_index"), (F.col("base_index") % 3 + 1).alias("count"))
    return spans.merged_segments(wanted, base, Settings(max_merge_gap_seconds=1e12))


def q36_merged_segments(spark: SparkSession, d: str) -> DataFrame:
    out = _merged(spark, d)
    return out.select("session_id", F.col("start_index").cast("long").alias("start_index"), "segment_id", "kind", _joined("base_indices"), "start_sample", "end_sample", "transcript", F.round("asr_probability", 6).alias("asr_probability"))


def q37_trimmed_segments(spark: SparkSession, d: str) -> DataFrame:
    m = _merged(spark, d)
    m = m.withColumn("trim_start_sample", F.when(F.col("start_index") % 2 == 0, F.col("start_sample") + RATE * (F.col("start_index") % 5 - 1))).withColumn("trim_end_sample", F.when(F.col("start_index") % 3 == 0, F.col("end_sample") - RATE * 60))
    out = spans.trimmed_segments(m, RATE)
    return out.select("segment_id", "kind", "start_sample", "end_sample", F.round("start_seconds", 3).alias("start_seconds"))


def _covers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    at = _base(spark, d).withColumn("start_index", F.col("base_index"))
    actions = at.select("session_id", "start_index", (F.col("start_index") % 3 + 1).alias("count"), (F.col("event_type") == "purchase").alias("reliable"))
    return at, actions


def q38_unmatched_segments(spark: SparkSession, d: str) -> DataFrame:
    at, actions = _covers(spark, d)
    said = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    return assignment.unmatched_segments(at, actions).select("session_id", "segment_id", assignment.unmatched_reason(said, F.col("value"), Settings()).alias("reason"))


def q39_latest_events(spark: SparkSession, d: str) -> DataFrame:
    """The state of each user and hundredth of a value after the log of events; errors delete."""
    log = parquet(spark, d, "events").select("event_id", "user_id", F.floor(F.col("value") / 100.0).alias("part"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("action"), "value")
    return review.latest(log, ["user_id", "part"]).select("user_id", "part", "event_id", "value")


def q40_review_violations(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders")
    k = F.col("o_orderkey")
    status = F.when(k % 11 == 0, "DONE").when(k % 3 == 0, "RETAKE").when(k % 13 != 0, "AUTO_OK")
    r = o.select(F.when(k % 17 != 0, F.when(k % 19 == 0, k + 1).otherwise(k)).alias("line_id"), F.when(k % 7 == 0, "song").when(k % 5 != 0, "normal").otherwise("nonverbal").alias("type"), status.alias("status"), F.when(k % 2 == 0, k).alias("selected_segment_id"))
    return review.review_violations(r)


def q41_pool_after_merge(spark: SparkSession, d: str) -> DataFrame:
    c = parquet(spark, d, "customer")
    k = F.col("c_custkey")
    merged = c.select(k.alias("line_id"), F.when(k % 3 == 0, "nonverbal").otherwise("normal").alias("type"), F.when(k % 2 == 0, "MANUALLY_REVIEWED").otherwise("REVIEW").alias("status"), F.when(k % 10 != 0, k * 2).alias("selected_segment_id"), F.when(k % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("candidates"))
    pool = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_orderstatus").alias("tag"))
    old = parquet(spark, d, "part").select((F.col("p_partkey") * 4).alias("segment_id"), F.lit("old").alias("tag"))
    return review.pool_after_merge(pool, old, merged)


LINES = ("We go now, friends!", "we go now friends", "Stop there, you thief", "We go. Now. Friends (angry)", "stop there you thief")


def _line_actions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    at = _base(spark, d)
    actions = at.select("session_id", F.col("base_index").alias("start_index"), F.lit(1).alias("count"), (F.col("segment_id") % 5).cast("int").alias("line_index"), F.col("value").alias("match_score"), F.col("segment_id").alias("ordinal"))
    lines = at.select("session_id").distinct().select("session_id", F.explode(F.array(*[F.struct(F.lit(i).alias("line_index"), F.lit(x).alias("line")) for i, x in enumerate(LINES)])).alias("x")).select("session_id", "x.*")
    return actions, lines


def q42_expanded_duplicates(spark: SparkSession, d: str) -> DataFrame:
    out = assignment.expanded_to_duplicates(*_line_actions(spark, d), Settings(duplicate_line_policy="reuse"))
    return out.select("session_id", F.col("start_index").cast("long").alias("start_index"), F.col("line_index").cast("long").alias("line_index"), F.col("target_index").cast("long").alias("target_index"), "duplicate_resolved")


def q43_one_action_per_span(spark: SparkSession, d: str) -> DataFrame:
    """Three actions of successive events share a span; two of the lines have exact scores, from the events around."""
    actions, _ = _line_actions(spark, d)
    actions = actions.withColumn("span", F.floor(F.col("start_index") / 3))
    exact = actions.select("session_id", "span", F.col("start_index"), ((F.col("line_index") + 2) % 5).alias("line_index"), (F.col("match_score") / 5.0).alias("exact_score")).groupBy("session_id", "span", "line_index").agg(F.max("exact_score").alias("exact_score"))
    out = assignment.one_action_per_span(actions, exact, Settings(candidate_min_score=40.0))
    return out.select("session_id", "span", "ordinal", F.col("line_index").cast("long").alias("line_index"), F.round("match_score", 6).alias("match_score"), "rerouted")


def _hours(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hours for seconds: words are events, regions last seven hours from each click on, segments are the errors."""
    t = timeline(spark, d).select("session_id", "segment_id", "event_type", "value", (F.col("start") / HOUR).alias("start"), (F.col("end") / HOUR).alias("end"))
    words = t.where("event_type <> 'error'").select("session_id", F.col("segment_id").alias("seg_id"), F.lit(0).alias("pos"), "start", "end", F.concat(F.lit(" "), "event_type").alias("word"), (F.col("value") / 500.0).alias("probability"))
    regions = t.where("event_type = 'click'").select("session_id", F.col("segment_id").alias("region_id"), (F.col("end") + 1.0).alias("start"), (F.col("end") + 8.0).alias("end"))
    segments = t.where("event_type = 'error'").select("session_id", F.col("segment_id").alias("seg_id"), "start", "end", F.lit(" oops ").alias("text"))
    return words, regions, segments


def q44_region_transcripts(spark: SparkSession, d: str) -> DataFrame:
    words, regions, segments = _hours(spark, d)
    out = intervals.transcript_of_regions(regions, words, segments)
    return out.select("session_id", "region_id", "transcript", F.round("probability", 6).alias("probability"))


def q45_span_words(spark: SparkSession, d: str) -> DataFrame:
    words, regions, _ = _hours(spark, d)
    out = intervals.words_for_spans(regions.select("session_id", F.col("region_id").alias("span_id"), F.col("start").alias("span_start"), F.col("end").alias("span_end")), words.select("session_id", "start", "end", "word", "probability"))
    return out.select("session_id", "span_id", "transcript", F.round("probability", 6).alias("probability"))


def q46_predicates(spark: SparkSession, d: str) -> DataFrame:
    li = parquet(spark, d, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_partkey")
    said = F.when(p % 4 == 0, " ").when(p % 4 == 1, None).otherwise(F.col("l_returnflag"))
    silent = scoring.silence_hallucination(said, -q, F.array(F.col("l_discount") * 9, F.col("l_tax") * 10))
    prompt = scoring.needs_prompt(said, F.when(p % 5 != 0, q / 50.0), p % 100 + 0.0, q / 6.0, silent)
    reason = F.element_at(F.array(F.lit("EXTRA_LINE_END"), F.lit("AMBIGUOUS_MATCH"), F.lit(""), F.lit("MISSING_SENTENCE")), (p % 4 + 1).cast("int"))
    last = scoring.final_reason(reason, p % 11 == 0, p % 13 == 0, F.when(p % 17 == 0, "FORCED"), p % 19 == 0)
    return li.select("l_orderkey", "l_linenumber", silent.alias("silent"), prompt.alias("prompt"), scoring.structurally_incomplete(F.when(p % 6 == 0, 1), reason).alias("incomplete"), last.alias("reason"))


def q47_base_keys(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders")
    ids = o.select("o_orderkey", F.concat(F.lit("s"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 3 == 0, "__m").otherwise("__s"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 5, "0"), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise("")).alias("id"))
    k = review.base_segment_key(F.col("id"))
    return ids.select("o_orderkey", k["session_id"].alias("session_id"), k["base_index"].cast("long").alias("base_index"))


def q48_filled_forward(spark: SparkSession, d: str) -> DataFrame:
    t = timeline(spark, d).withColumn("last_click", F.when(F.col("event_type") == "click", F.col("value")))
    return intervals.filled_forward(t, ["session_id"], "segment_id", "last_click").select("segment_id", "last_click")


def q49_proper_subspans(spark: SparkSession, d: str) -> DataFrame:
    """The proper subspans of spans of up to four segments."""
    _, actions = _covers(spark, d)
    wide = actions.select("session_id", "start_index", (F.col("count") + 1).alias("count"))
    return recovery.proper_subspans(wide).groupBy("session_id", "start_index", "count").agg(F.count("*").alias("n")).select("session_id", F.col("start_index").cast("long").alias("start_index"), F.col("count").cast("long").alias("count"), "n")


def q50_without_noise(spark: SparkSession, d: str) -> DataFrame:
    """What is left of spans of five events when any number of views is dropped at either end."""
    at, _ = _covers(spark, d)
    spans5 = at.where("base_index % 5 = 0").select("session_id", "start_index", F.lit(5).alias("count"))
    pieces = at.select("session_id", "start_index", (F.col("event_type") == "view").alias("removable"))
    out = recovery.without_removable_edges(spans5, pieces)
    return out.select("session_id", *[F.col(c).cast("long").alias(c) for c in ("from_index", "start_index", "count")])


def q51_edge_extensions(spark: SparkSession, d: str) -> DataFrame:
    at, _ = _covers(spark, d)
    actions = at.where("event_type = 'purchase'").select("session_id", "start_index", (F.col("start_index") % 2 + 1).alias("count"), (F.col("segment_id") % 2 == 0).alias("opens_with_cue"), (F.col("segment_id") % 3 == 0).alias("closes_with_cue"))
    out = recovery.edge_extensions(actions, at.select("session_id", "start_index", "start_seconds", "end_seconds", (F.col("event_type") != "click").alias("vocal")), Settings(edge_cue_extension_max_gap_seconds=6 * HOUR))
    return out.select("session_id", *[F.col(c).cast("long").alias(c) for c in ("from_index", "start_index", "count")], "side")


def q52_unsafe_merges(spark: SparkSession, d: str) -> DataFrame:
    at, actions = _covers(spark, d)
    pieces = at.select("session_id", "start_index", (F.col("value") / 10.0).alias("duration_seconds"), (-F.col("value") / 4.0).alias("rms_dbfs"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("transcript"), (F.col("event_type") == "error").alias("silence_rejected"))
    spans3 = actions.select("session_id", "start_index", F.lit(3).alias("count"))
    return recovery.untranscribed_pieces(spans3, pieces, Settings(untranscribed_merge_min_rms_dbfs=-10.0)).select("session_id", F.col("start_index").cast("long").alias("start_index"), "unsafe")


def q53_dual_budget(spark: SparkSession, d: str) -> DataFrame:
    """Of a supplier's line items as trims, the dearest ones within the budgets of lines and segments."""
    li = parquet(spark, d, "lineitem").select(F.col("l_suppkey").alias("session_id"), (F.col("l_partkey") % 50).alias("line_index"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trim"), (F.col("l_linenumber") % 3).alias("segment_index"), F.col("l_extendedprice").alias("score"))
    kept = recovery.trims_within_budgets(li, F.struct(-F.col("score"), F.col("trim")), Settings())
    return kept.groupBy("session_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def q54_isolation(spark: SparkSession, d: str) -> DataFrame:
    at, actions = _covers(spark, d)
    wide = actions.select("session_id", "start_index", F.col("count"))
    out = takes.isolation(wide, at.select("session_id", "start_index", "start_seconds", "end_seconds"))
    return out.select("session_id", F.col("start_index").cast("long").alias("start_index"), F.round("isolation", 3).alias("isolation"))


def _line_candidates(spark: SparkSession, d: str) -> DataFrame:
    li, k = parquet(spark, d, "lineitem"), F.col("l_partkey")
    seg = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(F.col("l_suppkey").alias("line_id"), seg.alias("segment_id"), F.concat(F.lit("s"), k % 2).alias("session_id"), F.array((k % 40).cast("int"), (k % 40 + 1).cast("int")).alias("base_indices"), F.col("l_quantity").alias("score"), F.col("l_tax").alias("selection_score"), (F.col("l_returnflag") == "R").alias("manual_edit"), seg.alias("ordinal"), (k % 300 + 0.0).alias("start_seconds"), (k % 300 + 2.0 + F.col("l_linenumber")).alias("end_seconds"), (F.col("l_discount") * 10).alias("isolation"), (F.col("l_returnflag") == "A").alias("repeated"))


def q55_exact_takes(spark: SparkSession, d: str) -> DataFrame:
    out = takes.exact_groups(_line_candidates(spark, d))
    return out.select("line_id", "segment_id", F.col("group").cast("long").alias("group"), F.col("place").cast("long").alias("place"))


def q56_listed_lines(spark: SparkSession, d: str) -> DataFrame:
    c = parquet(spark, d, "customer")
    lines = c.select(F.col("c_custkey").alias("index"), F.when(F.col("c_acctbal") > 0, "REVIEW").otherwise("AUTO_OK").alias("status"), F.col("c_mktsegment").alias("sheet"), (F.col("c_nationkey") % 5).alias("excel_row"))
    return display.listed(lines, "sheet", True, "REVIEW").limit(20).select("index", "sheet")


def q57_marked_lines(spark: SparkSession, d: str) -> DataFrame:
    """The state of lines after toggles of candidates and marks for retake, in the order of events."""
    e = parquet(spark, d, "events")
    log = e.select("event_id", F.col("user_id").cast("long").alias("line_id"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "retake").otherwise("toggle").alias("action"), F.floor(F.col("value") / 200.0).cast("long").alias("segment_id"))
    k = F.col("c_custkey")
    lines = parquet(spark, d, "customer").select(k.cast("long").alias("line_id"), F.when(k % 4 == 0, "nonverbal").otherwise("normal").alias("type"), F.lit("AUTO_OK").alias("status"), F.when(k % 2 == 0, F.lit(0)).cast("long").alias("selected_segment_id"), (k % 3).alias("n_candidates"))
    return display.marked(lines, log).select("line_id", "status", "selected_segment_id")


def q58_take_groups(spark: SparkSession, d: str) -> DataFrame:
    out = takes.take_groups(_line_candidates(spark, d))
    return out.select("line_id", "segment_id", F.col("group").cast("long").alias("group"), F.col("place").cast("long").alias("place"))


def _heard(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A conversation's turns at odd places as segments, the others as its script."""
    turns = bindings.takes(spark, d).repartition(assignment.TASKS, "session_id")
    lines = turns.where("base_index % 2 = 0").select("session_id", F.col("base_index").alias("line_index"), F.col("transcript").alias("line"))
    return turns.where("base_index % 2 = 1").select("session_id", "segment_id", "transcript"), lines


def q59_prompt_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = prompts.prompt_candidates(*_heard(spark, d), most_words=40, k=3)
    return found.select("segment_id", F.col("rank").cast("long").alias("rank"), "line_index", F.round("score", 6).alias("score"))


def q60_best_script_score(spark: SparkSession, d: str) -> DataFrame:
    return prompts.best_script_score(*_heard(spark, d)).select("segment_id", F.round("script_score", 6).alias("script_score"))


QUERIES = {name: f for name, f in sorted(globals().items()) if name[0] == "q" and name[1:3].isdigit()}
