"""The library's operators as queries over the driver's tables; each takes (spark, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fuzzy, scoring
from ..functions import text as T
from ..operators import assignment, intervals, review, spans
from ..operators.assignment import TASKS
from ..settings import Settings
from ..sources.tables import cache_misses, parquet
from . import review_queries
from .bindings import script, takes, timeline

HOUR = 3600.0
#: The events' gaps are hours, not seconds; so are these limits.
SLOW = Settings(max_merge_gap_seconds=8 * HOUR, max_span_seconds=72 * HOUR)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q01_best_line_per_segment(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's best script line, its score and margin, and whether score and margin alone would do."""
    best = assignment.best_line(takes(spark, d).repartition(TASKS, "segment_id"), assignment.matchable_lines(script(spark, d)), ["segment_id"], "line_id", "n_words")
    s = Settings()
    short = F.col("n_words") <= scoring.SHORT_WORDS
    good = F.when(short, (F.col("match_score") >= s.short_line_min_score) & (F.col("confidence_margin") >= s.short_line_min_margin)).otherwise((F.col("match_score") >= s.reliable_min_score) & (F.col("confidence_margin") >= s.reliable_min_margin))
    return rounded(best.select("segment_id", "line_id", "match_score", "confidence_margin", short.alias("short_line"), good.alias("reliable_by_score")))


def q02_token_counts(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return parquet(spark, d, "documents").select("doc_id", F.md5(T.normalized(text)).alias("normal_md5"), T.word_count(text).cast("long").alias("n_words"), F.size(T.words(T.spoken(text))).cast("long").alias("n_spoken"), F.md5(T.verbal(text)).alias("verbal_md5"))


def q03_clauses(spark: SparkSession, d: str) -> DataFrame:
    c = parquet(spark, d, "documents").select("doc_id", T.clauses(F.col("text")).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n_clauses"), F.md5(F.array_join("c", "|")).alias("clauses_md5"))


def q04_duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    said = parquet(spark, d, "documents").select("doc_id", T.normalized(F.col("text")).alias("t"))
    return said.groupBy("t").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1").select("first_doc", "n")


def _silences(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = timeline(spark, d)
    first = W.partitionBy("session_id")
    rel = t.withColumn("s", F.col("start") - F.min("start").over(first)).withColumn("e", F.col("end") - F.min("start").over(first))
    durations = rel.groupBy("session_id").agg((F.max("e") + 3600.0).alias("duration_seconds"))
    return rel.select("session_id", F.col("s").alias("start"), F.col("e").alias("end"), (F.col("e") - F.col("s")).alias("duration")), durations


def q05_gap_regions(spark: SparkSession, d: str) -> DataFrame:
    silences, durations = _silences(spark, d)
    return rounded(intervals.regions_from_silences(silences, durations, 600.0, 300.0, 450.0, 750.0), 3)


def q06_padded_regions(spark: SparkSession, d: str) -> DataFrame:
    silences, durations = _silences(spark, d)
    found = intervals.regions_from_silences(silences, durations, 600.0, 300.0, 9000.0, 9000.0)
    return rounded(intervals.without_overlaps(found), 3)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    t = timeline(spark, d)
    return t.select("session_id", "segment_id", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), F.col("event_type").alias("transcript"), (F.col("value") / 500.0).alias("asr_probability"))


def q07_spans(spark: SparkSession, d: str) -> DataFrame:
    found = spans.enumerate_spans(_segments(spark, d), SLOW)
    return rounded(found.select("session_id", F.col("start_index").cast("long").alias("start_index"), F.col("count").cast("long").alias("n"), "start_seconds", "end_seconds", "transcript", "probability"), 9)


def q08_take_clusters(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.clusters(timeline(spark, d), 12 * HOUR)
    return found.groupBy("session_id", F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"), F.round(F.min("start"), 3).alias("first_start"), F.round(F.max("end"), 3).alias("last_end"))


def q09_nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    t = timeline(spark, d)
    anchors = t.where("event_type = 'purchase'").select("session_id", F.col("start").alias("anchor_start"), F.col("segment_id").alias("anchor_order"))
    rows = t.where("event_type <> 'purchase'").select("session_id", "segment_id", "start")
    return intervals.nearest(rows, anchors, ["session_id"]).select("segment_id", F.col("anchor.anchor_order").alias("anchor_id"))


def q10_points_in_windows(spark: SparkSession, d: str) -> DataFrame:
    t = timeline(spark, d)
    windows = t.where("event_type = 'purchase'").select("session_id", F.col("segment_id").alias("window_id"), (F.col("start") - 6 * HOUR).alias("window_start"), (F.col("start") + 6 * HOUR).alias("window_end"))
    points = t.select("session_id", "start", "end", "value")
    met = intervals.words_in_windows(windows, points, width=12 * HOUR)
    return met.groupBy("window_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def q11_overlaps(spark: SparkSession, d: str) -> DataFrame:
    t = timeline(spark, d)
    left = t.where("event_type = 'error'").select("session_id", F.col("segment_id").alias("l_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = t.where("event_type <> 'error'").select("session_id", F.col("segment_id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.overlapping(left, right, width=2 * HOUR).select("l_id", "r_id", F.round("shared", 3).alias("shared"))


def _utilities(spark: SparkSession, d: str) -> DataFrame:
    found = spans.enumerate_spans(_segments(spark, d), SLOW)
    return found.select("session_id", "start_index", "count", ((F.col("probability") * 100.0 - 10.0) / 5.0 - 0.2 * (F.col("count") - 1)).alias("path_utility"))


def q12_best_path(spark: SparkSession, d: str) -> DataFrame:
    chosen = assignment.resolved(_utilities(spark, d), _segments(spark, d), SLOW)
    return chosen.groupBy("session_id").agg(F.round(F.sum("path_utility"), 4).alias("utility"), F.sum("count").cast("long").alias("covered"))


def _type_scores(spark: SparkSession, d: str) -> DataFrame:
    return timeline(spark, d).groupBy("session_id", F.col("event_type").alias("item")).agg(F.max("value").alias("score"))


def q13_margin(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assignment.with_margin(_type_scores(spark, d), ["session_id"], "score", "item", "margin").select("session_id", "item", "score", "margin"))


def q14_top_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = assignment.top_per_group(timeline(spark, d), ["session_id"], 8, F.desc("value"), F.asc("segment_id"))
    return found.select("session_id", "segment_id", F.col("rank").cast("long").alias("rank"), "value")


def q15_score_cut(spark: SparkSession, d: str) -> DataFrame:
    """Where each session's eight best values are cut: 15 below the best, or within the widest gap of 12 or more."""
    top = assignment.top_per_group(timeline(spark, d), ["session_id"], 8, F.desc("value"), F.asc("segment_id"))
    order = W.partitionBy("session_id").orderBy("rank")
    g = top.withColumn("next", F.lead("value").over(order)).withColumn("gap", F.col("value") - F.col("next"))
    cut = g.groupBy("session_id").agg(F.max("value").alias("best"), F.max_by(F.struct("gap", "value", "next"), F.struct("gap", "rank")).alias("w"))
    floor = F.col("best") - 15.0
    return rounded(cut.select("session_id", F.when(F.col("w.gap") >= 12.0, F.greatest(floor, (F.col("w.value") + F.col("w.next")) / 2.0)).otherwise(floor).alias("cutoff")))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a line: orders of a customer, with their lines' part keys as base indices."""
    o = parquet(spark, d, "orders")
    li = parquet(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set((F.col("l_linenumber")).cast("int"))).alias("base_indices"), F.round(F.avg("l_quantity") * 2.0, 4).alias("match_score"), F.max("l_returnflag").alias("flag"))
    reason = F.when(F.col("flag") == "R", "LOW_MATCH_SCORE").when(F.col("flag") == "A", "AMBIGUOUS_MATCH").otherwise("")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("line_id"), F.col("o_orderkey").alias("segment_id"), F.lit("s").alias("session_id"), "base_indices", "match_score", F.col("match_score").alias("selection_score"), (F.col("o_orderstatus") == "F").alias("reliable"), reason.alias("reliability_reason"), F.col("o_orderkey").alias("ordinal"))


def q16_pruned_candidates(spark: SparkSession, d: str) -> DataFrame:
    kept = review.pruned(_candidates(spark, d))
    return kept.select("line_id", F.col("rank").cast("long").alias("rank"), "segment_id")


def q17_duration_plausibility(spark: SparkSession, d: str) -> DataFrame:
    docs = parquet(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"), "n_chars")
    return rounded(docs.select("doc_id", scoring.duration_plausibility(F.col("n"), F.lit(0.0), F.col("n_chars") / 14.0).alias("plausibility")), 5)


def q18_technical_score(spark: SparkSession, d: str) -> DataFrame:
    t = timeline(spark, d)
    clipping = (F.col("event_type") == "error").cast("int")
    rms = F.when(F.col("event_type") == "view", None).otherwise(-F.col("value") / 2.0)
    score = scoring.technical_score(clipping, F.col("value") / 100.0 - 1.0, rms, F.col("value") / 100.0)
    flags = scoring.technical_flags(clipping, rms, F.when(F.col("event_type") == "click", "").otherwise("x"))
    return rounded(t.select("segment_id", score.alias("score"), flags.alias("flags")))


def q19_reliability(spark: SparkSession, d: str) -> DataFrame:
    """The cascade over features worked out from line items."""
    li = parquet(spark, d, "lineitem")
    q, p, n = F.col("l_quantity"), F.col("l_partkey"), F.col("l_linenumber")
    ints = {"extra_word_count": p % 3, "prefix_missing_token_count": p % 5 - 3, "suffix_missing_token_count": p % 7 - 5, "leading_missing_token_count": p % 11 - 9, "leading_extra_token_count": p % 13 - 11, "leading_substitution_count": p % 17 - 15, "trailing_missing_token_count": p % 19 - 17, "trailing_extra_token_count": p % 23 - 21, "trailing_substitution_count": p % 29 - 27}
    f = F.struct((q * 2.0).alias("ordered_similarity"), (F.lit(1.0) - F.col("l_discount")).alias("token_coverage"), (F.lit(1.0) - F.col("l_tax") * 4.0).alias("token_precision"), *[v.cast("int").alias(k) for k, v in ints.items()])
    s = F.struct((n % 3).alias("clause_count"), (F.col("l_suppkey") % 4 == 0).cast("int").alias("missing_clause_count"), (F.col("l_suppkey") % 5 != 0).alias("clauses_in_order"))
    reason = scoring.reliability_reason(F.lit("some words to speak"), n, F.lit(50.0) + q, F.col("l_extendedprice") % 40.0, f, s, Settings(), clipping=(p % 31 == 0).cast("int"), technical=q, duration=q + 20.0)
    return li.select("l_orderkey", "l_linenumber", reason.alias("reason"))


def q20_selection_rank(spark: SparkSession, d: str) -> DataFrame:
    li = parquet(spark, d, "lineitem")
    score = scoring.selection_score(F.col("l_quantity"), F.col("l_discount") * 1000.0, F.col("l_tax"), F.col("l_linenumber"), F.col("l_quantity"), F.col("l_returnflag") == "R", Settings())
    ranked = assignment.top_per_group(li.withColumn("score", score), ["l_orderkey"], 1 << 30, F.desc("score"), F.asc("l_linenumber"))
    return rounded(ranked.select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"), "score"))


def q21_review_status(spark: SparkSession, d: str) -> DataFrame:
    kept = review.pruned(_candidates(spark, d))
    lines = parquet(spark, d, "customer").select(F.col("c_custkey").alias("line_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "(grunts)").otherwise("some words").alias("line"))
    return review.line_review(lines, kept).select("line_id", "type", "status", "suggested_segment_id", "selected_segment_id", "n_candidates")


def _reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = parquet(spark, d, "orders")
    line = F.col("o_custkey")
    cand = F.struct(F.col("o_orderkey").alias("segment_id"), F.col("o_totalprice").alias("score"), (F.col("o_orderpriority") == "1-URGENT").alias("manual"))
    new = o.where("o_orderstatus = 'O'").groupBy(line.alias("line_id")).agg(F.array_sort(F.collect_list(cand)).alias("candidates"), F.max("o_orderkey").alias("suggested_segment_id"))
    old = o.where("o_orderstatus <> 'O'").groupBy(line.alias("line_id")).agg(F.array_sort(F.collect_list(cand)).alias("candidates"), F.min("o_orderkey").alias("selected_segment_id"))
    new = new.select("line_id", F.lit("normal").alias("type"), F.lit("REVIEW").alias("status"), "suggested_segment_id", F.lit(None).cast("long").alias("selected_segment_id"), "candidates")
    status = F.when(F.col("line_id") % 3 == 0, "RETAKE").when(F.col("line_id") % 3 == 1, "MANUALLY_REVIEWED").otherwise("REVIEW")
    return new, old.select("line_id", status.alias("status"), "selected_segment_id", "candidates")


def q22_merged_reviews(spark: SparkSession, d: str) -> DataFrame:
    out = review.merged_reviews(*_reviews(spark, d))
    return out.select("line_id", "status", "suggested_segment_id", "selected_segment_id", F.array_join(F.col("candidates.segment_id").cast("array<string>"), ",").alias("candidates"))


def q23_unmatched_pool(spark: SparkSession, d: str) -> DataFrame:
    t = timeline(spark, d).withColumn("audible", F.col("value") >= 5.0)
    at = spans.base_positions(t.select("session_id", "segment_id", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), "audible", "event_type"), 8 * HOUR).withColumn("base_index", F.col("start_index"))
    kept = at.where("event_type = 'purchase'").select("session_id", (F.col("segment_id") + 1_000_000_000).alias("segment_id"), F.array("base_index", F.col("base_index") + 1).alias("base_indices"), F.lit(True).alias("reliable"))
    return review.unmatched_pool(at.select("session_id", "segment_id", "base_index", "audible"), kept).select("session_id", "segment_id", F.col("base_index").cast("long").alias("base_index"))


def q24_export_errors(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders")
    r = o.select(F.col("o_orderkey").alias("line_id"), F.when(F.col("o_orderkey") % 50 == 0, "a/b").when(F.col("o_orderkey") % 50 == 1, " ").otherwise(F.concat(F.lit("Take_"), F.col("o_orderkey") % 14000)).alias("target_filename"), F.when(F.col("o_orderstatus") == "P", "RETAKE").otherwise("AUTO_OK").alias("status"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") * 20 + F.col("o_orderkey") % 20).alias("selected_segment_id"))
    p = parquet(spark, d, "part")
    s = p.select((F.col("p_partkey") * 13).alias("segment_id"), (F.col("p_size") > 3).alias("file_exists"), F.when(F.col("p_size") > 45, 44100).otherwise(48000).alias("sample_rate"))
    existing = parquet(spark, d, "customer").select(F.concat(F.lit("TAKE_"), F.col("c_custkey") * 7, F.lit(".WAV")).alias("filename"))
    found = review.export_errors(r, s, existing, {"sample_rate": 48000})
    return found.select("line_id", "error", F.col("detail").cast("string").alias("detail"))


def _actions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = timeline(spark, d)
    at = spans.base_positions(t.select("session_id", "segment_id", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), "value", "event_type"), 8 * HOUR)
    names = {"click": 0, "view": 1, "purchase": 2, "error": 3}
    line = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit(4))
    actions = at.select("session_id", "start_index", F.lit(1).alias("count"), "start_seconds", "end_seconds", line.alias("line_index"), F.least(F.lit(100.0), F.col("value") + 40.0).alias("match_score"))
    lines = at.select("session_id").distinct().select("session_id", F.explode(F.array(*[F.struct(F.lit(i).alias("line_index"), F.lit(x).alias("line")) for i, x in enumerate(["We go now, friends!", "we go now friends", "Stop there, you thief", "We go. Now. Friends (angry)", "stop there you thief"])])).alias("x")).select("session_id", "x.*")
    return actions, lines


def q25_duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    actions, lines = _actions(spark, d)
    out = assignment.spread_over_duplicates(actions, lines, Settings(take_group_gap_seconds=12 * HOUR))
    return out.select("session_id", F.col("start_index").cast("long").alias("start_index"), F.col("line_index").cast("long").alias("line_index"), "duplicate_resolved")


def q26_retakes(spark: SparkSession, d: str) -> DataFrame:
    c = parquet(spark, d, "customer")
    lines = c.select(F.col("c_custkey").alias("line_id"), F.col("c_nationkey").alias("sheet_index"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("sheet"), F.col("c_custkey").alias("excel_row"), F.col("c_mktsegment").alias("quest"))
    r = c.select(F.col("c_custkey").alias("line_id"), F.when(F.col("c_acctbal") > 3000, "RETAKE").otherwise("AUTO_OK").alias("status"))
    return review.retake_listing(r, lines).select("line_id", "sheet", "excel_row", "shown_quest")


def q27_row_ranges(spark: SparkSession, d: str) -> DataFrame:
    li = parquet(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey").cast("int")).alias("rows"))
    written = li.select("l_suppkey", T.written_rows(F.col("rows")).alias("ranges"), F.size("rows").alias("n"))
    return written.select("l_suppkey", "ranges", (F.size(T.row_ranges(F.col("ranges"))) == F.col("n")).alias("reads_back"))


def q28_hotwords(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised words of each source's documents, in order of first use."""
    docs = parquet(spark, d, "documents").select("source", "doc_id", F.posexplode(T.capitalised(F.col("text"))).alias("pos", "word"))
    first = docs.groupBy("source", F.lower("word").alias("w")).agg(F.min(F.struct("doc_id", "pos", "word")).alias("x"))
    out = first.groupBy("source").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return out.select("source", F.size("xs").cast("long").alias("n"), F.substr(F.array_join(F.col("xs.word"), " "), F.lit(1), F.lit(1200)).alias("hotwords"))


def q29_median_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(intervals.median_gap(timeline(spark, d)), 3)


def q30_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    li = parquet(spark, d, "lineitem")
    wanted = li.select("l_partkey", F.concat(F.col("l_partkey") % 997, F.lit("-"), F.col("l_linenumber")).alias("cache_key"))
    cache = parquet(spark, d, "part").select(F.concat(F.col("p_partkey") % 997, F.lit("-"), F.col("p_size") % 5).alias("cache_key")).distinct()
    return cache_misses(wanted, cache).select("cache_key")


def q31_segment_usage(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("line_id"), F.col("l_suppkey").alias("session_id"), F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1).alias("base_indices"), F.lit("x").alias("selected_segment_id"))
    used = review.segment_usage(o, 7)
    return used.select("session_id", F.col("base_index").cast("long").alias("base_index"), F.size("lines").cast("long").alias("n_lines"), "used_here", "used_elsewhere")


def q32_edit_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's id with its highest bit cleared is what it was edited from, up to the powers' root, zero."""
    c = parquet(spark, d, "customer")
    seg = c.select(F.col("c_custkey").alias("segment_id"), F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 3)).alias("edited_from_segment_id"))
    return review.edit_sources(seg).select("segment_id", "source_id", F.col("steps").cast("long").alias("steps"))


def q33_aligned_takes(spark: SparkSession, d: str) -> DataFrame:
    """The whole alignment of conversations to the script: spans, scores, margins, the best path."""
    out = assignment.align(takes(spark, d).repartition(TASKS, "session_id"), script(spark, d), Settings(candidate_min_score=30.0))
    return rounded(out.select("session_id", "start_index", "count", "line_index", "match_score", "confidence_margin"))


def q34_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Ordered agreement of each turn with the turn before it in its conversation."""
    clauses = T.let(T.clauses(F.col("transcript")), lambda cs: F.struct(F.transform(cs, lambda c: T.folded(c)).alias("clauses"), F.transform(cs, lambda c: T.word_count(c)).alias("counts")))
    # Texts cost far more to fold and to align than to move; a file may be one partition.
    t = takes(spark, d).repartition(TASKS, "session_id").select("session_id", "base_index", "segment_id", F.struct(T.folded(F.col("transcript")).alias("folded"), clauses.alias("c")).alias("said"))
    pairs = t.withColumn("before", F.lag("said").over(W.partitionBy("session_id").orderBy("base_index"))).where("before is not null")
    pairs = pairs.select("segment_id", "before.folded", "before.c", F.col("said.folded").alias("heard")).repartition(TASKS, "segment_id")
    out = pairs.select("segment_id", fuzzy.fidelity_of(F.col("folded"), F.col("heard")).alias("f"), fuzzy.sentence_fidelity_of(F.col("c.clauses"), F.col("c.counts"), F.col("heard")).alias("s"))
    return rounded(out.select("segment_id", "f.ordered_similarity", "f.token_coverage", "f.token_precision", "f.extra_word_count", "s.clause_count", "s.missing_clause_count", "s.minimum_clause_score"))


QUERIES = {name: f for name, f in sorted(globals().items()) if name[0] == "q" and name[1:3].isdigit()} | review_queries.QUERIES
