"""Spans: contiguous runs of base segments, with their transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..settings import Settings


def base_positions(segments: DataFrame, most_gap: float, key: str = "session_id", start: str = "start_seconds", end: str = "end_seconds") -> DataFrame:
    """Adds start_index (from 0), the session's number of segments, and run_id: it grows where a gap exceeds most_gap."""
    order = W.partitionBy(key).orderBy(start, end, *(["segment_id"] if "segment_id" in segments.columns else []))
    gap = F.greatest(F.lit(0.0), F.col(start) - F.lag(end).over(order))
    out = segments.withColumn("start_index", F.row_number().over(order) - 1).withColumn("__wide", F.coalesce((gap > most_gap).cast("int"), F.lit(0)))
    return out.withColumn("run_id", F.sum("__wide").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("segment_count", F.count("*").over(W.partitionBy(key))).drop("__wide")


def enumerate_spans(segments: DataFrame, s: Settings, most: int | None = None, key: str = "session_id") -> DataFrame:
    """All valid spans: (key, start_index, count, start_seconds, end_seconds, transcript, probability, edges_spoken).

    A span is up to `most` successive segments of one run, no longer than max_span_seconds. Each segment looks ahead
    over a frame of so many rows in the window, so that the work is rows times `most`, and no join is needed.
    """
    most = most or max(int(s.max_merge_segments), int(s.fragment_join_max_segments))
    at = base_positions(segments, float(s.max_merge_gap_seconds), key)
    ahead = W.partitionBy(key, "run_id").orderBy("start_index").rowsBetween(0, most - 1)
    item = F.struct("start_index", F.col("start_seconds").alias("s"), F.col("end_seconds").alias("e"), F.trim(F.coalesce("transcript", F.lit(""))).alias("t"), F.col("asr_probability").alias("p"))
    held = at.withColumn("ahead", F.array_sort(F.collect_list(item).over(ahead)))
    spans = held.select(key, "start_index", "run_id", "segment_count", "ahead", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("count"))
    part = F.slice("ahead", F.lit(1), F.col("count"))
    last = F.get("ahead", F.col("count") - 1)
    spans = spans.withColumn("part", part).withColumn("end_seconds", last["e"]).withColumn("start_seconds", F.get("ahead", F.lit(0))["s"])
    # Ends may fall back where segments overlap; a span is valid only if every shorter one from its start is.
    reach = F.aggregate("part", F.lit(0.0), lambda a, x: F.greatest(a, x["e"] - F.col("start_seconds")))
    spans = spans.where(reach <= float(s.max_span_seconds))
    texts = F.filter(F.transform("part", lambda x: x["t"]), lambda t: t != "")
    known = F.filter(F.transform("part", lambda x: x["p"]), lambda p: p.isNotNull())
    return spans.select(
        key,
        "start_index",
        "count",
        "segment_count",
        "start_seconds",
        "end_seconds",
        F.array_join(texts, " ").alias("transcript"),
        F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).alias("probability"),
        ((F.get("part", F.lit(0))["t"] != "") & (F.element_at("part", -1)["t"] != "")).alias("edges_spoken"),
    )


def merged_segments(spans: DataFrame, segments: DataFrame, s: Settings, key: str = "session_id") -> DataFrame:
    """Derived segments of (key, start_index, count): ids, base indices, samples and mean probability.

    A span of one segment is that segment; an id repeats for a repeated span, so materialising is idempotent.
    """
    at = base_positions(segments, float(s.max_merge_gap_seconds), key)
    wanted = spans.select(key, F.col("start_index").alias("first"), "count").distinct().withColumn("start_index", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    out = wanted.join(at, [key, "start_index"]).groupBy(key, "first", "count").agg(
        F.min_by("segment_id", "start_index").alias("first_id"),
        F.array_sort(F.collect_list("base_index")).alias("base_indices"),
        F.min("start_sample").alias("start_sample"),
        F.max("end_sample").alias("end_sample"),
        F.min("start_seconds").alias("start_seconds"),
        F.max("end_seconds").alias("end_seconds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_index", F.trim(F.coalesce("transcript", F.lit(""))).alias("t")))), lambda x: x["t"]), " ").alias("joined"),
        F.avg("asr_probability").alias("asr_probability"),
    )
    merged_id = F.format_string("%s__m%05d_%02d", F.col(key), F.col("first"), F.col("count"))
    return out.select(key, F.col("first").alias("start_index"), "count", F.when(F.col("count") == 1, F.col("first_id")).otherwise(merged_id).alias("segment_id"), F.when(F.col("count") == 1, "base").otherwise("merged").alias("kind"), "base_indices", "start_sample", "end_sample", "start_seconds", "end_seconds", F.trim(F.regexp_replace("joined", " +", " ")).alias("transcript"), "asr_probability")


def trimmed_segments(merged: DataFrame, rate: int, kind: str = "trimmed") -> DataFrame:
    """merged with trim_start_sample and trim_end_sample: bounds clamped to the span's; full bounds stay as they are."""
    low, high = F.col("start_sample"), F.col("end_sample")
    start = F.greatest(low, F.coalesce("trim_start_sample", low))
    end = F.least(high, F.coalesce("trim_end_sample", high))
    full = (start == low) & (end == high)
    tag = {"trimmed": "t", "bounded": "b"}[kind]
    out = merged.withColumns({"__start": start, "__end": end, "__full": full}).where(F.col("__end") > F.col("__start"))
    return out.withColumns(
        {
            "segment_id": F.when(F.col("__full"), F.col("segment_id")).otherwise(F.format_string(f"%s__{tag}%d_%d", F.col("segment_id"), F.col("__start"), F.col("__end"))),
            "kind": F.when(F.col("__full"), F.col("kind")).otherwise(kind),
            "start_seconds": F.when(F.col("__full"), F.col("start_seconds")).otherwise(F.col("__start") / rate),
            "end_seconds": F.when(F.col("__full"), F.col("end_seconds")).otherwise(F.col("__end") / rate),
            "start_sample": F.col("__start"),
            "end_sample": F.col("__end"),
        }
    ).drop("__start", "__end", "__full")


def manual_segments(edits: DataFrame, segments: DataFrame, key: str = "session_id") -> DataFrame:
    """Manual edits (key, start_sample, end_sample, line_id): an id by hash, and the base segments that they touch."""
    wanted = edits.groupBy(key, "start_sample", "end_sample").agg(F.array_sort(F.collect_set("line_id")).alias("manual_line_ids"))
    base = segments.select(key, F.col("start_sample").alias("b_start"), F.col("end_sample").alias("b_end"), "base_index")
    # Both sides are cut into buckets, so that the overlap join is an equi-join. A session's buckets are as wide as its
    # intervals on average, a minute at 48 kHz at least: an interval has three rows or fewer on average, however long.
    sizes = wanted.select(key, (F.col("end_sample") - F.col("start_sample")).alias("size")).unionByName(base.select(key, (F.col("b_end") - F.col("b_start")).alias("size")))
    widths = sizes.groupBy(key).agg(F.greatest(F.lit(48_000 * 60), F.ceil(F.avg(F.abs("size")))).alias("width"))
    bucket = lambda c: F.floor(c / F.col("width"))
    dealt = lambda rows, a, b: rows.join(widths, key).withColumn("bucket", F.explode(F.sequence(bucket(F.col(a)), bucket(F.col(b)))))
    met = dealt(wanted.drop("manual_line_ids"), "start_sample", "end_sample").join(dealt(base, "b_start", "b_end").drop("width"), [key, "bucket"]).where((F.col("start_sample") < F.col("b_end")) & (F.col("end_sample") > F.col("b_start")))
    met = met.where(F.col("bucket") == bucket(F.greatest("start_sample", "b_start")))  # only where the overlap begins
    touched = met.groupBy(key, "start_sample", "end_sample").agg(F.array_sort(F.collect_set("base_index")).alias("base_indices"))
    tag = F.substr(F.sha2(F.concat_ws(":", F.col(key), "start_sample", "end_sample"), 256), F.lit(1), F.lit(12))
    out = wanted.join(touched, [key, "start_sample", "end_sample"], "left")
    return out.select(F.concat(F.col(key), F.lit("__e"), tag).alias("segment_id"), F.lit("manual_edit").alias("kind"), key, "start_sample", "end_sample", F.coalesce("base_indices", F.array().cast("array<int>")).alias("base_indices"), "manual_line_ids")
