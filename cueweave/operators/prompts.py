"""Script lines that may prompt a second hearing of a segment, and how near the script its words are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from .assignment import TASKS, top_per_group


def _plain(c: Column) -> Column:
    return T.normalized(T.verbal(T.nfkc(c)))


def prompt_candidates(segments: DataFrame, lines: DataFrame, most_words: int, k: int, key: str = "session_id") -> DataFrame:
    """(key, segment_id, rank, line_index, score): each segment's k lines of at most most_words words to speak.

    segments (key, segment_id, transcript), lines (key, line_index, line). Cries and directions alone are no lines to
    prompt with. The nearest by the composite ratio come first, the earlier line in a tie; a segment without a
    transcript gets the first k lines, without a score. Distinct texts are scored once.
    """
    short = lines.withColumn("plain", _plain(F.col("line"))).where(~T.is_vocalization(F.col("line")) & F.size(T.words(F.col("plain"))).between(1, most_words)).select(key, "line_index", "plain")
    held = segments.select(key, "segment_id", (T.text(F.col("transcript")) == "").alias("mute"), T.normalized(T.nfkc(F.col("transcript"))).alias("said"))
    pairs = held.where("not mute").select(key, "said").distinct().join(short.select(key, "plain").distinct(), key).repartition(TASKS, key, "said")
    scored = pairs.withColumn("score", fuzzy.weighted_ratio_of(F.col("plain"), F.col("said"))).join(short, [key, "plain"])
    best = top_per_group(scored, [key, "said"], k, F.desc("score"), F.asc("line_index")).select(key, "said", "rank", "line_index", "score")
    first = top_per_group(short, [key], k, F.asc("line_index")).select(key, "rank", "line_index", F.lit(None).cast("double").alias("score"))
    heard = held.where("not mute").join(best, [key, "said"]).select(key, "segment_id", "rank", "line_index", "score")
    return heard.unionByName(held.where("mute").join(first, key).select(key, "segment_id", "rank", "line_index", "score"))


def best_script_score(segments: DataFrame, lines: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, segment_id, script_score): the best plain ratio of a segment's words to any line's; 0 without words or lines."""
    held = segments.select(key, "segment_id", T.normalized(T.nfkc(F.col("transcript"))).alias("said"))
    plain = lines.select(key, _plain(F.col("line")).alias("plain")).where("plain <> ''").distinct()
    scored = held.where("said <> ''").select(key, "said").distinct().join(plain, key).repartition(TASKS, key, "said").withColumn("score", fuzzy.similarity_of(F.col("plain"), F.col("said")))
    best = scored.groupBy(key, "said").agg(F.max("score").alias("script_score"))
    return held.join(best, [key, "said"], "left").select(key, "segment_id", F.coalesce("script_score", F.lit(0.0)).alias("script_score"))
