"""The operators' tables, read from the driver's: timelines of events, scripts of benchmark texts, takes of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import parquet


def seconds(ts: str) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """A segment an event; a user is a session. An event lasts `value` minutes."""
    e = parquet(spark, folder, "events")
    start = seconds("ts")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("segment_id"), "event_type", "value", start.alias("start"), (start + F.col("value") * 60.0).alias("end"))


def takes(spark: SparkSession, folder: str) -> DataFrame:
    """A base segment a conversation turn, on a clock: 2.7 words a second, gaps by turn."""
    c = parquet(spark, folder, "conversations")
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    at = F.col("turn") * 1000.0
    return c.select(F.col("conv_id").alias("session_id"), F.concat(F.col("conv_id"), F.lit("__s"), F.lpad(F.col("turn").cast("string"), 5, "0")).alias("segment_id"), F.col("turn").cast("int").alias("base_index"), F.col("text").alias("transcript"), at.alias("start_seconds"), (at + F.greatest(F.lit(1), n) / 2.7).alias("end_seconds"), F.lit(None).cast("double").alias("asr_probability"))


def script(spark: SparkSession, folder: str) -> DataFrame:
    b = parquet(spark, folder, "benchmark")
    return b.select(F.col("item_id").alias("line_id"), F.col("item_id").cast("int").alias("line_index"), F.col("text").alias("line"))
