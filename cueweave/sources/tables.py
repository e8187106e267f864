"""Tables in and out: Parquet and JSON documents, the cut that bounds a plan, content-keyed caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON documents with a declared schema; a file that doesn't parse raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint where the session has a folder for it; else df as it is."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint(eager=True)
    return df


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, name, size_bytes, content, sha256) of the matching files, by lower-case name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), F.col("length").alias("size_bytes"), "content", F.sha2("content", 256).alias("sha256")).orderBy(F.lower("name"))


def content_key(*parts: Column) -> Column:
    """A hash of named parts in one canonical form; settings that don't change results aren't part of it."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows of wanted that the cache doesn't hold, each key once."""
    return wanted.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def with_cached(wanted: DataFrame, cache: DataFrame, fresh: DataFrame, key: str = "cache_key") -> DataFrame:
    """wanted beside the payload of its key, from the cache or newly made."""
    return wanted.join(cache.unionByName(fresh.join(cache.select(key), key, "left_anti")), key, "left")


def carried_over(old: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """new, and what old has of keys that new hasn't."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header in each part."""
    df.write.option("sep", "\t").option("header", True).option("encoding", "UTF-8").csv(path)


def selected_sessions(sessions: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Enabled sessions, of a given list if there is one; none at all is an error."""
    out = sessions.where("enabled")
    if only:
        out = out.where(F.col("id").isin(*only))
    if out.isEmpty():
        raise ValueError("no enabled session is selected")
    return out
