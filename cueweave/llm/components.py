"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join that adaptive execution may
split, so that a hub with a third of all links isn't one task's work. The links are cut to the shared folder
after each round; nothing is collected but two numbers that tell when the rounds are over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MOST_ROUNDS = 60


def _digest(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")).first()
    return row["n"], row["s"] or 0


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
    moved = links.join(least, F.col("a") == F.col("w")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("w", "m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of one orderable type, any direction. Returns (node, root), root the least node of its component.

    Nodes without a link don't appear. Links with a null end and links of a node to itself are ignored.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("ok"))
    links = cut(links.where("ok").select("a", "b").distinct())
    seen = _digest(links)
    for _ in range(MOST_ROUNDS if seen[0] else 0):
        links = cut(_small_star(_large_star(links)))
        now = _digest(links)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components didn't settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select("b", "b").distinct())
