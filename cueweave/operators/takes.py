"""Groups of a line's candidates that are one take, and how alone in its session a span stands."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .recovery import pieces_of

ISOLATION_WEIGHT = 4.0


def isolation(spans: DataFrame, pieces: DataFrame, key: str = "session_id") -> DataFrame:
    """spans with isolation: the gaps before and after a span less twice the widest gap within it.

    pieces (key, start_index, start_seconds, end_seconds). A missing outer gap, at a session's end, counts as the
    widest of the others that are known; gaps are zero at least.
    """
    order = W.partitionBy(key).orderBy("start_index")
    gap = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), a - b))
    near = pieces.withColumns({"before": gap(F.col("start_seconds"), F.lag("end_seconds").over(order)), "after": gap(F.lead("start_seconds").over(order), F.col("end_seconds"))})
    at = pieces_of(spans, near.select(key, "start_index", "before", "after"), key)
    p, first, last = F.col("piece"), F.col("place") == 0, F.col("place") == F.col("count") - 1
    out = at.groupBy(key, "start_index", "count").agg(F.max(F.when(first, p["before"])).alias("lead"), F.max(F.when(last, p["after"])).alias("tail"), F.coalesce(F.max(F.when(~first, p["before"])), F.lit(0.0)).alias("inner"))
    most = F.greatest(F.coalesce("lead", F.lit(0.0)), F.coalesce("tail", F.lit(0.0)), "inner")
    return out.withColumn("isolation", F.coalesce("lead", most) + F.coalesce("tail", most) - 2.0 * F.col("inner")).drop("lead", "tail", "inner")


#: What comes first in a group: the better score, then selection, what wasn't edited by hand, the earlier row.
_ORDER = ("-coalesce(score, 0)", "-coalesce(selection_score, 0)", "coalesce(manual_edit, false)", "ordinal")


def _in_order() -> Column:
    return F.struct(*[F.expr(c).alias(f"o{i}") for i, c in enumerate(_ORDER)])


def exact_groups(candidates: DataFrame, line: str = "line_id") -> DataFrame:
    """candidates with group and place: those of a line with equal sessions and base segments are one group.

    candidates (line, segment_id, session_id, base_indices, score, selection_score, manual_edit, ordinal). Groups are
    numbered by their first ordinals.
    """
    same = W.partitionBy(line, "session_id", "base_indices")
    out = candidates.withColumns({"place": F.row_number().over(same.orderBy(_in_order())), "__first": F.min("ordinal").over(same)})
    return out.withColumn("group", F.dense_rank().over(W.partitionBy(line).orderBy("__first"))).drop("__first")


def root_of(a: list[int], b: list[int], by: list[float]) -> list[int]:
    """For nodes from a to b, b > a, in order: the place of the root that each joins, its own for a root."""
    starts, roots = [], []  # by start; roots share nothing, so their ends are in order too
    for i, (low, high) in enumerate(zip(a, b)):
        at = bisect_left(starts, high)
        if not at or b[roots[at - 1]] <= low:
            starts.insert(at, low)
            roots.insert(at, i)
    out = []
    for low, high in zip(a, b):
        at, best = bisect_left(starts, high) - 1, None
        while at >= 0 and b[roots[at]] > low:
            r = roots[at]
            rank = (max(low, a[r]) - min(high, b[r]), abs(low + high - a[r] - b[r]), by[r], r)
            best = rank if best is None else min(best, rank)
            at -= 1
        out.append(best[3])
    return out


def take_groups(candidates: DataFrame, line: str = "line_id") -> DataFrame:
    """candidates with group and place: variants of one take are together, the clearest performance first.

    candidates as for exact_groups, with start_seconds, end_seconds, isolation and repeated. Candidates of equal session
    and times are one node. In the order of repeated takes, then score + ISOLATION_WEIGHT * isolation, then isolation, a
    node that overlaps no root before it is a root; each other joins the root that covers the largest part of it, then
    the one whose middle is nearer. Roots share nothing, so a node's roots are found by bisection (root_of), over the
    nodes of a line and session; nodes without times or length, or without a priority, are folded in the engine.
    """
    micros = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    rows = candidates.withColumns({"__a": micros("start_seconds"), "__b": micros("end_seconds")})
    node = [line, "session_id", "__a", "__b"]
    head = F.min_by(F.struct("score", "isolation"), _in_order())
    nodes = rows.groupBy(*node).agg(head.alias("h"), F.bool_or(F.coalesce("repeated", F.lit(False))).alias("repeated"), F.min("ordinal").alias("ordinal"))
    priority = F.coalesce("h.score", F.lit(0.0)) + ISOLATION_WEIGHT * F.col("h.isolation")
    n = F.struct((~F.col("repeated")).alias("once"), (-priority).alias("by"), (-F.col("h.isolation")).alias("alone"), "ordinal", F.col("__a").alias("a"), F.col("__b").alias("b"))
    held = nodes.groupBy(line, "session_id").agg(F.array_sort(F.collect_list(n)).alias("n"))
    shared = lambda x, y: F.greatest(F.lit(0), F.least(x["b"], y["b"]) - F.greatest(x["a"], y["a"]))
    roots = F.aggregate("n", F.slice("n", 1, 0), lambda rs, x: F.when(F.exists(rs, lambda r: shared(r, x) > 0), rs).otherwise(F.concat(rs, F.array(x))))

    def owner(x: Column) -> Column:
        near = lambda r, i: F.struct((-shared(x, r)).alias("far"), F.abs(x["a"] + x["b"] - r["a"] - r["b"]).alias("off"), r["by"].alias("by"), i.alias("i"), r["a"].alias("a"), r["b"].alias("b"))
        return F.array_min(F.transform(F.col("roots"), near))

    @F.pandas_udf("array<int>")
    def places(a: pd.Series, b: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([root_of(x.tolist(), y.tolist(), z.tolist()) for x, y, z in zip(a, b, by)])

    field = lambda name: F.when(F.col("plain"), F.transform("n", lambda x: x[name])).otherwise(F.array())
    held = held.withColumn("plain", F.forall("n", lambda x: F.coalesce((x["b"] > x["a"]) & ~F.isnan(x["by"]) & x["by"].isNotNull(), F.lit(False))))
    held = held.withColumn("at", places(field("a"), field("b"), field("by")))
    pair = lambda x, o: F.struct(x["a"].alias("__a"), x["b"].alias("__b"), F.struct(o["a"].alias("a"), o["b"].alias("b")).alias("o"))
    found = F.when(F.col("plain"), F.transform("n", lambda x, i: pair(x, F.get("n", F.get("at", i))))).otherwise(F.transform("n", lambda x: pair(x, owner(x))))
    joined = held.withColumn("roots", F.when(F.col("plain"), F.slice("n", 1, 0)).otherwise(roots)).select(line, "session_id", F.explode(found).alias("x"))
    joined = joined.select(line, "session_id", "x.__a", "x.__b", F.col("x.o.a").alias("__ra"), F.col("x.o.b").alias("__rb"))
    out = rows.join(joined, node)
    take = W.partitionBy(line, "session_id", "__ra", "__rb")
    own = (F.col("__a") == F.col("__ra")) & (F.col("__b") == F.col("__rb"))
    out = out.withColumns({"place": F.row_number().over(take.orderBy(F.desc(own), _in_order())), "__first": F.min("ordinal").over(take)})
    return out.withColumn("group", F.dense_rank().over(W.partitionBy(line).orderBy("__first"))).drop("__a", "__b", "__ra", "__rb", "__first")
