"""What a review shows: lists of lines, pools, and the marks that a log of clicks leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The columns that a list can be sorted by, and what each compares; text without regard to case where it is said.
SORTS = {
    "index": ("index",),
    "status": ("status", "sheet", "excel_row"),
    "sheet": ("sheet", "excel_row"),
    "line": ("lower(line_text)",),
    "target": ("lower(target_filename)",),
    "type": ("type", "sheet", "excel_row"),
    "score": ("coalesce(selected_score, -1.0)",),
}


def listed(lines: DataFrame, sort: str = "index", descending: bool = False, status: str | None = None) -> DataFrame:
    """Lines of a status, or all, sorted; equal ones in the order of `index` either way."""
    out = lines if status is None else lines.where(F.col("status") == status)
    by = [F.expr(c) for c in SORTS[sort]]
    return out.orderBy(*[c.desc() if descending else c.asc() for c in by], "index")


def shows_pool(type_: Column, status: Column, n_aligned: Column) -> Column:
    """Whether a line offers the unmatched pool: nonverbal lines, and open ones with no candidate but manual edits."""
    return F.coalesce((type_ == "nonverbal") | ((F.coalesce(n_aligned, F.lit(0)) == 0) & status.isin("REVIEW", "MISSING", "MANUALLY_REVIEWED", "RETAKE")), F.lit(False))


def marked(lines: DataFrame, log: DataFrame) -> DataFrame:
    """lines after a log (event_id, line_id, action, segment_id) of `toggle` and `retake`.

    lines (line_id, type, status, selected_segment_id, n_candidates). A toggle selects its segment or, where that is
    selected, nothing again; a retake selects nothing. So the last action, and how often it was repeated without another
    between, decide: a window, no fold. What was selected at first counts as a toggle before all others.
    """
    first = lines.where("selected_segment_id is not null").select(F.lit(None).cast("long").alias("event_id"), "line_id", F.lit("toggle").alias("action"), F.col("selected_segment_id").alias("segment_id"))
    order = W.partitionBy("line_id").orderBy(F.asc_nulls_first("event_id"))
    run = log.select("event_id", "line_id", "action", F.when(F.col("action") == "toggle", F.col("segment_id")).alias("segment_id")).unionByName(first)
    same = F.col("action").eqNullSafe(F.lag("action").over(order)) & F.col("segment_id").eqNullSafe(F.lag("segment_id").over(order))
    run = run.withColumn("new", (~same).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = run.groupBy("line_id", "run").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.max("action").alias("action"), F.max("segment_id").alias("segment_id"))
    last = runs.groupBy("line_id").agg(F.max_by(F.struct("n", "last_event", "action", "segment_id"), "run").alias("m"))
    out = lines.join(last, "line_id", "left")
    touched, odd = F.col("m.last_event").isNotNull(), F.col("m.n") % 2 == 1
    toggled = F.when(odd, "MANUALLY_REVIEWED").when((F.col("type") == "normal") & (F.col("n_candidates") == 0), "MISSING").otherwise("REVIEW")
    status = F.when(~F.coalesce(touched, F.lit(False)), F.col("status")).when(F.col("m.action") == "retake", "RETAKE").otherwise(toggled)
    selected = F.when(~F.coalesce(touched, F.lit(False)), F.col("selected_segment_id")).when((F.col("m.action") == "toggle") & odd, F.col("m.segment_id"))
    return out.withColumns({"status": status, "selected_segment_id": selected}).select(*lines.columns)


def with_manual_candidate(candidates: DataFrame, wanted: DataFrame, segments: DataFrame, line: str = "line_id") -> DataFrame:
    """candidates and those that were asked for by hand: (line, segment_id) of known segments, once, with manual set.

    A wanted segment whose base segments a candidate of the line already covers exactly isn't added.
    """
    known = wanted.distinct().join(segments, "segment_id").join(candidates.select(line, "segment_id"), [line, "segment_id"], "left_anti")
    fresh = known.join(candidates.select(line, "session_id", "base_indices"), [line, "session_id", "base_indices"], "left_anti").withColumn("manual", F.lit(True))
    return candidates.unionByName(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(t).alias(c) for c, t in candidates.dtypes]))
