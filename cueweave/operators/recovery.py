"""Spans near a proposed one: without removable edges, parts of it, with its neighbours; checks of merges; budgets.

Every operator works on spans (key, start_index, count) over pieces (key, start_index, ...), base segments in order. A
span has at most max_merge_segments pieces, so what is exploded from a span is bounded by that number's square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..settings import Settings


def pieces_of(spans: DataFrame, pieces: DataFrame, key: str = "session_id") -> DataFrame:
    """Each span beside its pieces: (span's columns, place from 0, pieces' columns as struct `piece`)."""
    at = spans.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).withColumn("piece_index", F.col("start_index") + F.col("place"))
    held = pieces.select(F.col(key).alias("of_key"), F.col("start_index").alias("of_index"), F.struct(*[c for c in pieces.columns if c not in (key, "start_index")]).alias("piece"))
    return at.join(held, (F.col(key) == F.col("of_key")) & (F.col("piece_index") == F.col("of_index"))).drop("of_key", "of_index", "piece_index")


def proper_subspans(spans: DataFrame) -> DataFrame:
    """(span's columns, sub_start, sub_count) of every shorter span within each span."""
    one = spans.withColumn("sub_count", F.explode(F.filter(F.sequence(F.lit(0), F.col("count") - 1), lambda n: n > 0)))
    shifts = F.explode(F.sequence(F.lit(0), F.col("count") - F.col("sub_count")))
    return one.withColumn("shift", shifts).withColumn("sub_start", F.col("start_index") + F.col("shift")).drop("shift")


def without_removable_edges(spans: DataFrame, pieces: DataFrame, key: str = "session_id", s: Settings = Settings()) -> DataFrame:
    """(key, from_index, from_count, start_index, count): every shorter span that only removable edge pieces are missing from.

    pieces (key, start_index, removable). What can be reached by dropping one removable edge piece after another is
    what the removable runs at both ends allow: any part of the one with any part of the other, one piece being left.
    """
    if not s.boundary_noise_cleanup_enabled:
        spans = spans.where(F.lit(False))
    held = pieces_of(spans, pieces, key).groupBy(key, "start_index", "count").agg(F.count("*").alias("known"), F.min(F.when(~F.col("piece.removable"), F.col("place"))).alias("first"), F.max(F.when(~F.col("piece.removable"), F.col("place"))).alias("last"))
    held = held.where(F.col("known") == F.col("count"))
    lead = F.coalesce("first", F.col("count"))
    tail = F.coalesce(F.col("count") - 1 - F.col("last"), F.col("count"))
    cut = held.withColumn("a", F.explode(F.sequence(F.lit(0), lead))).withColumn("b", F.explode(F.sequence(F.lit(0), tail)))
    cut = cut.where((F.col("a") + F.col("b") > 0) & (F.col("a") + F.col("b") < F.col("count")))
    return cut.select(key, F.col("start_index").alias("from_index"), F.col("count").alias("from_count"), (F.col("start_index") + F.col("a")).alias("start_index"), (F.col("count") - F.col("a") - F.col("b")).alias("count"))


def cleaner(match: Column, fidelity: Column, sentence: Column, before: Column, s: Settings, least_share: float = 0.85) -> Column:
    """Whether a span without noise may replace its source: complete, in order, and better in extras or precision."""
    whole = (match >= float(s.boundary_noise_cleanup_min_match_score)) & (fidelity["token_coverage"] >= least_share) & (fidelity["token_precision"] >= least_share)
    edges = (fidelity["leading_extra_token_count"] == 0) & (fidelity["trailing_extra_token_count"] == 0)
    clauses = (sentence["missing_clause_count"] == 0) & sentence["clauses_in_order"]
    better = (fidelity["extra_word_count"] < before["extra_word_count"]) | (fidelity["token_precision"] > before["token_precision"])
    return F.coalesce(whole & edges & clauses & better, F.lit(False))


def edge_extensions(actions: DataFrame, pieces: DataFrame, s: Settings, key: str = "session_id") -> DataFrame:
    """(key, from_index, start_index, count, side): spans with the vocal neighbour that an edge cue of their line asks for.

    actions (key, start_index, count, opens_with_cue, closes_with_cue); pieces (key, start_index, start_seconds,
    end_seconds, vocal). The neighbour is at most edge_cue_extension_max_gap_seconds away. Each is to be reviewed by hand.
    """
    most_gap = float(s.edge_cue_extension_max_gap_seconds)
    actions = actions.where(F.lit(bool(s.edge_cue_extension_enabled)))
    order = W.partitionBy(key).orderBy("start_index")
    near = pieces.select(key, F.col("start_index").alias("at"), (F.col("start_seconds") - F.lag("end_seconds").over(order)).alias("gap_before"), (F.lead("start_seconds").over(order) - F.col("end_seconds")).alias("gap_after"), F.lag("vocal").over(order).alias("vocal_before"), F.lead("vocal").over(order).alias("vocal_after"))
    ends = actions.withColumn("last", F.col("start_index") + F.col("count") - 1)
    lead = ends.where("opens_with_cue").join(near.withColumnRenamed("at", "start_index"), [key, "start_index"]).where((F.col("gap_before") <= most_gap) & F.col("vocal_before"))
    tail = ends.where("closes_with_cue").join(near.withColumnRenamed("at", "last"), [key, "last"]).where((F.col("gap_after") <= most_gap) & F.col("vocal_after"))
    more = lambda df, side, shift: df.select(key, F.col("start_index").alias("from_index"), (F.col("start_index") - shift).alias("start_index"), (F.col("count") + 1).alias("count"), F.lit(side).alias("side"))
    return more(lead, "start", 1).unionByName(more(tail, "end", 0))


def untranscribed_pieces(spans: DataFrame, pieces: DataFrame, s: Settings, key: str = "session_id") -> DataFrame:
    """(key, start_index, count, unsafe): spans of several pieces with a long one without words that is or may be loud.

    pieces (key, start_index, duration_seconds, rms_dbfs, transcript, silence_rejected).
    """
    p, least_seconds, least_rms = F.col("piece"), float(s.untranscribed_merge_min_seconds), float(s.untranscribed_merge_min_rms_dbfs)
    wordless = (F.trim(T.text(p["transcript"])) == "") | F.coalesce(p["silence_rejected"], F.lit(False))
    bad = wordless & (p["duration_seconds"] >= least_seconds) & F.coalesce(p["rms_dbfs"] >= least_rms, F.lit(True))
    return pieces_of(spans, pieces, key).groupBy(key, "start_index", "count").agg((F.bool_or(F.coalesce(bad, F.lit(False))) & (F.count("*") > 1) & F.lit(bool(s.auto_reject_untranscribed_merge))).alias("unsafe"))


def foreign_edges(spans: DataFrame, pieces: DataFrame, exact: DataFrame, s: Settings, key: str = "session_id") -> DataFrame:
    """(key, start_index, count, foreign): an edge piece shares no word with the exact text and is a sound or long and loud.

    exact (key, start_index, count, exact_text).
    """
    edge = (F.col("place") == 0) | (F.col("place") == F.col("count") - 1)
    at = pieces_of(spans.where("count > 1"), pieces, key).where(edge).join(exact, [key, "start_index", "count"])
    p, least_seconds, least_rms = F.col("piece"), float(s.untranscribed_merge_min_seconds), float(s.untranscribed_merge_min_rms_dbfs)
    said = T.words(T.folded(p["transcript"]))
    apart = (F.size(said) > 0) & ~F.arrays_overlap(said, T.words(T.folded(F.col("exact_text"))))
    heard = T.is_paralinguistic(p["transcript"]) | ((p["duration_seconds"] >= max(2.0, 3.0 * least_seconds)) & F.coalesce(p["rms_dbfs"] >= least_rms, F.lit(True)))
    return at.groupBy(key, "start_index", "count").agg(F.bool_or(F.coalesce(apart & heard, F.lit(False))).alias("foreign"))


def missing_clauses(sentence: Column, s: Settings) -> Column:
    """Indexes of the clauses that score too low, or are short and not wholly covered.

    sentence: clause_scores, clause_token_coverages, clause_word_counts.
    """
    def missing(i: Column) -> Column:
        short = F.get(sentence["clause_word_counts"], i) <= int(s.reliable_short_clause_max_words)
        bare = F.get(sentence["clause_token_coverages"], i) < float(s.reliable_short_clause_min_token_coverage)
        return (F.get(sentence["clause_scores"], i) < float(s.reliable_min_clause_score)) | (short & bare)

    every = F.filter(F.sequence(F.lit(-1), F.size(sentence["clause_scores"]) - 1), lambda i: i >= 0)
    return F.filter(every, missing)


def within_budgets(rows: DataFrame, groups: list[str], first: str, second: str, order: Column, most_first: int, most_second: int) -> DataFrame:
    """Rows taken in order within each group while neither their `first` nor their `second` has had its number.

    Greedy by its nature: a row that one budget refuses spends nothing of the other. A group's rows are folded in one
    pass over its ordered keys, in the engine; a group is what one task can hold, as one session's trims are.
    """
    whole = F.struct(*rows.columns)
    held = rows.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(order.alias("by"), F.xxhash64(first).alias("a"), F.xxhash64(second).alias("b"), whole.alias("row")))).alias("rows"))
    many = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    nothing = F.struct(*[F.array().cast("array<bigint>").alias(c) for c in ("a", "b")], F.array().cast("array<int>").alias("kept"), F.lit(0).alias("at"))

    def step(s: Column, r: Column) -> Column:
        fits = (many(s["a"], r["a"]) < most_first) & (many(s["b"], r["b"]) < most_second)
        added = lambda xs, x: F.when(fits, F.concat(xs, F.array(x))).otherwise(xs)
        return F.struct(added(s["a"], r["a"]).alias("a"), added(s["b"], r["b"]).alias("b"), added(s["kept"], s["at"]).alias("kept"), (s["at"] + 1).alias("at"))

    taken = held.select("rows", F.aggregate("rows", nothing, step, lambda s: s["kept"]).alias("kept"))
    return taken.select(F.explode(F.transform("kept", lambda i: F.get("rows", i)["row"])).alias("row")).select("row.*")


def trims_within_budgets(trims: DataFrame, order: Column, s: Settings, key: str = "session_id") -> DataFrame:
    """Of each session's trims (key, line_index, segment_index, ...) those that the budgets of lines and segments allow."""
    return within_budgets(trims, [key], "line_index", "segment_index", order, int(s.intra_segment_trim_max_actions_per_line), int(s.intra_segment_trim_max_actions_per_segment))
