"""Scores and the reliability cascade as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import Settings
from . import text as T

#: Reasons that mean a candidate lacks or adds words.
INCOMPLETE_REASONS = ("EXTRA_LINE_END", "EXTRA_LINE_START", "LOW_MATCH_SCORE", "MISSING_LINE_BOUNDARIES", "MISSING_LINE_END", "MISSING_LINE_START", "MISSING_SENTENCE", "SEGMENT_BETTER_MATCH_ELSEWHERE", "SENTENCE_ORDER_MISMATCH", "SHORT_LINE_LOW_SCORE", "TECHNICAL_CLIPPING", "LOW_TECHNICAL_QUALITY", "MERGED_UNTRANSCRIBED_AUDIO", "EXCESS_TRANSCRIPT_WORDS", "UNCERTAIN_BOUNDARY_AUDIO")
SHORT_WORDS = 3


def _unusable(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def technical_score(clipping: Column, peak: Column, rms: Column, probability: Column) -> Column:
    """100 less what clipping, peaks, level and recogniser confidence take; 0 to 100."""
    score = (
        F.lit(100.0)
        - F.when(clipping > 0, 35.0).otherwise(0.0)
        - F.when(_unusable(peak), 40.0).when(peak > -0.05, 10.0).otherwise(0.0)
        - F.when(_unusable(rms), 30.0).when(rms < -45.0, 20.0).otherwise(0.0)
        + F.when(probability.isNull(), 0.0).otherwise(F.greatest(F.lit(-20.0), F.least(F.lit(0.0), (probability - 0.75) * 40.0)))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def duration_plausibility(n_words: Column, start: Column, end: Column) -> Column:
    """100 where a span lasts what its words should take at 2.7 words a second; less by the log of the ratio."""
    wanted = F.greatest(F.lit(0.35), F.greatest(F.lit(1), n_words) / F.lit(2.7))
    taken = F.greatest(F.lit(0.05), end - start)
    return F.lit(100.0) * F.exp(-F.abs(F.ln(F.greatest(F.lit(0.05), taken / wanted))) / F.lit(1.25))


def order_hint(segment: Column, segments: Column, line: Column, lines: Column) -> Column:
    share = lambda i, n: i / F.greatest(F.lit(1), n - 1)
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(share(segment, segments) - share(line, lines)))


def ranking_score(match: Column, duration: Column, order: Column, s: Settings) -> Column:
    return match + F.lit(float(s.duration_hint_weight)) * ((duration - 50.0) / 50.0) + F.lit(float(s.order_hint_weight)) * order


def path_utility(ranking: Column, count: Column, s: Settings) -> Column:
    return (ranking - 50.0) / 5.0 - F.lit(float(s.merge_span_penalty)) * (count - 1)


def selection_score(match: Column, technical: Column, probability: Column, clauses: Column, least_clause: Column, primary: Column, s: Settings) -> Column:
    complete = F.when(clauses >= 2, least_clause / 100.0).otherwise(1.0)
    return match + 0.10 * technical + 5.0 * F.coalesce(probability, F.lit(0.0)) + F.lit(float(s.clause_completeness_weight)) * complete + F.when(primary, float(s.primary_match_bonus)).otherwise(0.0)


def technical_flags(clipping: Column, rms: Column, transcript: Column) -> Column:
    return F.concat_ws(",", F.when(clipping > 0, "CLIPPING"), F.when(rms.isNull() | (rms == 0.0) | (rms < -45.0), "VERY_QUIET"), F.when(F.trim(T.text(transcript)) == "", "NO_TRANSCRIPT"))


def audible(duration: Column, rms: Column) -> Column:
    return (duration >= 0.15) & (F.coalesce(rms, F.lit(-999.0)) >= -45.0)


def sample_of(seconds: Column, rate: Column) -> Column:
    """Nearest sample, ties to the even one."""
    return F.bround(seconds * rate, 0).cast("long")


def segment_duration(measured: Column, start: Column, end: Column) -> Column:
    return F.coalesce(F.nullif(measured, F.lit(0.0)), end - start)


def shared_time(a0: Column, a1: Column, b0: Column, b1: Column, least_share: float = 0.2) -> Column:
    """Overlap in seconds, zero where it is less than least_share of the shorter."""
    both = F.least(a1, b1) - F.greatest(a0, b0)
    return F.when((both > 0) & (both >= least_share * F.least(a1 - a0, b1 - b0)), both).otherwise(0.0)


def silence_hallucination(transcript: Column, rms: Column, no_speech: Column, most_rms: float = -40.0, least: float = 0.80) -> Column:
    """Text where the level is low and some part is probably no speech; no_speech: array<double>."""
    return F.coalesce((F.trim(T.text(transcript)) != "") & (rms <= most_rms) & (F.array_max(no_speech) >= least), F.lit(False))


def needs_prompt(transcript: Column, probability: Column, ordered: Column, duration: Column, silence: Column, most_seconds: float = 6.0, least_probability: float = 0.55, least_ordered: float = 70.0) -> Column:
    weak = (F.trim(T.text(transcript)) == "") | probability.isNull() | (probability < least_probability) | (ordered < least_ordered)
    return F.coalesce(~silence & (duration <= most_seconds) & weak, F.lit(False))


def edge_vocalization(duration: Column, transcript: Column, rms: Column, s: Settings) -> Column:
    loud = F.coalesce(rms >= float(s.untranscribed_merge_min_rms_dbfs), F.lit(False))
    spoken = F.trim(T.text(transcript)) != ""
    return (duration <= float(s.edge_cue_extension_max_segment_seconds)) & F.when(spoken, T.is_paralinguistic(transcript)).otherwise(loud)


def removable_edge(transcript: Column, line: Column) -> Column:
    """A sound at a span's edge that the line doesn't ask for."""
    return T.is_paralinguistic(transcript) & ~F.arrays_overlap(T.words(T.folded(line, cues=True)), T.words(T.folded(transcript)))


def structurally_incomplete(missing_clauses: Column, reason: Column) -> Column:
    return (F.coalesce(missing_clauses, F.lit(0)) > 0) | T.text(reason).isin(*INCOMPLETE_REASONS)


def reliability_reason(line: Column, n_words: Column, match: Column, margin: Column, fidelity: Column, sentence: Column, s: Settings, *, technical: Column | None = None, clipping: Column | None = None, unsafe_merge: Column | None = None, duration: Column | None = None, resolved: Column | None = None) -> Column:
    """The first check that fails names the reason; empty where none does. n_words: spoken words of the line."""
    f, short = (lambda k: fidelity[k]), n_words <= SHORT_WORDS
    by_length = lambda a, b: F.when(short, a).otherwise(b)
    limit = lambda k: by_length(float(getattr(s, f"short_line_{k}")), float(getattr(s, f"reliable_{k}")))
    false = F.lit(False)
    no = lambda c: F.coalesce(c, false) if c is not None else false
    many = sentence["clause_count"] >= 2
    lead_extra, tail_extra = f("leading_extra_token_count") > 0, f("trailing_extra_token_count") > 0
    lead_anchor = (f("leading_missing_token_count") > 0) | (f("leading_substitution_count") > 0)
    tail_anchor = (f("trailing_missing_token_count") > 0) | (f("trailing_substitution_count") > 0)
    most = max(0, int(s.reliable_max_boundary_missing_tokens))
    lead_bad = lead_anchor | (f("prefix_missing_token_count") > most)
    tail_bad = tail_anchor | (f("suffix_missing_token_count") > most)
    order_reason = by_length("SHORT_LINE_ORDER_MISMATCH", "LOW_ORDERED_SIMILARITY")
    checks = [
        (T.is_nonverbal(line), F.lit("NONVERBAL_SCRIPT")),
        (no(clipping > 0 if clipping is not None else None) if s.auto_reject_clipping else false, F.lit("TECHNICAL_CLIPPING")),
        (no(technical < float(s.auto_min_technical_score) if technical is not None else None), F.lit("LOW_TECHNICAL_QUALITY")),
        (no(unsafe_merge), F.lit("MERGED_UNTRANSCRIBED_AUDIO")),
        (no(duration < float(s.reliable_min_duration_plausibility) if duration is not None else None), F.lit("POSSIBLE_REPEATED_TAKES")),
        (match < limit("min_score"), by_length("SHORT_LINE_LOW_SCORE", "LOW_MATCH_SCORE")),
        ((margin < limit("min_margin")) & ~no(resolved), by_length("SHORT_LINE_AMBIGUOUS", "AMBIGUOUS_MATCH")),
        (many & (sentence["missing_clause_count"] > 0), F.lit("MISSING_SENTENCE")),
        (short & (f("ordered_similarity") < limit("min_ordered_score")), order_reason),
        (short & (f("token_coverage") < limit("min_token_coverage")), F.lit("SHORT_LINE_INCOMPLETE_TRANSCRIPT")),
        (f("token_precision") < limit("min_token_precision"), by_length("SHORT_LINE_EXTRA_WORDS", "EXCESS_TRANSCRIPT_WORDS")),
        (~short & many & ~sentence["clauses_in_order"], F.lit("SENTENCE_ORDER_MISMATCH")),
        (~short & lead_extra & ~lead_anchor, F.lit("EXTRA_LINE_START")),
        (~short & tail_extra & ~tail_anchor, F.lit("EXTRA_LINE_END")),
        (~short & lead_bad & tail_bad, F.lit("MISSING_LINE_BOUNDARIES")),
        (~short & lead_bad, F.lit("MISSING_LINE_START")),
        (~short & tail_bad, F.lit("MISSING_LINE_END")),
        (~short & lead_extra, F.lit("EXTRA_LINE_START")),
        (~short & tail_extra, F.lit("EXTRA_LINE_END")),
        (~short & (f("token_coverage") < limit("min_token_coverage")), F.lit("INCOMPLETE_TRANSCRIPT")),
        (f("ordered_similarity") < limit("min_ordered_score"), order_reason),
        ((T.begins_with_cue(line) | T.ends_with_cue(line)) if s.edge_cue_auto_review else false, F.lit("EDGE_VOCALIZATION_UNVERIFIED")),
    ]
    out = F.when(checks[0][0], checks[0][1])
    for failed, reason in checks[1:]:
        out = out.when(failed, reason)
    return out.otherwise("")


def final_reason(reason: Column, verification_missing: Column, better_elsewhere: Column, forced: Column, unclean_edge: Column) -> Column:
    """Overrides after the cascade, the later ones over the earlier."""
    out = F.when(verification_missing, "EXACT_SPAN_ASR_FAILED").otherwise(reason)
    out = F.when(better_elsewhere, "SEGMENT_BETTER_MATCH_ELSEWHERE").otherwise(out)
    out = F.when(T.text(forced) != "", forced).otherwise(out)
    return F.when(unclean_edge, "EDGE_NON_SPEECH_AUDIO").otherwise(out)
