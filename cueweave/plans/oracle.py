"""DuckDB SQL for the queries of queries.py, written from the operators' definitions. Queries that SQL can't express, or
not on whole tables in reasonable time, have none and are tested against brute force on small fixtures."""

from __future__ import annotations

from ..functions import text as T
from . import review_oracle

_TIMELINE = "t AS (SELECT user_id AS session_id, event_id AS segment_id, event_type, value, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 60.0 AS e FROM events)"
_NORMAL = r"trim(regexp_replace(lower(replace(replace({0}, '’', ''''), '‘', '''')), '[^\p{{L}}\p{{N}}_'']+', ' ', 'g'))"
_VERBAL = r"trim(regexp_replace(regexp_replace({0}, '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spoken_length(w: str) -> str:
    """How many words a token stands for."""
    listed = " ".join(f"WHEN {_quoted(k)} THEN {len(v.split())}" for k, v in T.SPOKEN_FORMS.items())
    ends = " OR ".join(f"(ends_with({w}, {_quoted(e)}) AND length({w}) > {len(e)})" for e in ("n't", *T.ENDINGS))
    return f"coalesce(CASE {w} {listed} END, CASE WHEN {ends} THEN 2 ELSE 1 END)"


def _hesitating(c: str) -> str:
    return f"{_NORMAL.format(c)} IN ({', '.join(map(_quoted, T.HESITATIONS))})"


_SILENCES = f"""{_TIMELINE}, r AS (SELECT session_id, s - min(s) OVER (PARTITION BY session_id) AS a, e - min(s) OVER (PARTITION BY session_id) AS b FROM t),
d AS (SELECT session_id, max(b) + 3600.0 AS dur FROM r GROUP BY 1),
m AS (SELECT session_id, a, b FROM r WHERE b - a >= 600.0 UNION ALL SELECT session_id, dur, NULL FROM d),
g AS (SELECT m.*, greatest(0.0, coalesce(max(b) OVER (PARTITION BY m.session_id ORDER BY b IS NULL, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS ss FROM m),
regions AS (SELECT g.session_id, ss, greatest(ss, a) AS se, greatest(0.0, ss - {{pre}}) AS st, CASE WHEN b IS NULL THEN dur ELSE least(dur, greatest(ss, a) + {{post}}) END AS en FROM g JOIN d USING (session_id) WHERE greatest(ss, a) - ss >= 300.0)"""

_SPANS = f"""{_TIMELINE}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s, e, segment_id) - 1 AS i, lag(e) OVER (PARTITION BY session_id ORDER BY s, e, segment_id) AS pe FROM t),
runs AS (SELECT *, sum(CASE WHEN greatest(0.0, s - pe) > 28800.0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY i) AS run FROM n),
pairs AS (SELECT a.session_id, a.i, b.i - a.i + 1 AS n, a.s AS start_seconds, b.e AS end_seconds FROM runs a JOIN runs b ON a.session_id = b.session_id AND a.run = b.run AND b.i BETWEEN a.i AND a.i + 7),
spans AS (SELECT p.session_id, p.i, p.n, any_value(p.start_seconds) AS start_seconds, any_value(p.end_seconds) AS end_seconds, string_agg(x.event_type, ' ' ORDER BY x.i) AS transcript, avg(x.value / 500.0) AS probability
  FROM pairs p JOIN runs x ON x.session_id = p.session_id AND x.i BETWEEN p.i AND p.i + p.n - 1 GROUP BY p.session_id, p.i, p.n HAVING max(x.e) - any_value(p.start_seconds) <= 259200.0)"""

SQL: dict[str, str] = {
    "q02_token_counts": f"""SELECT doc_id, md5({_NORMAL.format('text')}) AS normal_md5, len(list_filter(string_split({_NORMAL.format('text')}, ' '), lambda w: w <> '')) AS n_words,
        CAST(list_sum(list_transform(list_filter(string_split({_NORMAL.format('text')}, ' '), lambda w: w <> ''), lambda w: {_spoken_length('w')})) AS BIGINT) AS n_spoken, md5({_VERBAL.format('text')}) AS verbal_md5 FROM documents""",
    "q03_clauses": f"""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex({_VERBAL.format('text')}, '[.!?]+'), lambda c: trim(c)), lambda c: {_NORMAL.format('c')} <> '')) AS c, generate_subscripts(list_filter(list_transform(string_split_regex({_VERBAL.format('text')}, '[.!?]+'), lambda c: trim(c)), lambda c: {_NORMAL.format('c')} <> ''), 1) AS i FROM documents),
        h AS (SELECT *, {_hesitating('c')} AS lone FROM p),
        j AS (SELECT *, CASE WHEN i > 1 AND (lone OR lag(lone) OVER (PARTITION BY doc_id ORDER BY i)) THEN 0 ELSE 1 END AS fresh FROM h),
        k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS clause FROM j),
        m AS (SELECT doc_id, clause, string_agg(c, ' ' ORDER BY i) AS c FROM k GROUP BY 1, 2)
        SELECT d.doc_id, count(m.c) AS n_clauses, md5(coalesce(string_agg(m.c, '|' ORDER BY clause), '')) AS clauses_md5 FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id""",
    "q04_duplicate_lines": f"SELECT min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY {_NORMAL.format('text')} HAVING count(*) > 1",
    "q05_gap_regions": f"WITH {_SILENCES.format(pre='450.0', post='750.0')} SELECT session_id, round(ss, 3) AS speech_start, round(se, 3) AS speech_end, round(st, 3) AS start, round(en, 3) AS \"end\" FROM regions",
    "q06_padded_regions": f"""WITH {_SILENCES.format(pre='9000.0', post='9000.0')},
        x AS (SELECT *, lead(st) OVER w AS nst, lead(ss) OVER w AS nss, lag(en) OVER w AS pen, lag(se) OVER w AS pse FROM regions WINDOW w AS (PARTITION BY session_id ORDER BY ss, se)),
        y AS (SELECT session_id, ss, se, CASE WHEN pen > st THEN greatest(st, (pse + ss) / 2.0) ELSE st END AS st, CASE WHEN en > nst THEN least(en, (se + nss) / 2.0) ELSE en END AS en FROM x)
        SELECT session_id, round(ss, 3) AS speech_start, round(se, 3) AS speech_end, round(st, 3) AS start, round(en, 3) AS "end" FROM y WHERE en > st""",
    "q07_spans": f"WITH {_SPANS} SELECT session_id, i AS start_index, n, round(start_seconds, 9) AS start_seconds, round(end_seconds, 9) AS end_seconds, transcript, round(probability, 9) AS probability FROM spans",
    "q08_take_clusters": f"""WITH {_TIMELINE}, n AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY session_id ORDER BY s, e) > 43200.0 THEN 1 ELSE 0 END AS new FROM t),
        k AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS cluster FROM n)
        SELECT session_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(min(s), 3) AS first_start, round(max(e), 3) AS last_end FROM k GROUP BY 1, 2""",
    "q09_nearest_anchor": f"""WITH {_TIMELINE}, p AS (SELECT x.segment_id, a.segment_id AS anchor_id, row_number() OVER (PARTITION BY x.segment_id ORDER BY abs(x.s - a.s), a.segment_id) AS k FROM t x LEFT JOIN t a ON a.session_id = x.session_id AND a.event_type = 'purchase' WHERE x.event_type <> 'purchase')
        SELECT segment_id, anchor_id FROM p WHERE k = 1""",
    "q10_points_in_windows": f"WITH {_TIMELINE} SELECT w.segment_id AS window_id, count(*) AS n, round(avg(x.value), 6) AS mean_value FROM t w JOIN t x ON x.session_id = w.session_id AND (x.s + x.e) / 2.0 BETWEEN w.s - 21600.0 AND w.s + 21600.0 WHERE w.event_type = 'purchase' GROUP BY 1",
    "q11_overlaps": f"WITH {_TIMELINE} SELECT a.segment_id AS l_id, b.segment_id AS r_id, round(least(a.e, b.e) - greatest(a.s, b.s), 3) AS shared FROM t a JOIN t b ON a.session_id = b.session_id AND least(a.e, b.e) > greatest(a.s, b.s) WHERE a.event_type = 'error' AND b.event_type <> 'error'",
    "q13_margin": f"""WITH {_TIMELINE}, x AS (SELECT session_id, event_type AS item, max(value) AS score FROM t GROUP BY 1, 2)
        SELECT session_id, item, round(score, 6) AS score, round(score - coalesce((SELECT max(score) FROM x y WHERE y.session_id = x.session_id AND y.item <> x.item), 0.0), 6) AS margin FROM x""",
    "q14_top_candidates": f"WITH {_TIMELINE}, r AS (SELECT session_id, segment_id, value, row_number() OVER (PARTITION BY session_id ORDER BY value DESC, segment_id) AS rank FROM t) SELECT * FROM r WHERE rank <= 8",
    "q15_score_cut": f"""WITH {_TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY value DESC, segment_id) AS k FROM t), e AS (SELECT * FROM r WHERE k <= 8),
        g AS (SELECT session_id, k, value, value - lead(value) OVER w AS gap, (value + lead(value) OVER w) / 2.0 AS middle FROM e WINDOW w AS (PARTITION BY session_id ORDER BY k)),
        c AS (SELECT session_id, max(value) AS best, max(gap) AS widest, arg_max(middle, (gap, k)) FILTER (gap IS NOT NULL) AS middle FROM g GROUP BY 1)
        SELECT session_id, round(CASE WHEN widest >= 12.0 THEN greatest(best - 15.0, middle) ELSE best - 15.0 END, 6) AS cutoff FROM c""",
    "q17_duration_plausibility": f"""WITH d AS (SELECT doc_id, n_chars, len(list_filter(string_split({_NORMAL.format('text')}, ' '), lambda w: w <> '')) AS n FROM documents)
        SELECT doc_id, round(100.0 * exp(-abs(ln(greatest(0.05, greatest(0.05, n_chars / 14.0) / greatest(0.35, greatest(1, n) / 2.7)))) / 1.25), 5) AS plausibility FROM d""",
    "q18_technical_score": f"""WITH {_TIMELINE}, m AS (SELECT segment_id, event_type, event_type = 'error' AS clip, value / 100.0 - 1.0 AS peak, CASE WHEN event_type = 'view' THEN NULL ELSE -value / 2.0 END AS rms, value / 100.0 AS p FROM t)
        SELECT segment_id, round(greatest(0.0, least(100.0, 100.0 - CASE WHEN clip THEN 35.0 ELSE 0.0 END - CASE WHEN peak > -0.05 THEN 10.0 ELSE 0.0 END - CASE WHEN rms IS NULL THEN 30.0 WHEN rms < -45.0 THEN 20.0 ELSE 0.0 END + greatest(-20.0, least(0.0, (p - 0.75) * 40.0)))), 6) AS score,
        concat_ws(',', CASE WHEN clip THEN 'CLIPPING' END, CASE WHEN rms IS NULL OR rms = 0.0 OR rms < -45.0 THEN 'VERY_QUIET' END, CASE WHEN event_type = 'click' THEN 'NO_TRANSCRIPT' END) AS flags FROM m""",
    "q19_reliability": """WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber <= 3 AS short, l_partkey AS p, l_quantity AS q, l_quantity * 2.0 AS ordered, 1.0 - l_discount AS coverage, 1.0 - l_tax * 4.0 AS prec, 50.0 + l_quantity AS match, l_extendedprice % 40.0 AS margin, l_linenumber % 3 >= 2 AS many, l_suppkey % 4 = 0 AS missing, l_suppkey % 5 <> 0 AS inorder,
            l_partkey % 13 > 11 AS le, l_partkey % 23 > 21 AS te, l_partkey % 11 > 9 OR l_partkey % 17 > 15 AS la, l_partkey % 19 > 17 OR l_partkey % 29 > 27 AS ta, l_partkey % 5 > 3 AS pm, l_partkey % 7 > 5 AS sm FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN p % 31 = 0 THEN 'TECHNICAL_CLIPPING' WHEN q + 20.0 < 25.0 THEN 'POSSIBLE_REPEATED_TAKES'
            WHEN match < CASE WHEN short THEN 88.0 ELSE 72.0 END THEN CASE WHEN short THEN 'SHORT_LINE_LOW_SCORE' ELSE 'LOW_MATCH_SCORE' END
            WHEN margin < CASE WHEN short THEN 15.0 ELSE 8.0 END THEN CASE WHEN short THEN 'SHORT_LINE_AMBIGUOUS' ELSE 'AMBIGUOUS_MATCH' END
            WHEN many AND missing THEN 'MISSING_SENTENCE' WHEN short AND ordered < 70.0 THEN 'SHORT_LINE_ORDER_MISMATCH' WHEN short AND coverage < 1.0 THEN 'SHORT_LINE_INCOMPLETE_TRANSCRIPT'
            WHEN prec < CASE WHEN short THEN 1.0 ELSE 0.7 END THEN CASE WHEN short THEN 'SHORT_LINE_EXTRA_WORDS' ELSE 'EXCESS_TRANSCRIPT_WORDS' END
            WHEN NOT short AND many AND NOT inorder THEN 'SENTENCE_ORDER_MISMATCH' WHEN NOT short AND le AND NOT la THEN 'EXTRA_LINE_START' WHEN NOT short AND te AND NOT ta THEN 'EXTRA_LINE_END'
            WHEN NOT short AND (la OR pm) AND (ta OR sm) THEN 'MISSING_LINE_BOUNDARIES' WHEN NOT short AND (la OR pm) THEN 'MISSING_LINE_START' WHEN NOT short AND (ta OR sm) THEN 'MISSING_LINE_END'
            WHEN NOT short AND coverage < 0.6 THEN 'INCOMPLETE_TRANSCRIPT' WHEN ordered < CASE WHEN short THEN 70.0 ELSE 55.0 END THEN CASE WHEN short THEN 'SHORT_LINE_ORDER_MISMATCH' ELSE 'LOW_ORDERED_SIMILARITY' END ELSE '' END AS reason FROM x""",
    "q20_selection_rank": """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity + 0.10 * (l_discount * 1000.0) + 5.0 * l_tax + 5.0 * CASE WHEN l_linenumber >= 2 THEN l_quantity / 100.0 ELSE 1.0 END + CASE WHEN l_returnflag = 'R' THEN 2.0 ELSE 0.0 END AS score FROM lineitem)
        SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS rank, round(score, 6) AS score FROM x""",
    "q22_merged_reviews": """WITH n AS (SELECT o_custkey AS line_id, list({'s': o_orderkey, 'p': o_totalprice, 'm': o_orderpriority = '1-URGENT'} ORDER BY o_orderkey) AS c, max(o_orderkey) AS sug FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
        o AS (SELECT o_custkey AS line_id, list({'s': o_orderkey, 'p': o_totalprice, 'm': o_orderpriority = '1-URGENT'} ORDER BY o_orderkey) AS c, min(o_orderkey) AS had FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1),
        j AS (SELECT n.line_id, n.c AS nc, sug, had, n.line_id % 3 AS k, o.c AS oc FROM n LEFT JOIN o USING (line_id)),
        every AS (SELECT line_id, unnest(list_concat(nc, coalesce(list_filter(oc, lambda x: x.m OR (k = 1 AND x.s = had)), []))) AS x FROM j),
        g AS (SELECT line_id, string_agg(x.s, ',' ORDER BY x.p DESC) AS candidates FROM every GROUP BY 1)
        SELECT line_id, CASE WHEN had IS NOT NULL AND k = 0 THEN 'RETAKE' WHEN had IS NOT NULL AND k = 1 THEN 'MANUALLY_REVIEWED' ELSE 'REVIEW' END AS status, sug AS suggested_segment_id, CASE WHEN k = 1 THEN had END AS selected_segment_id, candidates FROM j JOIN g USING (line_id)""",
    "q23_unmatched_pool": f"""WITH {_TIMELINE}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s, e, segment_id) - 1 AS i FROM t), c AS (SELECT DISTINCT session_id, i + d AS i FROM n, (VALUES (0), (1)) v(d) WHERE event_type = 'purchase')
        SELECT session_id, segment_id, i AS base_index FROM n WHERE value >= 5.0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = n.session_id AND c.i = n.i)""",
    "q24_export_errors": """WITH r AS (SELECT o_orderkey AS line_id, CASE o_orderkey % 50 WHEN 0 THEN 'a/b' WHEN 1 THEN ' ' ELSE 'Take_' || (o_orderkey % 14000) END AS name, o_custkey * 20 + o_orderkey % 20 AS seg FROM orders WHERE o_orderstatus <> 'P'),
        s AS (SELECT p_partkey * 13 AS seg, p_size > 3 AS there, p_size > 45 AS odd FROM part),
        c AS (SELECT r.*, CASE WHEN s.seg IS NULL THEN 'UNKNOWN_SEGMENT' WHEN trim(name) = '' OR name LIKE '%/%' THEN 'INVALID_TARGET_FILENAME' WHEN NOT there THEN 'SEGMENT_FILE_MISSING' WHEN odd THEN 'FORMAT_MISMATCH' END AS own FROM r LEFT JOIN s USING (seg)),
        g AS (SELECT *, lower(name || '.wav') AS target, count(*) OVER (PARTITION BY seg) AS k, count(*) OVER (PARTITION BY lower(name)) AS m FROM c WHERE own IS NULL)
        SELECT line_id, own AS error, CAST(seg AS VARCHAR) AS detail FROM c WHERE own IS NOT NULL UNION ALL SELECT line_id, 'SEGMENT_REUSED', CAST(seg AS VARCHAR) FROM g WHERE k > 1 UNION ALL SELECT line_id, 'DUPLICATE_TARGET', target FROM g WHERE m > 1
        UNION ALL SELECT line_id, 'OUTPUT_EXISTS', target FROM g WHERE target IN (SELECT lower('TAKE_' || (c_custkey * 7) || '.WAV') FROM customer)""",
    "q26_retakes": "SELECT c_custkey AS line_id, 'n' || c_nationkey AS sheet, c_custkey AS excel_row, CASE WHEN lag(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = c_mktsegment THEN '' ELSE c_mktsegment END AS shown_quest FROM customer WHERE c_acctbal > 3000",
    "q27_row_ranges": """WITH x AS (SELECT DISTINCT l_suppkey, l_partkey AS n FROM lineitem), i AS (SELECT *, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS run FROM x), g AS (SELECT l_suppkey, min(n) AS a, max(n) AS b FROM i GROUP BY l_suppkey, run),
        w AS (SELECT l_suppkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges, min(a) AS least FROM g GROUP BY 1)
        SELECT l_suppkey, ranges, CASE WHEN least > 0 THEN true END AS reads_back FROM w""",
    "q29_median_gap": f"WITH {_TIMELINE}, g AS (SELECT session_id, s - lag(e) OVER (PARTITION BY session_id ORDER BY s, e) AS gap FROM t) SELECT session_id, count(gap) AS n_gaps, round(median(gap), 3) AS median_gap FROM g WHERE gap IS NOT NULL GROUP BY 1",
    "q30_cache_misses": "SELECT DISTINCT (l_partkey % 997) || '-' || l_linenumber AS cache_key FROM lineitem WHERE (l_partkey % 997) || '-' || l_linenumber NOT IN (SELECT (p_partkey % 997) || '-' || (p_size % 5) FROM part)",
    "q31_segment_usage": "WITH x AS (SELECT l_orderkey AS line_id, l_suppkey AS session_id, CAST(l_linenumber + d AS BIGINT) AS base_index FROM lineitem, (VALUES (0), (1)) v(d)) SELECT session_id, base_index, count(DISTINCT line_id) AS n_lines, bool_or(line_id = 7) AS used_here, bool_or(line_id <> 7) AS used_elsewhere FROM x GROUP BY 1, 2",
    "q32_edit_sources": "WITH RECURSIVE r AS (SELECT c_custkey AS segment_id, c_custkey AS a, 0 AS steps FROM customer UNION ALL SELECT segment_id, CAST(floor(a / 3) AS BIGINT), steps + 1 FROM r WHERE a > 0) SELECT segment_id, a AS source_id, CAST(steps AS BIGINT) AS steps FROM r WHERE a = 0",
}

SQL |= review_oracle.SQL
