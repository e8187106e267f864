"""DuckDB SQL for the queries of review_queries.py."""

from __future__ import annotations

_BASE = """t AS (SELECT user_id AS session_id, event_id AS segment_id, event_type, value, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 60.0 AS e FROM events),
base AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s, e, segment_id) - 1 AS i,
  CAST((floor(s) - floor(min(s) OVER (PARTITION BY session_id))) * 48000 AS BIGINT) AS a,
  CAST((floor(e) - floor(min(s) OVER (PARTITION BY session_id))) * 48000 AS BIGINT) + 48000 AS b FROM t)"""

_MERGED = f"""{_BASE},
wanted AS (SELECT session_id, i, i % 3 + 1 AS n FROM base),
met AS (SELECT w.session_id, w.i, w.n, x.i AS j, x.segment_id, x.a, x.b, x.s, x.e, x.value, CASE WHEN x.event_type <> 'view' THEN x.event_type ELSE '' END AS said FROM wanted w JOIN base x ON x.session_id = w.session_id AND x.i BETWEEN w.i AND w.i + w.n - 1),
merged AS (SELECT session_id, i, n, CASE WHEN n = 1 THEN CAST(min(segment_id) AS VARCHAR) ELSE printf('%d__m%05d_%02d', session_id, i, n) END AS segment_id,
  CASE WHEN n = 1 THEN 'base' ELSE 'merged' END AS kind, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS base_indices, min(a) AS a, max(b) AS b, min(s) AS s, max(e) AS e,
  trim(regexp_replace(string_agg(said, ' ' ORDER BY j), ' +', ' ', 'g')) AS transcript, avg(value / 500.0) AS p FROM met GROUP BY session_id, i, n)"""

_LINES = "m(line_index, grp) AS (VALUES (0, 0), (1, 0), (2, 1), (3, 0), (4, 1))"

_HOURS = """t AS (SELECT user_id AS session_id, event_id AS segment_id, event_type, value, epoch_us(ts) / 1e6 / 3600.0 AS s, (epoch_us(ts) / 1e6 + value * 60.0) / 3600.0 AS e FROM events),
words AS (SELECT * FROM t WHERE event_type <> 'error'),
regions AS (SELECT session_id, segment_id AS id, e + 1.0 AS rs, e + 8.0 AS re FROM t WHERE event_type = 'click')"""

_CANDIDATES = "c AS (SELECT l_suppkey AS line_id, l_orderkey * 8 + l_linenumber AS segment_id, l_partkey % 2 AS session_id, l_partkey % 40 AS bi, l_quantity AS score, l_tax AS sel, l_returnflag = 'R' AS manual FROM lineitem)"

_REASON = "CASE l_partkey % 4 WHEN 0 THEN 'EXTRA_LINE_END' WHEN 1 THEN 'AMBIGUOUS_MATCH' WHEN 2 THEN '' ELSE 'MISSING_SENTENCE' END"
_SAID = "CASE WHEN l_partkey % 4 = 0 THEN ' ' WHEN l_partkey % 4 = 1 THEN NULL ELSE l_returnflag END"
_SILENT = f"coalesce(trim(coalesce({_SAID}, '')) <> '' AND -l_quantity <= -40.0 AND greatest(l_discount * 9, l_tax * 10) >= 0.8, false)"

SQL: dict[str, str] = {
    "q35_manual_segments": f"""WITH {_BASE},
        ed AS (SELECT CAST(session_id AS VARCHAR) AS k, a + 28800000 AS a, b + 28800000 AS b, list_distinct(list(i % 7)) AS lines FROM base WHERE event_type = 'purchase' GROUP BY 1, 2, 3),
        hit AS (SELECT ed.k, ed.a, ed.b, string_agg(CAST(x.i AS VARCHAR), ',' ORDER BY x.i) AS idx FROM ed JOIN base x ON CAST(x.session_id AS VARCHAR) = ed.k AND ed.a < x.b AND ed.b > x.a GROUP BY 1, 2, 3)
        SELECT ed.k || '__e' || substr(sha256(ed.k || ':' || ed.a || ':' || ed.b), 1, 12) AS segment_id, 'manual_edit' AS kind, ed.k AS session_id, ed.a AS start_sample, ed.b AS end_sample,
          coalesce(idx, '') AS base_indices, array_to_string(list_sort(lines), ',') AS manual_line_ids FROM ed LEFT JOIN hit USING (k, a, b)""",
    "q36_merged_segments": f"WITH {_MERGED} SELECT CAST(session_id AS VARCHAR) AS session_id, i AS start_index, segment_id, kind, base_indices, a AS start_sample, b AS end_sample, transcript, round(p, 6) AS asr_probability FROM merged",
    "q37_trimmed_segments": f"""WITH {_MERGED},
        c AS (SELECT *, CASE WHEN i % 2 = 0 THEN greatest(a, a + 48000 * (i % 5 - 1)) ELSE a END AS x, CASE WHEN i % 3 = 0 THEN least(b, b - 2880000) ELSE b END AS y FROM merged)
        SELECT CASE WHEN x = a AND y = b THEN segment_id ELSE segment_id || '__t' || x || '_' || y END AS segment_id, CASE WHEN x = a AND y = b THEN kind ELSE 'trimmed' END AS kind,
          x AS start_sample, y AS end_sample, round(CASE WHEN x = a AND y = b THEN s ELSE x / 48000.0 END, 3) AS start_seconds FROM c WHERE y > x""",
    "q38_unmatched_segments": f"""WITH {_BASE}
        SELECT x.session_id, x.segment_id, CASE WHEN x.event_type = 'view' THEN 'TRANSCRIPTION_FAILED_OR_NONVERBAL' WHEN x.value >= 45.0 THEN 'AMBIGUOUS_OR_LOW_CONFIDENCE' ELSE 'NO_RELIABLE_MATCH' END AS reason
        FROM base x WHERE NOT EXISTS (SELECT 1 FROM base y WHERE y.session_id = x.session_id AND y.event_type = 'purchase' AND x.i BETWEEN y.i AND y.i + y.i % 3)""",
    "q39_latest_events": """WITH l AS (SELECT user_id, CAST(floor(value / 100.0) AS BIGINT) AS part, event_id, value, event_type, row_number() OVER (PARTITION BY user_id, floor(value / 100.0) ORDER BY event_id DESC) AS n FROM events)
        SELECT user_id, part, event_id, value FROM l WHERE n = 1 AND event_type <> 'error'""",
    "q40_review_violations": """WITH r AS (SELECT CASE WHEN o_orderkey % 17 <> 0 THEN CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey + 1 ELSE o_orderkey END END AS line_id,
          CASE WHEN o_orderkey % 7 = 0 THEN 'song' WHEN o_orderkey % 5 <> 0 THEN 'normal' ELSE 'nonverbal' END AS type,
          CASE WHEN o_orderkey % 11 = 0 THEN 'DONE' WHEN o_orderkey % 3 = 0 THEN 'RETAKE' WHEN o_orderkey % 13 <> 0 THEN 'AUTO_OK' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS sel FROM orders),
        n AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS many FROM r)
        SELECT line_id, 'MISSING_LINE_ID' AS violation FROM n WHERE line_id IS NULL
        UNION ALL SELECT line_id, 'UNKNOWN_TYPE' FROM n WHERE type = 'song'
        UNION ALL SELECT line_id, 'UNKNOWN_STATUS' FROM n WHERE status IS NULL OR status = 'DONE'
        UNION ALL SELECT line_id, 'RETAKE_WITH_SELECTION' FROM n WHERE status = 'RETAKE' AND sel IS NOT NULL
        UNION ALL SELECT line_id, 'DUPLICATE_LINE_ID' FROM n WHERE many > 1""",
    "q41_pool_after_merge": """WITH m AS (SELECT c_custkey * 2 AS sel, c_custkey % 3 = 0 AS nonverbal, c_custkey % 4 = 0 AS bare FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 10 <> 0),
        kept AS (SELECT o_orderkey AS segment_id, o_orderstatus AS tag FROM orders WHERE o_orderkey NOT IN (SELECT sel FROM m WHERE NOT nonverbal AND NOT bare))
        SELECT * FROM kept UNION ALL SELECT p_partkey * 4, 'old' FROM part WHERE p_partkey * 4 IN (SELECT sel FROM m WHERE nonverbal OR bare) AND p_partkey * 4 NOT IN (SELECT segment_id FROM kept)""",
    "q42_expanded_duplicates": f"""WITH {_BASE}, {_LINES}
        SELECT session_id, i AS start_index, x.line_index::BIGINT AS line_index, y.line_index::BIGINT AS target_index, true AS duplicate_resolved
        FROM base JOIN m x ON x.line_index = segment_id % 5 JOIN m y ON y.grp = x.grp""",
    "q43_one_action_per_span": f"""WITH {_BASE},
        act AS (SELECT session_id, i // 3 AS span, segment_id AS ordinal, segment_id % 5 AS line_index, value AS score FROM base),
        ex AS (SELECT session_id, span, (line_index + 2) % 5 AS line_index, max(score / 5.0) AS score FROM act GROUP BY 1, 2, 3),
        best AS (SELECT session_id, span, line_index AS exact_line, score AS exact_score FROM ex QUALIFY row_number() OVER (PARTITION BY session_id, span ORDER BY score DESC, line_index) = 1),
        r AS (SELECT act.*, CASE WHEN exact_score >= 40.0 THEN exact_line END AS to_line, exact_score FROM act JOIN best USING (session_id, span)),
        k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session_id, span ORDER BY coalesce(line_index = to_line, false) DESC, score DESC, ordinal) = 1)
        SELECT session_id, span, ordinal, CAST(coalesce(to_line, line_index) AS BIGINT) AS line_index, round(CASE WHEN to_line IS NULL THEN score ELSE exact_score END, 6) AS match_score, to_line IS NOT NULL AND to_line <> line_index AS rerouted FROM k""",
    "q44_region_transcripts": f"""WITH {_HOURS},
        said AS (SELECT r.session_id, r.id, trim(string_agg(' ' || w.event_type, '' ORDER BY w.segment_id)) AS said, avg(w.value / 500.0) AS p FROM regions r JOIN words w ON w.session_id = r.session_id AND (w.s + w.e) / 2.0 BETWEEN rs AND re GROUP BY 1, 2),
        half AS (SELECT r.session_id, r.id, string_agg('oops', ' ' ORDER BY g.segment_id) AS lines FROM regions r JOIN t g ON g.session_id = r.session_id AND g.event_type = 'error' AND least(g.e, re) > greatest(g.s, rs) AND (least(g.e, re) - greatest(g.s, rs)) / greatest(0.001, g.e - g.s) >= 0.5 GROUP BY 1, 2)
        SELECT r.session_id, r.id AS region_id, coalesce(said, lines, '') AS transcript, round(p, 6) AS probability FROM regions r LEFT JOIN said USING (session_id, id) LEFT JOIN half USING (session_id, id)""",
    "q45_span_words": f"""WITH {_HOURS},
        met AS (SELECT DISTINCT r.session_id, r.id, w.s, w.e, w.event_type AS word, w.value / 500.0 AS p FROM regions r JOIN words w ON w.session_id = r.session_id AND ((w.s + w.e) / 2.0 BETWEEN rs AND re
          OR (w.s < rs AND rs < w.e AND least(w.e, re) - rs >= 0.2 AND (least(w.e, re) - rs) / greatest(0.001, w.e - w.s) >= 0.2))),
        one AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY session_id, id, round_even(s, 4), round_even(e, 4), word ORDER BY s, e) = 1)
        SELECT session_id, id AS span_id, string_agg(word, ' ' ORDER BY s, e, word) AS transcript, round(avg(p), 6) AS probability FROM one GROUP BY 1, 2""",
    "q46_predicates": f"""SELECT l_orderkey, l_linenumber, {_SILENT} AS silent,
        coalesce(NOT {_SILENT} AND l_quantity / 6.0 <= 6.0 AND (trim(coalesce({_SAID}, '')) = '' OR l_partkey % 5 = 0 OR l_quantity / 50.0 < 0.55 OR l_partkey % 100 < 70), false) AS prompt,
        l_partkey % 6 = 0 OR {_REASON} IN ('EXTRA_LINE_END', 'MISSING_SENTENCE') AS incomplete,
        CASE WHEN l_partkey % 19 = 0 THEN 'EDGE_NON_SPEECH_AUDIO' WHEN l_partkey % 17 = 0 THEN 'FORCED' WHEN l_partkey % 13 = 0 THEN 'SEGMENT_BETTER_MATCH_ELSEWHERE' WHEN l_partkey % 11 = 0 THEN 'EXACT_SPAN_ASR_FAILED' ELSE {_REASON} END AS reason FROM lineitem""",
    "q47_base_keys": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN 's' || o_custkey END AS session_id, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderkey % 1000 END AS base_index FROM orders""",
    "q48_filled_forward": """SELECT event_id AS segment_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events""",
    "q49_proper_subspans": f"""WITH {_BASE} SELECT session_id, i AS start_index, i % 3 + 2 AS count, CAST((i % 3 + 2) * (i % 3 + 3) / 2 - 1 AS BIGINT) AS n FROM base""",
    "q50_without_noise": f"""WITH {_BASE},
        p AS (SELECT x.session_id, x.i, y.i - x.i AS place, y.event_type = 'view' AS removable FROM base x JOIN base y ON y.session_id = x.session_id AND y.i BETWEEN x.i AND x.i + 4 WHERE x.i % 5 = 0),
        whole AS (SELECT session_id, i FROM p GROUP BY 1, 2 HAVING count(*) = 5),
        cut AS (SELECT session_id, i, a, b FROM whole, range(0, 6) u(a), range(0, 6) v(b) WHERE a + b BETWEEN 1 AND 4)
        SELECT session_id, i AS from_index, i + a AS start_index, 5 - a - b AS count FROM cut
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.session_id = cut.session_id AND p.i = cut.i AND NOT removable AND (place < a OR place >= 5 - b))""",
    "q51_edge_extensions": f"""WITH {_BASE},
        act AS (SELECT session_id, i, i % 2 + 1 AS n, segment_id FROM base WHERE event_type = 'purchase')
        SELECT act.session_id, act.i AS from_index, act.i - 1 AS start_index, act.n + 1 AS count, 'start' AS side FROM act JOIN base f ON f.session_id = act.session_id AND f.i = act.i JOIN base p ON p.session_id = act.session_id AND p.i = act.i - 1 WHERE act.segment_id % 2 = 0 AND p.event_type <> 'click' AND f.s - p.e <= 21600
        UNION ALL SELECT act.session_id, act.i, act.i, act.n + 1, 'end' FROM act JOIN base l ON l.session_id = act.session_id AND l.i = act.i + act.n - 1 JOIN base q ON q.session_id = act.session_id AND q.i = act.i + act.n WHERE act.segment_id % 3 = 0 AND q.event_type <> 'click' AND q.s - l.e <= 21600""",
    "q52_unsafe_merges": f"""WITH {_BASE} SELECT x.session_id, x.i AS start_index, bool_or(y.event_type IN ('view', 'error') AND y.value / 10.0 >= 0.5 AND -y.value / 4.0 >= -10.0) AND count(*) > 1 AS unsafe
        FROM base x JOIN base y ON y.session_id = x.session_id AND y.i BETWEEN x.i AND x.i + 2 GROUP BY 1, 2""",
    "q54_isolation": f"""WITH {_BASE},
        g AS (SELECT session_id, i, greatest(0.0, s - lag(e) OVER w) AS before, greatest(0.0, lead(s) OVER w - e) AS after, lag(e) OVER w IS NULL AS first_one, lead(s) OVER w IS NULL AS last_one FROM base WINDOW w AS (PARTITION BY session_id ORDER BY i)),
        m AS (SELECT x.session_id, x.i, max(CASE WHEN y.i = x.i AND NOT y.first_one THEN y.before END) AS lead, max(CASE WHEN y.i = x.i + x.i % 3 AND NOT y.last_one THEN y.after END) AS tail, coalesce(max(CASE WHEN y.i > x.i THEN y.before END), 0.0) AS inn
          FROM base x JOIN g y ON y.session_id = x.session_id AND y.i BETWEEN x.i AND x.i + x.i % 3 GROUP BY 1, 2)
        SELECT session_id, i AS start_index, round(coalesce(lead, greatest(coalesce(lead, 0), coalesce(tail, 0), inn)) + coalesce(tail, greatest(coalesce(lead, 0), coalesce(tail, 0), inn)) - 2.0 * inn, 3) AS isolation FROM m""",
    "q55_exact_takes": f"""WITH {_CANDIDATES},
        p AS (SELECT *, row_number() OVER (PARTITION BY line_id, session_id, bi ORDER BY score DESC, sel DESC, manual, segment_id) AS place, min(segment_id) OVER (PARTITION BY line_id, session_id, bi) AS f FROM c)
        SELECT line_id, segment_id, dense_rank() OVER (PARTITION BY line_id ORDER BY f) AS group, place FROM p""".replace(" AS group,", ' AS "group",'),
    "q56_listed_lines": """SELECT c_custkey AS index, c_mktsegment AS sheet FROM customer WHERE c_acctbal > 0 ORDER BY c_mktsegment DESC, c_nationkey % 5 DESC, c_custkey LIMIT 20""",
    "q57_marked_lines": """WITH l AS (SELECT event_id, CAST(user_id AS BIGINT) AS line_id, event_type = 'error' AND event_id % 3 = 0 AS retake, CASE WHEN NOT (event_type = 'error' AND event_id % 3 = 0) THEN CAST(floor(value / 200.0) AS BIGINT) END AS seg FROM events
          UNION ALL SELECT -1, c_custkey, false, 0 FROM customer WHERE c_custkey % 2 = 0),
        n AS (SELECT *, CASE WHEN retake = lag(retake) OVER w AND seg IS NOT DISTINCT FROM lag(seg) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY line_id ORDER BY event_id)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY line_id ORDER BY event_id) AS run FROM n),
        k AS (SELECT line_id, run, count(*) AS many, max(event_id) AS last_event, bool_or(retake) AS retake, max(seg) AS seg FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY run DESC) = 1)
        SELECT CAST(c_custkey AS BIGINT) AS line_id, CASE WHEN coalesce(last_event, -1) < 0 THEN 'AUTO_OK' WHEN retake THEN 'RETAKE' WHEN many % 2 = 1 THEN 'MANUALLY_REVIEWED' WHEN c_custkey % 4 <> 0 AND c_custkey % 3 = 0 THEN 'MISSING' ELSE 'REVIEW' END AS status,
          CASE WHEN coalesce(last_event, -1) < 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 0 END WHEN NOT retake AND many % 2 = 1 THEN seg END::BIGINT AS selected_segment_id FROM customer LEFT JOIN k ON k.line_id = c_custkey""",
}
