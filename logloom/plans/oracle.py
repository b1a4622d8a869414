"""The queries of this folder in DuckDB SQL, written from their definitions and not from the plans."""

from __future__ import annotations

from .derive import LOGS, STATEMENTS

_L = f"WITH l AS (SELECT *, substring(sha256(concat('log', chr(31), dataset_id, chr(31), source_file, chr(31), cast(sequence + 1 AS varchar))), 1, 32) AS log_id FROM ({LOGS}))"
_MS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"

_J = f"""{_L}, j AS (SELECT *, CASE WHEN truth_state = 'known' THEN truth END AS truth_key, truth_state <> 'unknown' AS known, truth_state = 'known' AS evaluable, status <> 'unmatched' AS covered,
  truth_state = 'known' AND status <> 'unmatched' AND truth = predicted AS at1,
  truth_state = 'known' AND (truth = predicted OR truth = concat('s', cast((cast(substring(predicted, 2) AS bigint) + 1) % 7 AS varchar))) AS at3,
  CASE WHEN status <> 'unmatched' THEN predicted ELSE '' END AS shown FROM l)"""

_LEVEL = "CASE WHEN u IN ('TRACE','DEBUG','INFO','WARN','ERROR','FATAL') THEN u WHEN u = 'FINEST' THEN 'TRACE' WHEN u IN ('FINER','FINE') THEN 'DEBUG' WHEN u = 'CONFIG' THEN 'INFO' WHEN u = 'WARNING' THEN 'WARN' WHEN u = 'SEVERE' THEN 'ERROR' ELSE 'UNKNOWN' END"

_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '\\p{Nd}+')))"

_TEXT_LINES = "WITH r AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS y FROM documents), t AS (SELECT doc_id, y, CASE WHEN y[-1] = '' THEN y[1:len(y) - 1] ELSE y END AS x FROM r)"


def _orders(*, nulls: str = "") -> str:
    return f"ts{nulls}, sequence, log_id"


ORACLE_SQL = {
    "event_assembly": f"""{_L}, n AS (SELECT *, CASE WHEN service = 'error' THEN 6 ELSE 1 END AS c FROM l), p AS (SELECT *, cast(sum(c) OVER (PARTITION BY source_file ORDER BY event_id) - c + 1 AS int) AS ln FROM n)
      SELECT source_file, ln AS line_number, cast(c AS int) AS line_count, sequence, {_MS} AS ts, level, '1' AS pid, thread, concat('com.shop.', service) AS logger_raw, message,
      CASE WHEN c > 1 THEN 'java.lang.IllegalStateException' END AS exception_class, CASE WHEN c > 1 THEN 'java.io.IOException' END AS root_class, CASE WHEN c > 1 THEN 2 ELSE 0 END AS frames, CASE WHEN c > 1 THEN 50 END AS first_frame_line,
      substring(sha256(concat('log', chr(31), dataset_id, chr(31), source_file, chr(31), cast(ln AS varchar))), 1, 32) AS log_id FROM p""",
    "logback_lines": f"{_L} SELECT event_id, {_MS} AS ts, level, thread, concat('com.shop.', service) AS logger_raw, message FROM l",
    "json_log_lines": f"{_L} SELECT event_id, {_MS} AS ts, level, service AS logger_raw, concat(message, chr(10), thread) AS message FROM l",
    "match_logs": f"""WITH l AS ({LOGS}), s AS ({STATEMENTS}), r AS (SELECT l.event_id, s.statement_id, s.class_fqn, s.template_kind,
        CASE s.statement_id WHEN 's-click' THEN '^Clicked item (.*)$' WHEN 's-open' THEN '^Opened page (.*)$' WHEN 's-order' THEN '^Order (.*) placed$' WHEN 's-order2' THEN '^Order (.*)$' WHEN 's-fail' THEN '^Request failed for user (.*)$' WHEN 's-any' THEN '^(.*)$' ELSE '^Account (.*) created$' END AS full_,
        length(replace(replace(s.template, '{{}}', ''), ' ', '')) AS len, l.message FROM l JOIN s USING (service)),
      f AS (SELECT *, regexp_matches(message, full_) AS f FROM r),
      p AS (SELECT *, CASE WHEN template_kind = 'dynamic' THEN 0.35 ELSE (CASE WHEN f THEN 0.45 ELSE 0.20 END) + 0.2 * len / (len + 15) + 0.35 END AS score FROM f WHERE f OR starts_with(message, split_part(replace(replace(full_, '^', ''), '$', ''), '(.*)', 1))),
      o AS (SELECT *, round(score, 9) AS sc, row_number() OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, statement_id) AS n, lead(round(score, 9)) OVER (PARTITION BY event_id ORDER BY round(score, 9) DESC, statement_id) AS second, count(*) OVER (PARTITION BY event_id) AS c FROM p),
      d AS (SELECT *, CASE WHEN round(sc - second, 9) < 0.05 THEN 'ambiguous' ELSE 'matched' END AS status FROM o WHERE n = 1)
      SELECT event_id, status, statement_id, round(CASE WHEN status = 'ambiguous' THEN round(sc * 0.6, 9) ELSE sc END, 6) AS confidence,
      CASE WHEN (CASE WHEN status = 'ambiguous' THEN sc * 0.6 ELSE sc END) >= 0.75 THEN 'high' WHEN (CASE WHEN status = 'ambiguous' THEN sc * 0.6 ELSE sc END) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_level,
      regexp_extract(message, CASE WHEN f THEN full_ ELSE replace(full_, '$', '') END, 1) AS args, cast(c AS int) AS candidates, class_fqn AS logger FROM d""",
    "log_statistics": f"""{_L} SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM l UNION ALL SELECT 'status', status, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM l GROUP BY 2
      UNION ALL SELECT 'service', service, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'level', level, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'with_exception', NULL, count(*) FILTER (service = 'error' AND event_id % 9 > 0) FROM l UNION ALL SELECT 'with_trace', NULL, count(*) FROM l""",
    "ingest_report": f"""{_L}, n AS (SELECT 'total' AS dimension, NULL AS value, count(*) AS n FROM l UNION ALL SELECT 'status', status, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM l WHERE confidence IS NOT NULL GROUP BY 2 UNION ALL SELECT 'service', service, count(*) FROM l GROUP BY 2
        UNION ALL SELECT 'level', level, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'with_exception', NULL, count(*) FROM l WHERE service = 'error' UNION ALL SELECT 'with_trace', NULL, count(*) FROM l UNION ALL SELECT 'events_per_second', NULL, count(*) / 2.0 FROM l)
      SELECT dimension, value, cast(n AS double) AS n FROM n""",
    "log_page": f"{_L} SELECT event_id, log_id, sequence, level FROM l WHERE service IN ('error', 'signup') AND ts >= TIMESTAMP '2024-01-02' AND contains(lower(message), 'failed') AND NOT contains(lower(message), 'created') ORDER BY ts DESC, sequence DESC, log_id DESC LIMIT 50 OFFSET 50",
    "log_adjacent": f"{_L} SELECT log_id, lag(log_id) OVER w AS previous_id, lead(log_id) OVER w AS next_id FROM l WINDOW w AS (PARTITION BY dataset_id, source_file ORDER BY sequence)",
    "log_neighbours": f"{_L}, n AS (SELECT *, row_number() OVER (PARTITION BY service, thread ORDER BY {_orders()}) AS r FROM l) SELECT a.log_id AS anchor_id, cast(b.r - a.r AS int) AS \"offset\", b.log_id FROM n a JOIN n b ON a.service = b.service AND a.thread = b.thread AND b.r BETWEEN a.r - 2 AND a.r + 2 AND a.r <> b.r",
    "log_trace_places": f"{_L}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY {_orders()}) AS r, min(log_id) OVER (PARTITION BY trace_id) AS a FROM l) SELECT a AS anchor_id, cast(r AS int) AS place, log_id FROM n WHERE r <= 200",
    "candidate_details": f"""{_L}, c AS (SELECT log_id, 0 AS place, predicted AS s, 0.9 AS score FROM l UNION ALL SELECT log_id, 1, concat('s', cast((cast(substring(predicted, 2) AS bigint) + 1) % 7 AS varchar)), 0.7 FROM l)
      SELECT log_id, cast(place AS int) AS place, s AS statement_id, cast(score AS double) AS score, CASE WHEN substring(s, 2) < '5' THEN concat('c', substring(s, 2)) END AS class_fqn, CASE WHEN substring(s, 2) < '5' THEN cast(substring(s, 2) AS int) * 10 END AS line FROM c""",
    "level_normalise": f"""WITH o AS (SELECT o_orderkey, upper(trim(CASE o_orderkey % 9 WHEN 0 THEN 'finest' WHEN 1 THEN ' Fine ' WHEN 2 THEN 'FINER' WHEN 3 THEN 'config' WHEN 4 THEN 'Warning' WHEN 5 THEN 'SEVERE' WHEN 6 THEN 'error' WHEN 7 THEN 'notice' END)) AS u FROM orders)
      SELECT o_orderkey, {_LEVEL} AS level, ({_LEVEL}) IN ('ERROR', 'FATAL') AS like_fatal FROM o""",
    "token_sets": f"SELECT doc_id, len({_TOKENS}) AS n, md5(array_to_string(list_sort({_TOKENS}), ' ')) AS digest FROM documents",
    "token_idf": f"WITH t AS (SELECT source AS service, unnest({_TOKENS}) AS token FROM documents), n AS (SELECT source AS service, count(*) AS n FROM documents GROUP BY 1) SELECT service, token, count(*) AS df, round(ln(any_value(n) / count(*)), 9) AS idf FROM t JOIN n USING (service) GROUP BY 1, 2",
    "stable_ids": "SELECT l_orderkey, l_linenumber, substring(sha256(concat('log', chr(31), l_returnflag, chr(31), coalesce(nullif(l_linestatus, 'O'), ''), chr(31), cast(l_orderkey AS varchar), chr(31), cast(l_linenumber AS varchar))), 1, 32) AS id FROM lineitem",
    "snippets": "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) SELECT doc_id, CASE WHEN len(x) >= 3 THEN md5(array_to_string(x[1:5], chr(10))) END AS around_three, CASE WHEN len(x) >= 2 THEN concat('   2 | ', x[2]) END AS second FROM d",
    "one_line_texts": "WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) > 40 THEN concat(rtrim(substring(t, 1, 39)), '…') ELSE t END AS line FROM c",
    "source_links": "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN 'https://example.org/r/blob/v' || p_size || '/src/' || p_brand || '#L' || p_size || CASE WHEN p_size % 2 = 0 THEN '' ELSE '-L' || (p_size + 3) END END AS link FROM part",
    "logger_resolution": """WITH n AS (SELECT r_name AS service, concat('com.', lower(replace(n_name, ' ', '')), '.svc.', 'Handler', cast(n_nationkey % 3 AS varchar)) AS name FROM nation JOIN region ON n_regionkey = r_regionkey),
      r AS (SELECT DISTINCT service, unnest([name, regexp_replace(name, '^com\\.(.)[^.]*\\.svc', 'c.\\1.s'), substring(name, length(name) - 12, 13), 'other.Thing']) AS raw FROM n),
      c AS (SELECT r.service, raw, name, string_split(raw, '.') AS a, string_split(name, '.') AS b FROM r JOIN n ON r.service = n.service),
      k AS (SELECT service, raw, name, CASE WHEN raw = name THEN 1 WHEN len(a) = len(b) AND a[-1] = b[-1] AND len(list_filter(range(1, len(a)), lambda i: a[i] = '' OR NOT starts_with(b[i], a[i]))) = 0 THEN 2
        WHEN length(raw) >= 10 AND (ends_with(name, raw) OR ends_with(concat(left(b[1], 1), '.', left(b[2], 1), '.', left(b[3], 1), '.', b[4]), raw)) THEN 3 END AS rk FROM c),
      m AS (SELECT service, raw, min(rk) AS rk FROM k GROUP BY 1, 2), f AS (SELECT m.service, m.raw, m.rk, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (k.rk = m.rk) AS names, count(DISTINCT name) FILTER (k.rk = m.rk) AS c FROM m JOIN k ON m.service = k.service AND m.raw = k.raw GROUP BY 1, 2, 3)
      SELECT service, raw AS logger_raw, CASE WHEN rk = 1 THEN 'EXACT' WHEN rk = 2 AND c = 1 THEN 'ABBREV_UNIQUE' WHEN rk = 2 THEN 'ABBREV_MULTI' WHEN rk = 3 THEN 'TRUNCATED' ELSE 'UNKNOWN' END AS kind, coalesce(names, '') AS names FROM f""",
    "eval_metrics": f"""{_J}, m AS (SELECT count(*) AS total, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unmatched') AS unmatched, count(*) FILTER (evaluable) AS evaluable,
        count(*) FILTER (truth_state = 'not_in_catalog') AS not_in_catalog, count(*) FILTER (known) AS with_truth, count(*) FILTER (covered) AS covered, count(*) FILTER (known AND covered) AS covered_with_truth, count(*) FILTER (evaluable AND covered) AS evaluable_covered,
        count(*) FILTER (at1) AS at1, count(*) FILTER (at3) AS at3, count(*) FILTER (at3 AND covered) AS at3_covered, count(*) FILTER (evaluable AND status = 'ambiguous') AS evaluable_ambiguous, count(*) FILTER (truth_state = 'not_in_catalog' AND covered) AS false_matches FROM j)
      SELECT *, round(covered / total, 9) AS coverage, round(covered_with_truth / with_truth, 9) AS coverage_with_truth, round(at1 / evaluable, 9) AS acc_at1, round(at3 / evaluable, 9) AS acc_at3, round(at3_covered / evaluable_covered, 9) AS acc_at3_covered, round(at1 / evaluable_covered, 9) AS precision_covered,
      round(ambiguous / total, 9) AS ambiguous_share, round(evaluable_ambiguous / evaluable, 9) AS ambiguous_evaluable, round(not_in_catalog / with_truth, 9) AS not_in_catalog_share, round(false_matches / not_in_catalog, 9) AS false_match_rate FROM m""",
    "eval_per_level": f"{_J} SELECT v.c AS confidence_level, count(j.event_id) AS events, count(*) FILTER (evaluable) AS evaluable, count(*) FILTER (at1) AS at1, round(count(*) FILTER (at1) / nullif(count(*) FILTER (evaluable), 0), 9) AS precision FROM (VALUES ('high'), ('medium'), ('low')) v(c) LEFT JOIN j ON j.confidence = v.c AND covered GROUP BY 1",
    "eval_breakdown": _J + " " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce({d}, 'unknown') AS value, count(*) AS events, count(*) FILTER (evaluable) AS evaluable, count(*) FILTER (at1) AS at1, count(DISTINCT truth_key) AS statements, count(DISTINCT truth_key) FILTER (at1) AS hit FROM j GROUP BY 2" for d in ("service", "level", "confidence")),
    "eval_top_threads": f"{_J}, c AS (SELECT thread, row_number() OVER (ORDER BY count(*) DESC, thread) AS r FROM j GROUP BY 1) SELECT CASE WHEN r <= 15 THEN j.thread ELSE '(other threads)' END AS value, count(*) AS events, count(DISTINCT truth_key) AS statements FROM j JOIN c USING (thread) GROUP BY 1",
    "eval_statements": f"""{_J}, p AS (SELECT truth_key, shown, count(*) AS n FROM j WHERE evaluable GROUP BY 1, 2), b AS (SELECT truth_key, arg_min(shown, {{'a': -n, 'b': shown}}) AS most_predicted FROM p GROUP BY 1)
      SELECT truth_key, count(*) AS events, count(*) FILTER (at1) AS at1, count(*) FILTER (at3) AS at3, count(*) FILTER (covered) AS covered, any_value(most_predicted) AS most_predicted FROM j JOIN b USING (truth_key) WHERE evaluable GROUP BY 1""",
    "eval_unique_statements": f"{_J}, s AS (SELECT truth_key, count(*) AS e, count(*) FILTER (at1) AS a, count(*) FILTER (at3) AS b FROM j WHERE evaluable GROUP BY 1) SELECT count(*) AS statements, round(count(*) FILTER (a > 0) / count(*), 9) AS hit_rate, round(avg(a / e), 9) AS macro_at1, round(avg(b / e), 9) AS macro_at3, round(max(e) / sum(e), 9) AS top_share FROM s",
    "eval_error_kinds": f"{_J} SELECT shown AS predicted, truth_key, count(*) AS n, arg_min(log_id, {{'a': source_file, 'b': sequence}}) AS log_id FROM j WHERE evaluable AND NOT at1 GROUP BY 1, 2",
    "ground_truth_places": """WITH l AS (SELECT DISTINCT concat(cast(l_orderkey AS varchar), '-', cast(l_linenumber AS varchar), '-', cast(l_partkey AS varchar), '-', cast(l_suppkey AS varchar), '-', cast(cast(floor(l_quantity) AS int) AS varchar)) AS log_id, l_suppkey % 5 AS s, l_partkey // 20 AS c, cast(floor(l_quantity) AS int) AS line FROM lineitem),
      p AS (SELECT p_partkey % 5 AS s, p_partkey // 20 AS c, cast(p_partkey AS varchar) AS id, p_size AS a, p_size + 9 AS b FROM part)
      SELECT log_id, CASE WHEN count(id) = 0 THEN 'not_in_catalog' ELSE 'known' END AS state, coalesce(string_agg(DISTINCT id, '+' ORDER BY id), '') AS truth_key FROM l LEFT JOIN p ON l.s = p.s AND l.c = p.c AND line BETWEEN a AND b GROUP BY log_id""",
    "labels_latest": """WITH l AS (SELECT concat('d', cast(doc_id % 97 AS varchar)) AS log_id, 'ev' AS dataset_id, CASE WHEN doc_id % 10 = 9 THEN NULL WHEN toxic = 1 THEN 'not_in_catalog' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict, doc_id AS labeled_at FROM labels)
      SELECT log_id, labeled_at, dataset_id, verdict FROM l QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY labeled_at DESC) = 1 AND verdict IS NOT NULL""",
    "review_candidates": f"""{_L}, v AS (SELECT doc_id % 97 AS k, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE 1 END AS verdict FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id DESC) = 1)
      SELECT concat('d', cast(event_id AS varchar)) AS log_id, status, confidence FROM l WHERE (event_id % 5 = 0 OR status = 'ambiguous' OR confidence = 'low') AND event_id NOT IN (SELECT k FROM v WHERE verdict IS NOT NULL)""",
    "class_ancestors": """WITH RECURSIVE u(c, a, d) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT c, a // 2, d + 1 FROM u WHERE a // 2 > 0 AND d < 20 AND a IN (SELECT p_partkey FROM part))
      SELECT cast(c AS varchar) AS class_fqn, cast(a AS varchar) AS ancestor, d AS depth FROM u""",
    "method_reverse_edges": """WITH e AS (SELECT DISTINCT cast(o_custkey AS varchar) AS c, cast(o_custkey % 50 AS varchar) AS t, cast(o_orderkey % 100 AS int) AS line FROM orders)
      SELECT t AS method_id, count(*) AS caller_count, arg_min(c, {'a': c, 'b': line}) AS first_caller, arg_min(line, {'a': c, 'b': line}) AS first_line FROM e GROUP BY 1""",
    "method_callers": """WITH e AS (SELECT DISTINCT cast(o_custkey % 50 AS varchar) AS t, cast(o_custkey AS varchar) AS c FROM orders), s AS (SELECT DISTINCT t AS root FROM e),
      a AS (SELECT root, c, row_number() OVER (PARTITION BY root ORDER BY c) AS r FROM s JOIN e ON t = root WHERE c <> root), a1 AS (SELECT root, c FROM a WHERE r <= 5),
      b AS (SELECT DISTINCT a1.root, e.c FROM a1 JOIN e ON e.t = a1.c WHERE e.c <> a1.root AND NOT EXISTS (SELECT 1 FROM a1 x WHERE x.root = a1.root AND x.c = e.c)),
      b1 AS (SELECT root, c, row_number() OVER (PARTITION BY root ORDER BY c) AS r FROM b), u AS (SELECT root, c, 1 AS level FROM a1 UNION ALL SELECT root, c, 2 FROM b1 WHERE r <= 5)
      SELECT root, c AS caller_id, level FROM u QUALIFY row_number() OVER (PARTITION BY root ORDER BY level, c) <= 12""",
    "interface_implementors": "WITH s AS (SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT n_name AS interface, s_name AS class_fqn FROM s UNION SELECT concat('R ', r_name), s_name FROM s",
    "dependency_rollup": "SELECT coalesce(p_brand, 'TOTAL') AS artifact, count(*) AS statements, count(*) FILTER (p_size > 25) AS supported, cast(grouping(p_brand) AS int) AS total FROM part GROUP BY ROLLUP (p_brand)",
    "eval_score": f"""{_J}, d AS (SELECT truth_key FROM j WHERE evaluable GROUP BY 1 ORDER BY count(*) DESC, truth_key LIMIT 2),
      k AS (SELECT *, evaluable AND truth_key NOT IN (SELECT truth_key FROM d) AS control, evaluable AND covered AND NOT at1 AND event_id % 4 = 0 AND truth = concat('s', cast((cast(substring(predicted, 2) AS bigint) + 1) % 7 AS varchar)) AS tied FROM j),
      s AS (SELECT truth_key, count(*) AS e, count(*) FILTER (at1) AS a FROM j WHERE evaluable GROUP BY 1),
      t AS (SELECT count(*) AS statements, count(*) FILTER (a > 0) AS statements_hit, round(coalesce(avg(a / e), 0), 9) AS macro_at1 FROM s),
      m AS (SELECT count(*) AS events, count(*) FILTER (evaluable) AS evaluable, count(*) FILTER (covered) AS covered, count(*) FILTER (at1) AS at1, count(*) FILTER (at3) AS at3, count(*) FILTER (status = 'ambiguous') AS ambiguous,
        {", ".join(f"count(*) FILTER (evaluable AND covered AND confidence = '{x}') AS {x}_covered, count(*) FILTER (at1 AND confidence = '{x}') AS {x}_at1" for x in ("high", "medium", "low"))},
        count(*) FILTER (truth_state = 'not_in_catalog') AS not_in_catalog, count(*) FILTER (truth_state = 'not_in_catalog' AND covered) AS false_links, count(*) FILTER (tied) AS tied_errors, count(*) FILTER (evaluable AND NOT covered) AS unmatched_errors,
        count(*) FILTER (control) AS control_evaluable, count(*) FILTER (control AND at1) AS control_at1, count(*) FILTER (control AND tied) AS control_tied_errors FROM k)
      SELECT m.*, t.*, round(covered / events, 9) AS coverage, round(ambiguous / events, 9) AS ambiguous_share, round(at1 / nullif(evaluable, 0), 9) AS acc_at1, round(at3 / nullif(evaluable, 0), 9) AS acc_at3, round(high_at1 / nullif(high_covered, 0), 9) AS precision_high, round(medium_at1 / nullif(medium_covered, 0), 9) AS precision_medium,
        round(low_at1 / nullif(low_covered, 0), 9) AS precision_low, round(control_at1 / nullif(control_evaluable, 0), 9) AS control_acc_at1, round(false_links / nullif(not_in_catalog, 0), 9) AS false_link_share, round(statements_hit / nullif(statements, 0), 9) AS statement_hit_rate, evaluable - at1 AS errors, control_evaluable - control_at1 AS control_errors FROM m, t""",
    "eval_report_rows": f"{_J} SELECT v.c AS confidence_level, cast(count(j.event_id) AS varchar) AS events, cast(count(*) FILTER (evaluable) AS varchar) AS evaluable, cast(count(*) FILTER (at1) AS varchar) AS at1, coalesce(format('{{:.4f}}', count(*) FILTER (at1) / nullif(count(*) FILTER (evaluable), 0)), '') AS precision FROM (VALUES ('high'), ('medium'), ('low')) v(c) LEFT JOIN j ON j.confidence = v.c AND covered GROUP BY 1",
    "logger_coverage": """WITH r AS (SELECT concat(c_mktsegment, cast(c_nationkey AS varchar)) AS logger, CASE WHEN c_custkey % 50 = 0 THEN 'mapped' WHEN c_nationkey % 4 = 0 THEN 'excluded' ELSE 'unmapped' END AS state FROM customer),
      o AS (SELECT logger, bool_or(state = 'mapped') AS m, bool_or(state = 'excluded') AS e, bool_or(state = 'unmapped') AS u FROM r GROUP BY 1),
      n AS (SELECT count(*) AS loggers, count(*) FILTER (e AND NOT m) AS excluded, count(*) FILTER (m) AS mapped, count(*) FILTER (u AND NOT m) AS unmapped FROM o)
      SELECT *, loggers - excluded AS eligible, CASE WHEN loggers = excluded THEN 100.0::double ELSE round(100.0::double * mapped / (loggers - excluded), 9) END AS percent FROM n""",
    "call_site_edges": """WITH e AS (SELECT o_custkey AS c, o_orderkey % 5 AS l, o_orderpriority AS p, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3)
      SELECT o_orderkey AS statement_id, o_custkey AS method_id, cast(o_orderkey % 5 AS int) AS line, o_orderpriority AS text, CASE WHEN k % 3 > 0 THEN concat('m', cast(k AS varchar)) END AS target_method_id, coalesce(k % 3 > 0, false) AS resolved
      FROM orders LEFT JOIN e ON o_custkey = c AND o_orderkey % 5 = l AND o_orderpriority = p""",
    "focus_windows": f"""{_TEXT_LINES}, w AS (SELECT doc_id, x, least(40, len(x)) AS e FROM t), v AS (SELECT *, CASE WHEN e - 1 <= 6 THEN e ELSE least(e, 5) END AS h FROM w)
      SELECT doc_id, CASE WHEN e >= 2 THEN 2 END AS first, CASE WHEN e >= 2 THEN md5(array_to_string(x[2:h], chr(10))) END AS digest, CASE WHEN e >= 2 THEN false END AS cut_before, CASE WHEN e >= 2 THEN h < e END AS cut_after FROM v""",
    "stack_trace_texts": f"""{_TEXT_LINES}, f AS (SELECT doc_id, x, list_max(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN regexp_matches(x[i], '[^\\s\\x0B]') THEN i END)) AS last,
        coalesce(list_min(list_transform(range(2, len(x) + 1), lambda i: CASE WHEN starts_with(x[i], substring(y[3], 1, 5)) THEN i END)), 2) AS first FROM t)
      SELECT doc_id, CASE WHEN last - first + 1 > 4 THEN md5(concat(array_to_string(x[first:first + 3], chr(10)), chr(10), '… (još ', cast(last - first - 3 AS varchar), ' linija)')) WHEN last >= first THEN md5(array_to_string(x[first:last], chr(10))) END AS digest FROM f""",
    "clock_offsets": f"{_L} SELECT event_id, cast(CASE event_id % 6 WHEN 1 THEN 7200 WHEN 2 THEN -12600 WHEN 3 THEN -12600 ELSE 0 END AS int) AS seconds FROM l",
    "datasets": f"{_L} SELECT dataset_id, service, count(*) AS logs, cast(min(ts) AS varchar) AS first, cast(max(sequence) + 1 AS int) AS lines FROM l GROUP BY 1, 2",
}
