"""The queries of more.py in DuckDB SQL, written from their definitions and not from the plans."""

from __future__ import annotations

from .oracle import _J, _L, _MS

_T = "regexp_extract_all(lower(concat(message, ' (no-', cast(event_id AS varchar), ') user_id')), '[\\p{L}\\p{N}_]+')"
_RUNS = """r AS (SELECT cast(o_orderkey AS varchar) AS run_id, o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'dependency' ELSE 'project' END AS kind, concat('g:a', cast(o_custkey % 40 AS varchar)) AS name, cast(o_custkey % 3 AS varchar) AS version, cast(o_orderdate AS varchar) AS started_at FROM orders),
  z AS (SELECT * FROM r WHERE kind = 'project' QUALIFY row_number() OVER (PARTITION BY name, version ORDER BY started_at DESC, run_id DESC) = 1)"""
_NEXT = "concat('s', cast((cast(substring(predicted, 2) AS bigint) + 1) % 7 AS varchar))"

ORACLE_SQL = {
    "log_text_search": f"""{_L}, t AS (SELECT event_id, {_T} AS t, concat(' ', array_to_string({_T}, ' '), ' ') AS s FROM l)
      SELECT 'hyphen' AS query, event_id FROM t WHERE list_has_any(t, ['x', '17']) UNION ALL SELECT 'group', event_id FROM t WHERE list_has_any(t, ['failed', 'clicked']) AND list_contains(t, 'item')
      UNION ALL SELECT 'negated', event_id FROM t WHERE list_contains(t, 'failed') OR NOT list_contains(t, 'clicked') UNION ALL SELECT 'prefix', event_id FROM t WHERE s LIKE '% acc%' AND list_contains(t, 'twice')
      UNION ALL SELECT 'phrase', event_id FROM t WHERE s LIKE '% order 1 %' OR s LIKE '% created twice %' UNION ALL SELECT 'joined', event_id FROM t WHERE list_contains(t, 'user_id') AND NOT list_contains(t, 'user') AND list_contains(t, 'placed')""",
    "log_exceptions": f"{_L} SELECT service = 'error' AND event_id % 9 > 0 AS has_exception, event_id FROM l WHERE service IN ('error', 'view') AND trace_id = 't7'",
    "log_page_end": f"{_L}, e AS (SELECT log_id, row_number() OVER (ORDER BY ts, sequence, log_id) AS r, count(*) OVER () AS n FROM l WHERE level = 'ERROR') SELECT n AS total, log_id AS last_id FROM e WHERE r = least(20, n)",
    "log_summaries": f"{_L} SELECT log_id, {_MS} AS ts, service, level, thread, md5(substring(repeat(message, 40), 1, 500)) AS digest, status, 0.5::double AS confidence, service = 'error' AS has_exception, service AS class_fqn, 3 AS line FROM l",
    "method_callers_known": """WITH e AS (SELECT DISTINCT cast(o_custkey AS varchar) AS c, cast(o_custkey % 50 AS varchar) AS t, cast(o_orderkey % 100 % 2 AS int) AS line FROM orders WHERE o_custkey <> o_custkey % 50), n AS (SELECT t, count(*) AS k FROM e GROUP BY 1)
      SELECT e.t AS method_id, cast(row_number() OVER (PARTITION BY e.t ORDER BY c, line) - 1 AS int) AS place, c AS caller_id, line, concat('c', c) AS class_fqn, 0 AS annotations, coalesce(n.k, 0) AS caller_count FROM e LEFT JOIN n ON n.t = e.c""",
    "source_lookup": "SELECT DISTINCT p_brand AS code_unit, cast(p_size AS varchar) AS version, p_name AS path, substring(sha256(concat('file', chr(31), p_brand, chr(31), cast(p_size AS varchar), chr(31), p_name)), 1, 32) AS file_id FROM part WHERE p_partkey % 3 = 0",
    "folded_frames": """WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS own, row_number() OVER w - 1 AS i, coalesce(lag(l_returnflag = 'R') OVER w, true) AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R')),
      g AS (SELECT *, sum(CASE WHEN own OR before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS g FROM f), m AS (SELECT l_orderkey, min(i) AS a, max(i) + 1 AS b FROM g GROUP BY l_orderkey, g),
      s AS (SELECT l_orderkey, string_agg(concat(CASE WHEN b - a >= 2 THEN 'folded' ELSE 'frame' END, ':', cast(a AS varchar), '-', cast(b AS varchar)), ' ' ORDER BY a) AS items FROM m GROUP BY 1)
      SELECT l_orderkey, items, concat('C.m(C.java:', cast(l_linenumber AS varchar), ')') AS first FROM s JOIN f USING (l_orderkey) WHERE i = 0""",
    "score_breakdowns": "SELECT p_partkey, concat('regex_full +', format('{:.2f}', p_size / 100.0), '|logger_conflict −', format('{:.2f}', p_size / 200.0), '|level_equal +0.10|aside +0.50|odd 0.00') AS rows FROM part WHERE p_size % 2 = 0",
    "time_offsets": f"""{_L}, m AS (SELECT event_id, cast(event_id % 3 * event_id * 40 AS bigint) AS ms FROM l)
      SELECT event_id, CASE WHEN ms < 1000 THEN concat('+', cast(ms AS varchar), ' ms') WHEN ms < 60000 THEN concat('+', format('{{:.3f}}', ms / 1000.0), ' s') ELSE concat('+', cast(ms // 60000 AS varchar), ' min ', format('{{:.1f}}', ms % 60000 / 1000.0), ' s') END AS "offset" FROM m""",
    "filter_mismatches": f"""{_L} SELECT event_id, concat_ws(',', CASE WHEN service NOT IN ('error', 'view') THEN 'service' END, CASE WHEN level <> 'ERROR' THEN 'level' END, CASE WHEN status <> 'matched' THEN 'status' END, CASE WHEN confidence IS NULL OR confidence = 'low' THEN 'confidence' END,
        CASE WHEN NOT ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20' THEN 'time' END, CASE WHEN trace_id <> 't7' THEN 'trace' END, CASE WHEN service <> 'error' THEN 'exceptions' END) AS filters FROM l""",
    "events_at_lines": f"{_L} SELECT a.source_file, cast(a.sequence AS int) AS line, b.event_id FROM l a JOIN l b ON a.source_file = b.source_file AND b.sequence = a.sequence // 4 WHERE a.sequence % 4 < 3",
    "explained_links": f"""{_L} SELECT log_id, concat(status, CASE WHEN status <> 'unmatched' THEN concat(' ', predicted, chr(10), '  regex_full +0.45', chr(10), '  level_equal +0.10') ELSE '' END, chr(10), '  ', predicted, ' 0.90', chr(10), '  ', {_NEXT}, ' 0.70') AS text FROM l""",
    "services_known": f"{_L} SELECT DISTINCT service FROM l",
    "dataset_counts": f"{_L} SELECT concat('d', cast(event_id % 4 AS varchar)) AS dataset_id, count(*) AS logs FROM l GROUP BY 1",
    "status_dashboard": f"{_L} SELECT service, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unmatched') AS unmatched FROM l GROUP BY 1 ORDER BY count(*) DESC, service LIMIT 3",
    "term_counts": f"{_L} SELECT count(*) AS n FROM l WHERE service = 'error' AND status = 'matched'",
    "latest_runs": f"WITH {_RUNS} SELECT run_id, name, version, started_at FROM z",
    "code_units": f"WITH {_RUNS} SELECT kind, name, version, max(started_at) AS finished_at FROM r GROUP BY 1, 2, 3 ORDER BY 2, 3 LIMIT 500",
    "run_catalogs": f"""WITH {_RUNS}, u AS (SELECT run_id, name, version FROM z UNION SELECT run_id, concat('g:d', cast(k % 5 AS varchar)), '1:x' FROM z UNION SELECT run_id, 'g:e', '2' FROM z),
      p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN concat('g:a', cast(p_size % 40 AS varchar)) WHEN 1 THEN concat('g:d', cast(p_size % 5 AS varchar)) ELSE 'g:e' END AS name, CASE p_partkey % 3 WHEN 0 THEN cast(p_partkey % 2 AS varchar) WHEN 1 THEN '1:x' ELSE '2' END AS version FROM part)
      SELECT run_id, count(*) AS statements, count(*) FILTER (k % 7 <> 0) AS matchable FROM u JOIN p USING (name, version) GROUP BY 1""",
    "runs_to_do": "SELECT cast(o_orderkey AS varchar) AS run_id FROM orders WHERE o_orderkey % 2 = 0",
    "eval_events": f"{_L} SELECT source_file, cast(sequence + 1 AS int) AS line_number, event_id FROM l",
    "catalog_statistics": """SELECT 'statements' AS dimension, NULL AS value, count(*) AS n FROM part UNION ALL SELECT 'api', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'kind', CASE WHEN p_size < 10 THEN 'unsupported' ELSE p_brand END, count(*) FROM part GROUP BY 2
      UNION ALL SELECT 'detection', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'reason', CASE WHEN p_size < 5 THEN 'small' ELSE 'short' END, count(*) FROM part WHERE p_size < 10 GROUP BY 2""",
    "call_statistics": "SELECT count(*) AS calls, count(*) FILTER (o_orderstatus <> 'O') AS resolved, count(*) FILTER (o_orderstatus = 'F') AS own, round(100.0 * count(*) FILTER (o_orderstatus <> 'O') / count(*), 9) AS resolved_percent, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 9) AS own_percent FROM orders",
    "statement_ordinals": "SELECT o_orderkey AS place, cast(row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus, o_custkey % 3, o_custkey % 2 ORDER BY o_orderkey) - 1 AS int) AS ordinal FROM orders",
    "merged_modules": "SELECT n_name AS module, CASE WHEN n_nationkey < 20 AND n_nationkey % 3 = 0 THEN 'old' ELSE 'new' END AS dependencies, CASE WHEN n_nationkey < 20 AND n_nationkey % 3 = 0 THEN concat('a,', n_name) ELSE '' END AS selected FROM nation",
    "primary_truths": f"{_J} SELECT log_id, truth AS statement_id, CASE WHEN substring(truth, 2) < '5' THEN concat('c', substring(truth, 2)) END AS class_fqn FROM j WHERE evaluable",
    "eval_per_status": f"{_J} SELECT v.s AS status, count(j.event_id) AS events, count(*) FILTER (at1) AS at1, count(*) FILTER (at3) AS at3, round(count(*) FILTER (at1) / nullif(count(j.event_id), 0), 9) AS acc_at1, round(count(*) FILTER (at3) / nullif(count(j.event_id), 0), 9) AS acc_at3 FROM (VALUES ('matched'), ('ambiguous'), ('unmatched')) v(s) LEFT JOIN j ON j.status = v.s AND evaluable GROUP BY 1",
    "eval_all_dimensions": _J + " " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce({x}, 'unknown') AS value, count(*) AS events, count(*) FILTER (evaluable) AS evaluable, count(*) FILTER (at1) AS at1, count(DISTINCT truth_key) AS statements, count(DISTINCT truth_key) FILTER (at1) AS hit FROM j GROUP BY 2" for d, x in (("service", "service"), ("level", "level"), ("confidence", "confidence"), ("thread", "thread"), ("hour", "cast(hour(ts) AS varchar)"), ("kind", "CASE WHEN event_id % 4 > 0 THEN level END"))),
    "labelled_truths": f"""{_L}, k AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN cast(event_id % 8 // 2 AS int) END AS v, CASE WHEN status <> 'unmatched' THEN predicted END AS now FROM l),
      t AS (SELECT *, CASE v WHEN 0 THEN coalesce(CASE WHEN event_id % 3 = 0 THEN 's9' END, now) WHEN 1 THEN 's3' END AS told FROM k),
      f AS (SELECT event_id, string_agg(concat('s', cast(i AS varchar)), '+' ORDER BY concat('s', cast(i AS varchar))) AS found FROM t, range(0, 12) r(i) WHERE i % 4 = event_id % 6 AND event_id % 20 BETWEEN i AND i + 6 GROUP BY 1),
      x AS (SELECT t.event_id, CASE WHEN told IS NOT NULL THEN told WHEN v = 3 THEN '' WHEN t.event_id % 5 > 0 THEN coalesce(found, '') END AS ids FROM t LEFT JOIN f ON f.event_id = t.event_id)
      SELECT event_id, CASE WHEN ids IS NULL THEN 'unknown' WHEN ids = '' THEN 'not_in_catalog' ELSE 'known' END AS state, coalesce(ids, '') AS truth_key FROM x""",
    "listed_labels": """WITH l AS (SELECT concat('d', cast(doc_id % 97 AS varchar)) AS log_id, CASE WHEN doc_id % 10 = 9 THEN NULL WHEN toxic = 1 THEN 'not_in_catalog' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict, doc_id AS labeled_at FROM labels),
      n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY labeled_at DESC) = 1) SELECT log_id, labeled_at FROM n WHERE verdict = 'correct' ORDER BY labeled_at DESC, log_id DESC LIMIT 25""",
    "label_snapshots": f"{_L} SELECT log_id, dataset_id, CASE WHEN status <> 'unmatched' THEN predicted END AS predicted_statement_id, true AS dated FROM l WHERE event_id % 5 = 0",
    "unique_edges": """WITH e AS (SELECT c_name AS caller_id, n_name AS target_class, 'run' AS method, cast(c_custkey % 90 AS int) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey),
      o AS (SELECT n_name, min(s_name) AS only_ FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey > 12 OR s_suppkey <= 12 GROUP BY 1 HAVING count(*) = 1)
      SELECT *, false AS via_interface FROM e UNION ALL SELECT caller_id, only_, method, line, true FROM e JOIN o ON target_class = n_name""",
    "resolved_frames": """WITH f AS (SELECT cast(l_orderkey AS varchar) AS log_id, l_linenumber, l_partkey, l_suppkey, l_partkey % 5 AS c, concat('C', cast(l_partkey % 5 AS varchar), CASE WHEN l_partkey % 5 = 1 AND l_suppkey % 2 = 0 THEN '$' ELSE '' END) AS class FROM lineitem)
      SELECT log_id, string_agg(concat(class, CASE c WHEN 0 THEN '/true/p:1/f0' WHEN 1 THEN '/false/g:a:1/f1' WHEN 2 THEN '/false/g:a:1/-' ELSE '/false/-/-' END), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, class) AS frames FROM f GROUP BY 1""",
    # by the rules of scoring: full match 0.45, prefix 0.2, 0.2 * L / (L + 15) for L letters of literals, logger 0.2, 0.15, 0.12 or -0.25, level 0.1, 0.03 or -0.3, exception 0.05 or -0.05
    "match_branches": """WITH v(k, status, statement_id, confidence, confidence_level, args, candidates, parts, class_fqn, template, logger) AS (VALUES
        (0, 'matched', 'b-direct', 0.45 + 0.2 * 9 / 24 + 0.35, 'high', '1', 'b-direct 0.875000', 'regex_full 0.45|logger_exact 0.20|level_equal 0.10|throwable_consistent 0.05', 'com.shop.A', 'Alpha {} done', 'com.shop.A'),
        (1, 'matched', 'b-parent', 0.45 + 0.2 * 8 / 23 + 0.3, 'high', '2', 'b-parent 0.819565', 'regex_full 0.45|logger_hierarchy 0.15|level_equal 0.10|throwable_consistent 0.05', 'com.shop.Base', 'Base says {}', 'com.shop.Child'),
        (2, 'matched', 'b-multi1', 0.77, 'high', '3', 'b-multi1 0.770000|b-multi2 0.600000', 'regex_full 0.45|logger_abbrev_multi 0.12|level_equal 0.10|throwable_consistent 0.05', 'com.shop.x.M', 'Multi {}', NULL),
        (3, 'matched', 'b-token', 0.6 + 0.2 * 20 / 35, 'medium', '4', 'b-token 0.714286', 'regex_full 0.45|level_equal 0.10|throwable_consistent 0.05', 'com.shop.T', 'Unusual zebra {} crossing', NULL),
        (4, 'matched', 'b-direct', 0.475, 'low', '5', 'b-direct 0.475000', 'regex_full 0.45|logger_exact 0.20|level_conflict -0.30|throwable_consistent 0.05', 'com.shop.A', 'Alpha {} done', 'com.shop.A'),
        (5, 'matched', 'b-direct', 0.625, 'medium', '6', 'b-direct 0.625000', 'regex_prefix 0.20|logger_exact 0.20|level_equal 0.10|throwable_consistent 0.05', 'com.shop.A', 'Alpha {} done', 'com.shop.A'),
        (6, 'matched', 'b-direct', 0.775, 'high', '7', 'b-direct 0.775000', 'regex_full 0.45|logger_exact 0.20|level_equal 0.10|throwable_inconsistent -0.05', 'com.shop.A', 'Alpha {} done', 'com.shop.A'),
        (7, 'matched', 'b-any', 0.35, 'low', 'whatever 8', 'b-any 0.350000', 'logger_exact 0.20|level_equal 0.10|throwable_consistent 0.05', 'com.shop.D', '{}', 'com.shop.D'),
        (8, 'matched', 'b-token', 0.35 + 0.2 * 20 / 35, 'low', '9', 'b-token 0.464286', 'regex_full 0.45|logger_conflict -0.25|level_equal 0.10|throwable_consistent 0.05', 'com.shop.T', 'Unusual zebra {} crossing', 'com.shop.A'),
        (9, 'ambiguous', 'b-multi1', 0.35 * 0.6, 'low', '10', 'b-multi1 0.350000|b-multi2 0.330000', 'regex_full 0.45|logger_exact 0.20|level_conflict -0.30|throwable_inconsistent -0.05', 'com.shop.x.M', 'Multi {}', 'com.shop.x.M'),
        (10, 'matched', 'b-token', 0.6 + 0.2 * 20 / 35, 'medium', '11', 'b-token 0.714286', 'regex_full 0.45|level_equal 0.10|throwable_consistent 0.05', 'com.shop.T', 'Unusual zebra {} crossing', NULL),
        (11, 'unmatched', NULL, NULL, NULL, '', 'b-any 0.000000', '', NULL, NULL, 'com.shop.D'))
      SELECT event_id, status, statement_id, round(cast(confidence AS double), 6) AS confidence, confidence_level, args, candidates, parts, class_fqn, template, logger FROM events JOIN v ON event_id % 12 = k""",
}
