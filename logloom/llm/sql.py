"""DuckDB SQL for the queries of this subpackage that it can express, from their definitions; the others are tested by brute force in tests/llm.

op1: XXH64 with a seed is not in DuckDB. op2, op7: ids come from a tokenizer. op3, op4, op6: alignments and learnt
models. op8: its approximate search need not find all neighbours. op9: its blocks are drawn by Spark's seeded hashes.
"""

#: All pairs of usable vectors, and the smallest id that links reach.
_EMBEDDINGS = """WITH RECURSIVE t AS (SELECT vec_id, cast(embedding AS double[]) AS v FROM embeddings),
  u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM t WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95),
  r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(vec_id = coalesce(component, vec_id), true) AS kept
FROM t LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.a = vec_id"""


def _escaped(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '\\[(\\\\*/?INST\\])', '[\\\\\\1', 'g'), '<(\\\\*/s>)', '<\\\\\\1', 'g')"


#: A turn is [INST]role[/INST]text</s>, with a backslash after the first character of control strings inside.
_CHATS = f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
  t AS (SELECT conv_id, turn AS k, role AS a, text AS b, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY k NULLS FIRST, a NULLS FIRST, b NULLS FIRST)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k NULLS FIRST, a NULLS FIRST, b NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(17 + length({_escaped('role')}) + length({_escaped('text')})) AS bigint) AS formatted_chars FROM t GROUP BY conv_id"""

#: Every window of 20 words as text, and where it starts first.
_REPEATS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  w AS (SELECT r, k, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM d),
  g AS (SELECT r, k, word, i, CASE WHEN i + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS span FROM w),
  f AS (SELECT r, word, i, span IS NOT NULL AND (k > min(k) OVER (PARTITION BY span) OR row_number() OVER (PARTITION BY span, r ORDER BY i) > 1) AS later FROM g),
  m AS (SELECT r, word, i, bool_or(later) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
  a AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (r)"""

#: Units as a list, cut where the digits say.
_FIM = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
  e AS (SELECT doc_id, t, u, len(u) AS n, list_sort([h1 % (len(u) + 1), h2 % (len(u) + 1)]) AS c, h3, h4 FROM (SELECT *, cast('0x' || substr(h, 1, 8) AS bigint) AS h1, cast('0x' || substr(h, 9, 8) AS bigint) AS h2, cast('0x' || substr(h, 17, 8) AS bigint) AS h3, cast('0x' || substr(h, 25, 8) AS bigint) AS h4 FROM d)),
  p AS (SELECT doc_id, t, n, array_to_string(u[1:c[1]], '') AS p, array_to_string(u[c[1] + 1:c[2]], '') AS m, array_to_string(u[c[2] + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: Filters applied one order after the other; the sum over all orders by a window.
_AUDIT = """WITH RECURSIVE o(o) AS (SELECT '' UNION ALL SELECT o || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE NOT contains(o, c)),
  s AS (SELECT o AS filter_order, i AS step, o[i:i] AS f, o[1:i - 1] AS earlier FROM o, range(1, 6) r(i) WHERE length(o) = 5),
  t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM t LEFT JOIN l USING (doc_id)),
  c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, fails),
  j AS (SELECT part, filter_order, step, f, n, g, x, fails, contains(fails, f) AS failing, regexp_matches(fails, '[' || earlier || '0]') AS gone FROM c, s),
  r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails, coalesce(sum(g) FILTER (NOT gone AND failing), 0) AS good_lost, coalesce(sum(x) FILTER (NOT gone AND failing), 0) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, cast(step AS integer) AS step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails, cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost,
  cast(sum(removed) OVER (PARTITION BY part, f) AS bigint) AS shapley FROM r"""

ORACLE_SQL: dict[str, str] = {"op11_substring_dedup": _REPEATS, "op12_fill_in_middle": _FIM, "op13_filter_audit": _AUDIT, "op5_embedding_near_dedup": _EMBEDDINGS, "op10_chat_format": _CHATS}
