"""DuckDB SQL for those llm queries that SQL can express."""

from orrery.llm.quality_rules import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))

SQL = {
    "op4_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS l
  FROM documents),
tri AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
cov AS (
  SELECT r, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM tri WHERE c > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$'))) AS n_capital,
         len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-•*·]\s'))) AS n_bullet,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis,
         len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop
  FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1
       AND n_dup_lines / n_lines <= 0.5 AND n_repeat_words / n_words <= 0.5 AND n_capital / n_words <= 0.5
       AND n_bullet / n_lines <= 0.9 AND n_ellipsis / n_lines <= 0.3 AND n_stop / n_words >= 0.02 AS kept
FROM b""",
    "op5_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (
  SELECT conv_id, turn, coalesce(role, '') AS ro, coalesce(text, '') AS te FROM rows),
e AS (
  SELECT *, length(replace(replace(replace(ro, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
          + length(replace(replace(replace(te, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(ro || chr(10) || te || chr(10), '' ORDER BY turn, ro, te)) AS turns_sha256,
       length(coalesce(string_agg(te, '' ORDER BY turn, ro, te) FILTER (WHERE ro = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(te, '' ORDER BY turn, ro, te) FILTER (WHERE ro = 'assistant'), '')) AS loss_sha256,
       sum(n + 16)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
