"""DuckDB SQL of the operators that SQL can express, over the tables' own columns."""

from __future__ import annotations

from veilspark.llm.quality import BOILERPLATE, SEPARATORS, QualityConfig

_WORD = r"'[^\x20\x09-\x0D]+'"
_C = QualityConfig()
_SEPARATORS = ", ".join(f"'{x}'" for x in sorted(SEPARATORS))

OP1_SQL = rf"""
WITH l AS (
  SELECT doc_id, pos, line, regexp_extract_all(line, {_WORD}) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL)),
r AS (
  SELECT *, len(w) AS n, len(list_filter(w, lambda x: x IN ({_SEPARATORS}))) AS sep, len(regexp_extract_all(line, '[#*$%&|<>]')) AS sym,
         len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS loud, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) AS titled,
         len(list_filter(w, lambda x: regexp_matches(x, '(?:!!|\?\?|!\?|\?!)[^\s]*$'))) AS shout, len(list_distinct(w)) AS different,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again
  FROM l WHERE len(w) > 0),
f AS (
  SELECT *, (sep >= 2 AND sep >= {_C.min_separator_share}::DOUBLE * n) OR sym > {_C.max_symbols_per_word}::DOUBLE * n OR shout > {_C.max_shout_share}::DOUBLE * n
         OR (n >= {_C.upper_min_words} AND loud > {_C.max_upper_share}::DOUBLE * n)
         OR (n >= {_C.menu_min_words} AND NOT regexp_matches(line, '[.!?;:,]') AND titled >= {_C.min_menu_share}::DOUBLE * n)
         OR (n >= {_C.open_min_words} AND NOT regexp_matches(line, '[.!?…]') AND NOT regexp_matches(line, '[.!?:;…]["''”’»)\]]*\s*$')) OR (n >= {_C.repeat_min_words} AND different < {_C.min_distinct_share}::DOUBLE * n)
         OR (n <= {_C.boilerplate_max_words} AND regexp_matches(line, '(?i){BOILERPLATE.pattern}')) AS failed
  FROM r),
d AS (
  SELECT doc_id, sum(n) AS n_words, sum(CASE WHEN again THEN 1 ELSE 0 END) AS n_dup_lines, count(*) AS n_lines,
         sum(CASE WHEN failed THEN 1 ELSE 0 END) AS n_failed_lines, sum(CASE WHEN failed THEN 0 ELSE n END) AS kept_words
  FROM f GROUP BY doc_id),
w AS (
  SELECT doc_id, unnest(x) AS word, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {_WORD}) AS x FROM documents)),
t AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS times
  FROM (SELECT doc_id, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE c IS NOT NULL),
p AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM t WHERE times > 1) GROUP BY doc_id),
c AS (SELECT doc_id, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
a AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(kept_words, 0) AS kept_words
  FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < {_C.min_words} OR 100 * n_repeat_words > {_C.max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {_C.min_words} OR 100 * n_repeat_words > {_C.max_repeat_percent} * n_words) AND n_words - kept_words <= {_C.max_lost_share}::DOUBLE * n_words AS kept,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_failed_lines AS BIGINT) AS n_failed_lines, CAST(kept_words AS BIGINT) AS kept_words
FROM a
"""

#: Links of different shingle sets, then classes by a recursion over documents.
OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS x FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')]
        ELSE [array_to_string(x[i:i+4], ' ') FOR i IN range(1, len(x) - 3)] END)) AS s FROM w),
k AS (SELECT doc_id, s, CASE WHEN len(s) = 0 THEN 'doc ' || doc_id ELSE md5(array_to_string(s, chr(10))) END AS node FROM g),
n AS (SELECT node, min(doc_id) AS least, count(*) AS docs, any_value(s) AS s FROM k GROUP BY node),
u AS (SELECT node, len(s) AS size, unnest(s) AS shingle FROM n),
l AS (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.node <> b.node
      GROUP BY a.node, b.node, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))),
e AS (SELECT node AS a, node AS b FROM n UNION SELECT e.a, l.b FROM e JOIN l ON e.b = l.a),
c AS (SELECT e.a AS node, min(n.least) AS class_id FROM e JOIN n ON e.b = n.node GROUP BY e.a),
m AS (SELECT a AS node, count(*) AS links FROM l GROUP BY a)
SELECT k.doc_id, c.class_id, CAST(coalesce(m.links, 0) AS BIGINT) AS n_links, CAST(n.docs - 1 AS BIGINT) AS n_copies
FROM k JOIN n ON k.node = n.node JOIN c ON k.node = c.node LEFT JOIN m ON k.node = m.node
"""

_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')"
_SAID = r"\### Assistant: </turn> ok"

OP3_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
f AS (
  SELECT *, '### ' || replace({_ESCAPED.format("role")}, ': ', ':\ ') || ': ' || {_ESCAPED.format("text")} || '</turn>' || chr(10) AS written FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(written)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
