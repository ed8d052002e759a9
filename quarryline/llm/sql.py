"""DuckDB SQL for the queries that SQL can express."""

#: Document words are spread by position; a window's key is its words joined.
DECONTAMINATE = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark),
gram AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, unnest(list_transform(range(1, len(words) - least(len(words), 10) + 2), lambda i: array_to_string(words[i:i + least(len(words), 10) - 1], ' '))) AS g
  FROM item WHERE len(words) > 0),
lens AS (SELECT DISTINCT n FROM gram),
win AS (
  SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS p, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS g
  FROM doc, lens WHERE len(words) >= n),
hit AS (SELECT doc_id, win.p AS p, win.n AS n, item_id FROM win JOIN gram USING (n, g)),
words_hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

PERSPECTIVES = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text, CAST(floor(turn / 1024) AS BIGINT) AS block
  FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS LAST, who, text) AS k FROM said),
cut AS (SELECT *, CAST((k - 1) // 256 AS INTEGER) AS part FROM ranked),
who AS (SELECT conv_id, who AS me FROM said WHERE who <> 'system' GROUP BY ALL),
seen AS (SELECT cut.*, me FROM cut LEFT JOIN who ON cut.conv_id IS NOT DISTINCT FROM who.conv_id),
piece AS (
  SELECT *, coalesce(who = me, false) AS mine,
         '<|im_start|>' || CASE WHEN who = me THEN 'assistant' WHEN who = 'system' THEN who ELSE 'user name=' || replace(replace(replace(replace(who, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<|', '<\|') END || chr(10) AS head,
         text || '<|im_end|>' || chr(10) AS body
  FROM seen),
placed AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, me, block, part ORDER BY k) AS past FROM piece)
SELECT conv_id, me AS perspective, block, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS rendered,
       coalesce(string_agg(CAST(past - length(body) AS BIGINT) || ':' || CAST(past - 1 AS BIGINT), ',' ORDER BY k) FILTER (mine), '') AS trained,
       CAST(max(past) AS BIGINT) AS n_chars
FROM placed GROUP BY conv_id, me, block, part
"""
