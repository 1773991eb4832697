"""SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from reqsieve.llm.queries import CONTROL_TEXT, FIRST_DAY, QUERY_EVERY, SCALE, SPREAD_SECONDS, TOP_K

_TOPK = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP_K}
"""

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION = f"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, coalesce({_WORDS.format("text")}, []) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size,
    array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS words
  FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(k)
  WHERE len(w) > 0
), numbered AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce({_WORDS.format("text")}, []) AS w FROM documents
), places AS (
  SELECT row, k AS place, size, array_to_string(w[k : k + size - 1], ' ') AS words
  FROM numbered, (SELECT DISTINCT size FROM windows) AS sizes, unnest(generate_series(1, len(w) - size + 1)) AS s(k)
), found AS (
  SELECT row, place, places.size, item FROM places JOIN windows USING (size, words)
), hit AS (
  SELECT row, count(DISTINCT place + k) AS n_hit
  FROM (SELECT DISTINCT row, place, size FROM found), unnest(generate_series(0, size - 1)) AS s(k) GROUP BY row
), ids AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM found) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM numbered LEFT JOIN hit USING (row) LEFT JOIN ids USING (row)
"""

_URL_LISTS = rf"""
WITH parsed AS (
  SELECT page_id, to_timestamp({FIRST_DAY} + (page_id * 7919) % {SPREAD_SECONDS}) AT TIME ZONE 'UTC' AS fetched_at,
    lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), hosts AS (
  SELECT host, min(page_id) AS m FROM parsed WHERE host <> '' GROUP BY host
), dated AS (
  SELECT ['ads', 'malware', 'adult'][m % 3 + 1] AS list, host AS pattern, m * 37 % 400 AS first, m * 37 % 400 + 30 + m % 90 AS last FROM hosts
  UNION ALL SELECT ['ads', 'malware', 'adult'][m % 3 + 1], host, m * 37 % 400 + 200, NULL FROM hosts
  UNION ALL SELECT 'folder', host || '/en', m * 53 % 500, CASE WHEN m % 2 = 1 THEN m * 53 % 500 + 100 END FROM hosts
), parents AS (
  -- the changes of a domain come from all its hosts: the state after a day is that of its last change
  SELECT pattern, day, bool_and(adds) AS active FROM (
    SELECT regexp_replace(host, '^[^.]*\.', '') AS pattern, m * 11 % 700 AS day, true AS adds FROM hosts
    UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), m * 11 % 700 + 20, false FROM hosts
  ) GROUP BY ALL
), switches AS (
  SELECT * FROM (SELECT *, lag(active, 1, false) OVER (PARTITION BY pattern ORDER BY day) AS before FROM parents) WHERE active <> before
), entries AS (
  SELECT * FROM dated
  UNION ALL SELECT 'registrar', pattern, day, next FROM (
    SELECT *, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS next FROM switches) WHERE active
), timed AS (
  SELECT list, pattern, to_timestamp({FIRST_DAY} + first * 86400) AT TIME ZONE 'UTC' AS valid_from,
    to_timestamp({FIRST_DAY} + last * 86400) AT TIME ZONE 'UTC' AS valid_to FROM entries
), hits AS (
  SELECT page_id, list, pattern FROM parsed JOIN timed
    ON fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
    AND (host = split_part(pattern, '/', 1) OR ends_with(host, '.' || split_part(pattern, '/', 1)))
    AND (NOT contains(pattern, '/') OR path = '/en' OR starts_with(path, '/en/'))
)
SELECT page_id, fetched_at, coalesce(string_agg(DISTINCT list, ',' ORDER BY list), '') AS lists,
  count(list)::BIGINT AS n_entries, count(list) > 0 AS blocked
FROM parsed LEFT JOIN hits USING (page_id) GROUP BY page_id, fetched_at
"""

_CONTROL = r"'<(\\*)\|(im_(?:start|end)\|>)', '<\1\\|\2', 'g'"

_CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
), written AS (
  SELECT *, '<|im_start|>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), {_CONTROL}) || chr(10)
    || regexp_replace(text, {_CONTROL}) || '<|im_end|>' || chr(10) AS formatted FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_threshold_topk": _TOPK,
    "op4_chat_prefix_tree": _CHAT,
    "op5_suffix_array_decontamination": _DECONTAMINATION,
    "op10_temporal_url_lists": _URL_LISTS,
}
