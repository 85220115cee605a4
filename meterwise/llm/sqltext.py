"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from meterwise.llm import chat, embeddings, mixing, warc

_WEIGHTS = ", ".join(map(str, mixing.WEIGHTS))
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS size,
         list_value({_WEIGHTS})[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight
  FROM d GROUP BY source),
f AS (SELECT *, {mixing.MAX_EPOCHS} * size AS filled, ({mixing.MAX_EPOCHS} * size)::DOUBLE / weight AS fills FROM s),
l AS (
  SELECT fills,
         ((SELECT sum(size) FROM s) - coalesce(sum(filled) OVER w, 0))::DOUBLE
           / ((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM f WINDOW w AS (ORDER BY fills, source NULLS LAST {_BEFORE})),
x AS (SELECT level FROM l WHERE fills >= level ORDER BY fills, level LIMIT 1),
t AS (SELECT source, size AS source_size, least(filled::DOUBLE, level * weight) AS target FROM f, x),
p AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, d.size {_BEFORE}), 0)::BIGINT AS taken_before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - taken_before)) AS taken
FROM p
"""

CHAT = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g'))
            + {len(chat.OPEN + chat.SPLIT + chat.CLOSE + chat.END)} AS chars
  FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(chars)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g
"""

_LETTER = "substr('{letters}', (((('0x' || substr(h, 5 * g + 1, 5))::INT) >> {shift}) & 31) + 1, 1)"
_GROUP = " || ".join(_LETTER.format(letters=warc.BASE32, shift=s) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS winner
  FROM pages)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g: {_GROUP}), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM p
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
good AS MATERIALIZED (SELECT * FROM v WHERE ok),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= {embeddings.THRESHOLD}),
reach AS (
  SELECT vec_id AS u, vec_id AS w FROM v
  UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, coalesce(v.vec_id = c.component_id, false) AS kept
FROM v LEFT JOIN c ON v.vec_id = c.u LEFT JOIN n ON v.vec_id = n.u
"""
