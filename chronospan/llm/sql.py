"""DuckDB SQL for the operators that SQL can express."""

OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d
),
dup AS (
  SELECT rid, sum(n - 1) AS n_dup_lines
  FROM (SELECT rid, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line)
  GROUP BY rid
),
tokens AS (
  SELECT rid, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM d
),
grams AS (
  SELECT rid, i, t, lead(t, 1) OVER o AS t2, lead(t, 2) OVER o AS t3 FROM tokens WINDOW o AS (PARTITION BY rid ORDER BY i)
),
hit AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, t, t2, t3) AS n FROM grams WHERE t3 IS NOT NULL
),
covered AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM hit, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid
),
base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN covered USING (rid)
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
),
hosts AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM judged WHERE source IS NOT NULL GROUP BY source
),
moments AS (
  SELECT count(*) AS k, sum(n)::DOUBLE AS docs, sum(n * n)::DOUBLE AS squares, sum(f) / sum(n) AS m, sum(f * f / n) AS spread FROM hosts
),
spare AS (
  SELECT *, docs - squares / docs - (k - 1) AS free FROM moments
),
shared AS (
  SELECT *, ((spread - docs * m * m) / nullif(m * (1 - m), 0) - (k - 1)) / nullif(free, 0) AS r FROM spare
),
prior AS (
  SELECT m, CASE WHEN k < 2 OR free <= 0 THEN 2.0 WHEN m IN (0, 1) OR r <= 0 THEN 1e6 ELSE greatest(2.0, least(1e6, 1 / r - 1)) END AS s FROM shared
),
verdict AS (
  SELECT source, (f + m * s) / (n + s) > 0.5 AS host_failed FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM judged LEFT JOIN verdict USING (source)
"""

OP4 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
),
g AS (
  SELECT html, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY html
)
SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""

#: What the template adds: <s> once, [INST] [/INST] </s> a turn, and the longer escapes of & < [ in role and text.
OP10 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
x AS (
  SELECT *, replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS shown FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(17 + length(shown)))::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

OP13 = """
WITH x AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
),
n AS (
  SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
         id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT * FROM n WHERE rank <= 5
"""
