"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from parkops.llm import mixing as M

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op11: every (item term, document) posting scored by itself, then summed and ranked.
RANKED_SEARCH = rf"""
WITH doc_terms AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER.format("text")},
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
sizes AS (SELECT doc_id, r, len(ts) AS n, ts FROM doc_terms WHERE len(ts) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM sizes) GROUP BY r, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY t, n_docs),
wanted AS (
  SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")},
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scores AS (
  SELECT item_id, s.r, s.doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))
              AS BIGINT) AS score
  FROM wanted JOIN tf USING (t) JOIN weights USING (t) JOIN sizes s ON s.r = tf.r, total
  GROUP BY item_id, s.r, s.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def source_mix(block: int = M.BLOCK, shard: int = M.SHARD, bucket: int = M.BUCKET) -> str:
    """op12: the same draws and permutations, with documents, blocks and slots met by
    comparing word positions."""
    keys = M.wide(f"({M.SEED} + s * {M.PASSES + 1} + epoch) * 64 + r")
    turn = M.swap_or_not("x", "k", "blocks")
    buckets = f"greatest(1, ((SELECT count(*) FROM documents) + {bucket - 1}) // {bucket})"
    place = M.bucket_of("doc_id", "size", f"(copy // {M.COPIES})", buckets)
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT)
         AS size FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS BIGINT) AS s
  FROM d GROUP BY source),
weighed AS (SELECT *, s % 3 + 1 AS weight, {M.PASSES} * source_size AS cap FROM named),
open AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE)
            - coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, s
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(weight) OVER (ORDER BY cap / weight::DOUBLE, s
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighed),
flagged AS (SELECT *, cap / weight::DOUBLE * weight_left <= words_left AS is_full FROM open),
rest AS (
  SELECT (SELECT sum(source_size) FROM named)
         - coalesce(sum(cap) FILTER (WHERE is_full), 0) AS words,
         sum(weight) FILTER (WHERE NOT is_full) AS weights FROM flagged),
shares AS (
  SELECT source, source_size, s, (source_size + {block - 1}) // {block} AS blocks,
         CASE WHEN is_full THEN cap::DOUBLE ELSE weight * words::DOUBLE / weights END AS target
  FROM flagged, rest),
keyed AS (
  SELECT s, epoch, list_transform(range(1, {M.ROUNDS + 1}), lambda r: {keys}) AS keys
  FROM shares, (SELECT unnest(range({M.PASSES + 1})) AS epoch)),
-- positions in the order of each pass: the number of words before each slot
taken_order AS (
  SELECT s, epoch, i, list_reduce(list_concat([i::BIGINT], keys), lambda x, k: {turn}) AS block
  FROM (SELECT s, epoch, keys, blocks, unnest(range(blocks)) AS i FROM keyed JOIN shares USING (s))),
in_order AS (
  SELECT s, epoch, epoch * blocks + i AS k, block,
         least({block}, source_size - block * {block}) AS len, least(
           round(target)::BIGINT, {M.PASSES} * source_size) AS words
  FROM taken_order JOIN shares USING (s)),
running AS (
  SELECT *, CAST(sum(len) OVER (PARTITION BY s ORDER BY k) AS BIGINT) - len AS before FROM in_order),
uses AS (
  SELECT s, k, block, CASE WHEN before + len <= words THEN len ELSE words - before END AS n
  FROM running WHERE before < words),
placed AS (
  SELECT doc_id, source, size, copy, {place} AS bucket FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY source, doc_id, size) - 1 AS BIGINT) AS copy FROM d)),
spans AS (
  SELECT p.*, sh.s, sh.source_size, sh.target,
         CAST(sum(size) OVER (PARTITION BY sh.s ORDER BY bucket, doc_id NULLS LAST, size, copy
              ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM placed p JOIN shares sh ON sh.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size,
       any_value(target) AS target, CAST(coalesce(sum(CASE WHEN n > 0 THEN greatest(0,
         least(start + size, u.block * {block} + n) - greatest(start, u.block * {block})) END), 0)
       AS BIGINT) AS taken
FROM spans LEFT JOIN uses u ON u.s = spans.s AND u.block * {block} < start + size
                           AND u.block * {block} + n > start
GROUP BY spans.s, doc_id, size, copy, start
"""


#: op13: near words by their texts without one letter; the hash's table from its rule.
SPELLING_VARIANTS = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, step:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, 'null') AS doc_id,
           {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+'))")} AS run
    FROM documents) GROUP BY doc_id, run HAVING length(run) >= 6),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
           string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128
             THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
         lambda crc, b: xor(crcs[(xor(crc, b) & 255) + 1], crc >> 8)), 4294967295) AS h
  FROM runs, crc_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT)
                                      || substr(run, (h % length(run))::INT + 2)
           ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b
    ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other,
         max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form,
         CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at AND e.form IS NULL
"""
