"""DuckDB SQL for the operators that SQL can express."""

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""

MIXING = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || doc_id) AS draw
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS k
  FROM s GROUP BY source
), w AS (
  SELECT source, source_size, source_size * 3 AS cap, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src
), l AS (
  SELECT source, cap / weight AS ratio,
         ((SELECT sum(source_size) FROM w)
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
         / (sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM w
), t AS (
  SELECT source, source_size,
         least(cap::DOUBLE, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source LIMIT 1)) AS target
  FROM w
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), d AS (
  SELECT s.doc_id, s.size, q.source_size, q.target, q.whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id) - s.size / 2 < q.target - q.whole * q.source_size AS extra
  FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       ((whole + CASE WHEN extra THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d
"""
