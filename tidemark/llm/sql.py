"""DuckDB SQL for the queries that SQL can express."""

OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM totals),
levels AS (
  SELECT *, (150 * sum(source_size) OVER () - 100 * coalesce(sum(2 * source_size) OVER (
             ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (100.0::DOUBLE * sum(w) OVER (
             ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS here
  FROM weighed),
targets AS (
  SELECT source, source_size, w,
         coalesce(least(max(CASE WHEN 2 * source_size / w >= here THEN here END) OVER () * w,
                        CAST(2 * source_size AS DOUBLE)), CAST(2 * source_size AS DOUBLE)) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, w, CAST(floor(target + 0.5) AS BIGINT) AS quota,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
shares AS (
  SELECT *, least(greatest(quota - start, 0), size) + least(greatest(quota - start - source_size, 0), size) AS taken,
         start / quota AS f
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken = 0 THEN NULL ELSE round(CASE w
         WHEN 5 THEN (1.5 - sqrt(2.25 - 2 * f))
         WHEN 2 THEN f
         ELSE CASE WHEN f < 0.25 THEN 2 * f
              ELSE 0.5 + (sqrt(0.25 + 8 * (f - 0.25)) - 0.5) / 4 END END, 6) END AS first_position
FROM shares
"""

OP9 = r"""
WITH kept AS (
  SELECT source, lang, text FROM (
    SELECT *, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id NULLS FIRST, source NULLS FIRST,
                                 lang NULLS FIRST) AS r FROM documents) WHERE r = 1),
counts AS (
  SELECT source, lang, 'words-1' AS tokenizer,
         coalesce(len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')), 0) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'pieces-2',
         coalesce(len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')), 0) FROM kept)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens
FROM counts GROUP BY ALL
"""

ORACLES: dict[str, str] = {"op4_curriculum_mix": OP4, "op9_token_rollup": OP9}
