"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

URL_FILTER = """
WITH parts AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), cut AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts
), hosts AS (
    SELECT page_id, path,
           translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
    FROM cut
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
    SELECT page_id, host, path, (
        SELECT max(struct_pack(size := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := r.verdict))
        FROM rules r
        WHERE (h.host = rule_host OR ends_with(h.host, '.' || rule_host)) AND starts_with(h.path, rule_path)) AS best
    FROM hosts h
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""

MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(coalesce(text, '')) AS digest
    FROM documents
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) - 1 AS n FROM sized
), summed AS (
    SELECT source, sum(size)::HUGEINT AS held FROM sized GROUP BY source
), weighted AS (
    SELECT source, held, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS weight
    FROM summed
), ordered AS (
    SELECT *, row_number() OVER (ORDER BY held * (6 // weight), source NULLS LAST) AS place FROM weighted
), filled AS (
    SELECT a.source, a.place, a.held, a.weight,
           (SELECT 3 * sum(held) FROM weighted) - 4 * coalesce(sum(held) OVER before, 0) AS part,
           2 * sum(weight) OVER following AS whole
    FROM ordered a
    WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           following AS (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
    SELECT part, whole FROM filled WHERE 2 * held * whole > weight * part ORDER BY place LIMIT 1
), targets AS (
    SELECT o.source, o.held,
           (CASE WHEN l.whole IS NULL OR 2 * o.held * l.whole <= o.weight * l.part THEN 2 * o.held ELSE o.weight * l.part END)::HUGEINT AS part,
           (CASE WHEN l.whole IS NULL OR 2 * o.held * l.whole <= o.weight * l.part THEN 1 ELSE l.whole END)::HUGEINT AS whole
    FROM ordered o LEFT JOIN level l ON true
), drawn AS (
    SELECT d.doc_id, d.size::BIGINT AS size, t.held::BIGINT AS source_size, t.part::DOUBLE / t.whole::DOUBLE AS target,
           t.part, t.whole * t.held AS unit,
           ('0x' || substr(md5(':' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.digest || ':' || d.n), 1, 8))::BIGINT AS drawn
    FROM numbered d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN unit = 0 THEN 0
            ELSE size * (part // unit + CASE WHEN drawn * unit < (part % unit) * 4294967296 THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM drawn
"""

STATEMENTS = {"op1_url_filter": URL_FILTER, "op13_mixing": MIXING}
