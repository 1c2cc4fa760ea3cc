"""SQL twin of the URL filter's query."""

from __future__ import annotations

ORDER = 5


def _level(k: int) -> str:
    """Probabilities of the (k + 1)-grams from their counts and from the level below."""
    mixed = lambda x, low: (f"CASE WHEN n{x} > 0 THEN (CAST({x} AS DOUBLE) + u{x} * {low}) / (n{x} + u{x}) ELSE {low} END AS p{x}")
    low = {x: f"l.p{x}" if k else "(1.0::DOUBLE / 1114112)" for x in "ab"}
    join = f"JOIN p{k - 1} l ON l.gram = right(c.gram, {k})" if k else ""
    source = "g" if k == ORDER else f"(SELECT right(gram, {k + 1}) AS gram, sum(a) AS a, sum(b) AS b FROM g GROUP BY 1)"
    return f"""
 c{k} AS (SELECT *, CAST(sum(a) OVER w AS DOUBLE) AS na, CAST(sum(b) OVER w AS DOUBLE) AS nb, CAST(count(*) FILTER (a > 0) OVER w AS DOUBLE) AS ua,
                 CAST(count(*) FILTER (b > 0) OVER w AS DOUBLE) AS ub FROM {source} WINDOW w AS (PARTITION BY left(gram, {k}))),
 p{k} AS MATERIALIZED (SELECT c.gram, {mixed("a", low["a"])}, {mixed("b", low["b"])} FROM c{k} c {join}),"""


def twin() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    levels = "".join(map(_level, range(ORDER + 1)))
    return rf"""
WITH r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
 t AS (SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN contains(url, '://')
              THEN translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(rest, length(raw) + 1)
              ELSE coalesce(url, '') END AS text FROM h),
 d AS MATERIALIZED (SELECT *, CASE WHEN {fits('example.net', '/en/')} THEN 'example.net/en/' WHEN {fits('example.com', '/de/')} THEN 'example.com/de/'
                      WHEN {fits('org', '/fr/')} THEN 'org/fr/' WHEN {fits('net', '/')} THEN 'net/' END AS rule FROM t),
 x AS (SELECT DISTINCT text, rule IN ('example.net/en/', 'org/fr/') AS ok, rule IS NOT NULL AND left(md5(host), 1) IN ('0', '1', '2', '3') AS held FROM d),
 f AS MATERIALIZED (SELECT text, ok, held, [substr(repeat(chr(2), {ORDER}) || text || chr(3), i, {ORDER + 1}) FOR i IN range(1, length(text) + 2)] AS grams FROM x),
 g AS MATERIALIZED (SELECT gram, CAST(sum(CASE WHEN ok AND NOT held THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN NOT ok AND NOT held THEN 1 ELSE 0 END) AS BIGINT) AS b
       FROM (SELECT unnest(grams) AS gram, ok, held FROM f) GROUP BY gram),{levels}
 o AS (SELECT text, ok, unnest(grams) AS gram FROM f WHERE ok IS NULL OR held),
 s AS (SELECT text, ok, CAST(sum(CAST(floor((ln(pa) - ln(pb)) * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) AS total, count(*) AS n FROM o JOIN p{ORDER} USING (gram) GROUP BY 1, 2),
 z AS MATERIALIZED (SELECT text, ok, total / (n * 1e6) AS score, greatest(-2000, least(2000, CAST(floor(total * 200.0::DOUBLE / (n * 1e6)) AS BIGINT))) AS bin FROM s),
 b AS (SELECT bin, CAST(count(*) FILTER (ok) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT ok) AS DOUBLE) AS b FROM z WHERE ok IS NOT NULL GROUP BY bin),
 e AS (SELECT bin, coalesce(sum(a) OVER w, 0) / sum(a) OVER () + 1 - coalesce(sum(b) OVER w, 0) / sum(b) OVER () AS error, sum(a) OVER () AS fa, sum(b) OVER () AS fb
       FROM b WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 k AS (SELECT coalesce((SELECT bin FROM e WHERE fa > 0 AND fb > 0 ORDER BY error, abs(bin), bin LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') OR (rule IS NULL AND bin >= cut) THEN 'allow' ELSE 'block' END AS verdict, z.score
FROM d CROSS JOIN k LEFT JOIN z ON d.rule IS NULL AND z.ok IS NULL AND z.text = d.text"""
