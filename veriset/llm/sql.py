"""DuckDB SQL of the queries that SQL can express, written from the operators' definitions."""

MIX = """
WITH sizes AS (SELECT coalesce(source, '') AS s, source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT s, source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM sizes),
parts AS (SELECT *, greatest(1, ceil(rate / 16.0))::BIGINT AS parts FROM rates),
cdf AS (
  SELECT s, source, parts, k, sum(exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM parts, range(0, 88) AS t(k)),
draws AS (
  SELECT d.doc_id, d.source, d.text, p.s, u.part,
    (('0x' || substr(md5(concat_ws('|', '2027:' || u.part, p.s, coalesce(d.doc_id::VARCHAR, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS part) u),
counts AS (
  SELECT d.doc_id, d.source, d.text, d.s, sum((SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c < d.u)) AS n
  FROM draws d GROUP BY ALL),
totals AS (SELECT doc_id, source, text, s, sum(n)::BIGINT AS n FROM counts GROUP BY ALL)
SELECT doc_id, source, copy::BIGINT AS copy, md5(concat_ws('|', '2027:order', s, coalesce(doc_id::VARCHAR, ''), copy::VARCHAR)) AS shuffle_key,
  sha256(coalesce(text, '')) AS text_sha256
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM totals)
"""

LINES = r"""
WITH cut AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?\n \t\r]*|[.!?\n \t\r]+')) AS line,
    generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?\n \t\r]*|[.!?\n \t\r]+'), 1) AS i
  FROM documents),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, regexp_matches(line, '[.!?][ \t\r]*\n') AS ends FROM cut),
rolled AS (SELECT *, ends OR (coalesce(lag(CASE WHEN ends THEN 0 ELSE h END) OVER w, 0) * 31 + h) % 4 = 0 AS stop FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM rolled),
chunks AS (SELECT doc_id, no, string_agg(line, '' ORDER BY i) AS chunk, count(*) AS n FROM numbered GROUP BY doc_id, no),
repeated AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, no) > 1 AS again FROM chunks),
ranked AS (SELECT *, again AND (n > 1 OR coalesce(lag(again) OVER w, false) OR coalesce(lead(again) OVER w, false)) AS gone
  FROM repeated WINDOW w AS (PARTITION BY doc_id ORDER BY no))
SELECT d.doc_id, count(r.no) AS n_chunks, count(r.no) FILTER (WHERE gone) AS n_removed, coalesce(sum(length(chunk)) FILTER (WHERE gone), 0)::BIGINT AS removed_chars,
  sha256(coalesce(string_agg(chunk, '' ORDER BY no) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM documents d LEFT JOIN ranked r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""
