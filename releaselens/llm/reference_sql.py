"""DuckDB texts for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LF = "chr(10)"


def crc32(value: str) -> str:
    """Unsigned crc32 of the decimal spelling of an integer, bit by bit."""
    letters = f"list_transform(string_split({value}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda a, b: {byte}), 4294967295)"


PREFIX_TRIE = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, role, text, row_number() OVER (
    PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, substr(sha256(concat(octet_length(encode(role)), ':', role, text)), 1, 30)) AS pos
  FROM turns
), convs AS (
  SELECT conv_id, {crc32("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c
  JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), paths AS (
  SELECT c.conv_id, coalesce(p.path, []) AS path FROM convs c
  LEFT JOIN (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, pos) AS path FROM rebuilt GROUP BY conv_id
  ) p USING (conv_id)
), members AS (
  SELECT conv_id, len(path) AS length, d, path[1:d] AS node
  FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM paths)
), nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = d), '')) AS ends_sha256
  FROM members GROUP BY node, d
), kids AS (
  SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
), costs AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children,
    CASE WHEN n.d > 0 THEN (n.n_convs - 1) * len(regexp_extract_all(n.node[n.d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS cost
  FROM nodes n LEFT JOIN kids k ON k.node = n.node AND k.d = n.d
), subtrees AS (
  SELECT node[1:top] AS node, top AS d, sum(cost) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS top FROM costs) GROUP BY ALL
)
SELECT c.conv_id, c.d::BIGINT AS depth, up.conv_id AS parent_conv_id, c.n_convs::BIGINT AS n_convs,
  c.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM costs c JOIN subtrees s ON s.node = c.node AND s.d = c.d
LEFT JOIN nodes up ON c.d > 0 AND up.d = c.d - 1 AND up.node = c.node[1:c.d - 1]
"""

LINE_DEDUP = f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), {LF}) AS own FROM documents
), lines AS (
  SELECT r, doc_id, unnest(own) AS line, generate_subscripts(own, 1) AS i FROM rows
), keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), held AS (
  SELECT k, min(doc_id) AS least FROM keys WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT x.*, h.k IS NOT NULL AND x.doc_id <> h.least AS gone FROM keys x LEFT JOIN held h ON h.k = x.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, {LF} ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""

PERIODIC_RUNS = f"""
WITH given AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w, {crc32("doc_id")} AS h FROM documents
), parts AS (
  SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given
), looped AS (
  SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM parts
), texts AS (
  SELECT r, doc_id, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0
    THEN list_transform(range(0, len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w
  FROM looped
), words AS (
  SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pairs) GROUP BY r, q, g
  HAVING count(*) >= 3 * q AND count(*) + q >= 6
), runs AS (
  SELECT * FROM islands x WHERE NOT EXISTS (
    SELECT 1 FROM islands y
    WHERE y.r = x.r AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)
), sums AS (
  SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', q, {LF}), '' ORDER BY start, q) AS spelt FROM runs GROUP BY r
), ranked AS (
  SELECT x.*, (SELECT count(*) FROM runs y WHERE y.r = x.r AND (y.length * x.q > x.length * y.q
      OR y.length * x.q = x.length * y.q AND (y.start < x.start OR y.start = x.start AND y.q < x.q))) AS better
  FROM runs x
), gone AS (
  SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
  SELECT w.r, string_agg(w.word, ' ' ORDER BY w.i) AS collapsed FROM words w ANTI JOIN gone g ON g.r = w.r AND g.i = w.i GROUP BY w.r
)
SELECT t.doc_id, coalesce(s.n_runs, 0) AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.q::BIGINT AS period,
  (1000 * b.length // b.q)::BIGINT AS exponent_milli, sha256(coalesce(s.spelt, '')) AS runs_sha256,
  sha256(coalesce(k.collapsed, '')) AS collapsed_sha256
FROM texts t LEFT JOIN sums s USING (r) LEFT JOIN kept k USING (r) LEFT JOIN (SELECT * FROM ranked WHERE better = 0) b USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": PREFIX_TRIE, "op12_line_dedup": LINE_DEDUP, "op13_periodic_runs": PERIODIC_RUNS}
