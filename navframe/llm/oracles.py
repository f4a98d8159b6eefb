"""DuckDB SQL for the operators that SQL can express."""

SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP7 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS words
  FROM documents),
windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i:i + 4], ' ')) AS times
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM docs)),
repeated AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat_words
  FROM windows, range(5) AS r(o) WHERE times > 1 GROUP BY rid),
lines AS (
  SELECT rid, doc_id, source, text, line, regexp_extract_all({_lower('line')}, '{SPACE_WORD}') AS words
  FROM (SELECT rid, doc_id, source, text, unnest(string_split(body, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{SPACE_WORD}')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
held AS (
  SELECT rid, doc_id, source, text, array_to_string(words, ' ') AS line, sum(len(words)) AS n
  FROM lines GROUP BY ALL),
frequent AS (
  SELECT source, line, min(doc_id) AS first FROM held GROUP BY source, line HAVING count(DISTINCT text) > {{max_texts}}),
lost AS (
  SELECT h.rid, sum(h.n) AS n_line_words
  FROM held h JOIN frequent f ON h.line = f.line AND h.source IS NOT DISTINCT FROM f.source
  WHERE h.doc_id IS DISTINCT FROM f.first GROUP BY h.rid),
counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_line_words, 0) AS BIGINT) AS n_line_words
  FROM docs LEFT JOIN dup USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN lost USING (rid)),
ruled AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND 5 * (n_words - n_line_words) >= n_words AS kept FROM ruled
"""

OP8 = rf"""
WITH items AS (
  SELECT DISTINCT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{ALNUM_WORD}') AS words FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS pattern
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM items WHERE len(words) > 0)),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{ALNUM_WORD}') AS words FROM documents),
places AS (
  SELECT rid, size, i, array_to_string(words[i:i + size - 1], ' ') AS pattern
  FROM (SELECT rid, size, words, unnest(range(1, len(words) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM patterns))),
hits AS (SELECT rid, size, i, item_id FROM places JOIN patterns USING (size, pattern)),
words_hit AS (
  SELECT rid, count(DISTINCT w) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS w FROM hits) GROUP BY rid),
items_hit AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, w.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN words_hit w USING (rid) LEFT JOIN items_hit t USING (rid)
"""

OP9 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS words FROM documents),
windows AS (
  SELECT rid, doc_id, i, array_to_string(words[i:i + 49], ' ') AS w
  FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM docs WHERE doc_id IS NOT NULL)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (w) WHERE doc_id > first),
cut AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs) ANTI JOIN gone USING (rid, i)
  GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (rid) LEFT JOIN kept USING (rid)
"""

OP1 = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{SPACE_WORD}') AS words FROM documents),
shingles AS (
  SELECT DISTINCT rid, array_to_string(words[i:i + 2], ' ') AS s
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM docs WHERE len(words) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.rid < b.rid GROUP BY a.rid, b.rid),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * s.n >= 90 * (x.n + y.n - s.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT r.a AS rid, min(d.doc_id) AS least FROM reach r JOIN docs d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (rid) LEFT JOIN least USING (rid)
"""

OP11 = rf"""
WITH docs AS (
  SELECT doc_id, body, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(body)) AS r
  FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS body FROM documents)),
total AS (SELECT count(*) AS n, count(DISTINCT body) AS n_texts FROM docs),
pairs AS (
  SELECT a.r, a.doc_id, a.body, CAST(length(a.body) AS BIGINT) AS n_chars, b.r AS next_r, b.body AS next_body
  FROM docs a, total JOIN docs b ON b.r = a.r % total.n + 1),
sides AS (
  SELECT r, 0 AS side, body FROM pairs
  UNION ALL SELECT r, 1, left(body, n_chars - n_chars // 3) || left(next_body, n_chars // 3) FROM pairs),
lexicon AS (
  SELECT term FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(body), '{ALNUM_WORD}'))) AS term FROM (SELECT DISTINCT body FROM docs)), total
  GROUP BY term, n_texts HAVING count(*) * {{rare}} >= n_texts AND count(*) * {{common}} <= n_texts),
worded AS (
  SELECT r, side, body, words, length(bin(greatest(len(words) // {{spread}}, 1))) - 1 AS level
  FROM (SELECT r, side, body, list_distinct(regexp_extract_all(lower(body), '{ALNUM_WORD}')) AS words FROM sides)),
kept AS (
  SELECT r, side, level, term, CAST('0x' || left(md5(term), 8) AS BIGINT) AS h
  FROM (SELECT r, side, level, unnest(words) AS term FROM worded) SEMI JOIN lexicon USING (term)),
codes AS (
  SELECT r, side, up, level + up AS level, h % (1::BIGINT << (level + up)) AS slot, left(md5(string_agg(term, ' ' ORDER BY term)), 8) AS code
  FROM kept, range(2) AS u(up) WHERE h % (1::BIGINT << (level + up)) < {{subsets}} GROUP BY ALL),
slots AS (
  SELECT r, side, level AS low, up, slot FROM worded, range(2) AS u(up), range({{subsets}}) AS s(slot) WHERE slot < 1::BIGINT << (level + up)),
listed AS (
  SELECT s.r, s.side, s.low, s.up, string_agg(coalesce(code, ''), '.' ORDER BY s.slot) AS codes, count(code) AS n
  FROM slots s LEFT JOIN codes c ON s.r = c.r AND s.side = c.side AND s.up = c.up AND s.slot = c.slot GROUP BY ALL),
prints AS (
  SELECT l.r, l.side, l.low, l.n = 0 AS whole, sha256(w.body) AS sha,
         CASE WHEN l.n = 0 THEN 'text:' || sha256(w.body) ELSE l.low || ':' || l.codes || ':' || h.codes END AS fingerprint
  FROM listed l JOIN listed h ON l.r = h.r AND l.side = h.side AND l.up = 0 AND h.up = 1 JOIN worded w ON w.r = l.r AND w.side = l.side),
compared AS (
  SELECT r, 'edited' AS kind, r AS r2, 1 AS side2 FROM pairs UNION ALL SELECT r, 'next', next_r, 0 FROM pairs),
shared AS (
  SELECT c.r, c.kind, x.level, x.slot, x.code = y.code AS same
  FROM compared c JOIN prints a ON a.r = c.r AND a.side = 0 JOIN prints b ON b.r = c.r2 AND b.side = c.side2
  JOIN codes x ON x.r = a.r AND x.side = 0 AND x.level IN (b.low, b.low + 1)
  LEFT JOIN codes y ON y.r = b.r AND y.side = b.side AND y.level = x.level AND y.slot = x.slot),
others AS (
  SELECT c.r, c.kind, count(*) AS n
  FROM compared c JOIN prints a ON a.r = c.r AND a.side = 0 JOIN codes y ON y.r = c.r2 AND y.side = c.side2 AND y.level IN (a.low, a.low + 1)
  WHERE NOT EXISTS (SELECT 1 FROM codes x WHERE x.r = a.r AND x.side = 0 AND x.level = y.level AND x.slot = y.slot)
  GROUP BY ALL),
counted AS (SELECT r, kind, count(*) AS n, coalesce(sum(same::INT), 0) AS n_same FROM shared GROUP BY ALL),
near AS (
  SELECT c.r, c.kind, CASE WHEN a.fingerprint = b.fingerprint THEN 1.0::DOUBLE
         WHEN a.whole OR b.whole OR coalesce(t.n, 0) + coalesce(o.n, 0) = 0 THEN 0.0::DOUBLE
         ELSE coalesce(t.n_same, 0)::DOUBLE / (coalesce(t.n, 0) + coalesce(o.n, 0))::DOUBLE END AS near
  FROM compared c JOIN prints a ON a.r = c.r AND a.side = 0 JOIN prints b ON b.r = c.r2 AND b.side = c.side2
  LEFT JOIN counted t ON t.r = c.r AND t.kind = c.kind LEFT JOIN others o ON o.r = c.r AND o.kind = c.kind)
SELECT d.doc_id, p.n_chars, e.sha AS edited_sha256, a.fingerprint, e.fingerprint AS edited_fingerprint, ne.near AS near_edited, nn.near AS near_next
FROM documents d JOIN pairs p ON p.doc_id IS NOT DISTINCT FROM d.doc_id AND p.body = coalesce(d.text, '')
JOIN prints a ON a.r = p.r AND a.side = 0 JOIN prints e ON e.r = p.r AND e.side = 1
JOIN near ne ON ne.r = p.r AND ne.kind = 'edited' JOIN near nn ON nn.r = p.r AND nn.kind = 'next'
"""


def op13(k: int, rounds: int, dim: int, scale: int) -> str:
    """Lloyd rounds as one statement: components and centroids in long form."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
assigned{r} AS (
  SELECT rid, min({{'d': distance, 'c': c}}) AS best
  FROM (SELECT rid, c, sum((x - y) * (x - y)) AS distance FROM parts JOIN centroids{r} USING (i) GROUP BY rid, c) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
moved{r} AS (SELECT best.c AS c, i, sum(x) AS s, count(*) AS n FROM assigned{r} JOIN parts USING (rid) GROUP BY 1, 2),
centroids{r + 1} AS (
  SELECT c, i, CAST(coalesce((s - ((s % n) + n) % n) // n, y) AS BIGINT) AS y FROM centroids{r} LEFT JOIN moved{r} USING (c, i))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
parts AS (SELECT rid, unnest(range({dim})) AS i, unnest(v) AS x FROM kept),
seeds AS (
  SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL) WHERE c < {k}),
centroids0 AS (SELECT c, unnest(range({dim})) AS i, unnest(v) AS y FROM seeds),{",".join(steps)},
named AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM centroids{rounds} GROUP BY c)
SELECT vec_id, CAST(best.c AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM assigned{rounds} JOIN kept USING (rid) JOIN named ON named.c = best.c
"""
