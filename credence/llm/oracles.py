"""SQL (DuckDB) twins of the operators that SQL can express."""

_WORDS = r"""
benchmark_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
document_words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents)
"""

DECONTAMINATE = rf"""
WITH {_WORDS},
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM benchmark_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM windows),
places AS (
  SELECT r, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM document_words, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM places JOIN windows USING (g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM document_words d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, text, n, x, trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT DISTINCT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n
        FROM documents WHERE text IS NOT NULL)),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY n) AS i FROM lines WHERE line <> ''),
windows AS (
  SELECT doc_id, text, i, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM full_lines
  WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, i) AS k FROM windows WHERE c IS NOT NULL),
gone AS (
  SELECT DISTINCT f.doc_id, f.text, f.n FROM full_lines f JOIN ranked r
  ON r.k > 1 AND f.doc_id IS NOT DISTINCT FROM r.doc_id AND f.text = r.text AND f.i BETWEEN r.i AND r.i + 2),
kept AS (
  SELECT l.doc_id, l.text, count(*) FILTER (WHERE l.line <> '') AS n_lines, count(g.n) AS n_removed,
    coalesce(string_agg(l.x, chr(10) ORDER BY l.n) FILTER (WHERE g.n IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.n = g.n GROUP BY 1, 2)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(k.kept) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text
"""

PREFERENCE = r"""
WITH plain AS (SELECT conv_id AS pair, turn, coalesce(role, 'unknown') AS role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT pair, max(turn) AS pos, arg_max(text, turn) AS text FROM plain WHERE role = 'assistant' GROUP BY pair),
partners AS (SELECT *, coalesce(lead(pair) OVER (ORDER BY pair), lag(pair) OVER (ORDER BY pair)) AS other FROM last),
answers AS (SELECT a.pair, a.pos, b.text FROM partners a JOIN last b ON b.pair = a.other),
chosen AS (SELECT p.*, row_number() OVER (PARTITION BY pair ORDER BY turn) AS i FROM plain p WHERE pair IN (SELECT pair FROM answers)),
rejected AS (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY turn) AS i FROM (
    SELECT p.* FROM plain p JOIN answers a USING (pair) WHERE p.turn < a.pos
    UNION ALL SELECT pair, pos, 'assistant', text FROM answers)),
differs AS (
  SELECT coalesce(c.pair, r.pair) AS pair, min(coalesce(c.i, r.i)) AS i FROM chosen c FULL JOIN rejected r ON c.pair = r.pair AND c.i = r.i
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text OR c.i IS NULL OR r.i IS NULL GROUP BY 1),
cut AS (
  SELECT pair, coalesce(d.i - 1, (SELECT max(i) FROM chosen c WHERE c.pair = a.pair)) AS k FROM answers a LEFT JOIN differs d USING (pair)),
rendered AS (
  SELECT pair, side, i, role, '<|' || role || '|>' || chr(10) AS head, coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS body
  FROM (SELECT pair, 'c' AS side, i, role, text FROM chosen UNION ALL SELECT pair, 'r', i, role, text FROM rejected)),
parts AS (
  SELECT c.pair, c.k,
    coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'c' AND i <= k), '') AS prompt,
    coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'c' AND i > k), '') AS yes,
    coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'r' AND i > k), '') AS no,
    coalesce(sum(length(body)) FILTER (WHERE side = 'c' AND i > k AND role = 'assistant'), 0) AS yes_n,
    coalesce(sum(length(body)) FILTER (WHERE side = 'r' AND i > k AND role = 'assistant'), 0) AS no_n
  FROM cut c JOIN rendered USING (pair) GROUP BY c.pair, c.k)
SELECT pair AS conv_id, k AS prompt_turns, sha256(prompt) AS prompt_sha256, sha256(yes) AS chosen_sha256, sha256(no) AS rejected_sha256,
  CAST(yes_n AS BIGINT) AS chosen_learnt, CAST(no_n AS BIGINT) AS rejected_learnt FROM parts
"""

JACCARD = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * n_both >= 75 * (a.n + b.n - n_both)),
reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x) c USING (doc_id)
"""

#: CRC-32 bit by bit: each byte is followed by eight shifts.
PREFIX_TRIE = r"""
WITH plain AS (
  SELECT TRY_CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
turns AS (
  SELECT c, role, text, row_number() OVER (
    PARTITION BY c ORDER BY turn NULLS FIRST, md5(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS i
  FROM plain WHERE c IS NOT NULL),
ids AS (
  SELECT c, (((c % 5) + 5) % 5) AS k, xor(4294967295, list_reduce(
    [4294967295]::BIGINT[] || flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
      lambda x: [CAST(ascii(x) AS BIGINT)] || list_transform(range(8), lambda b: CAST(-1 AS BIGINT)))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT c, i, role, text FROM turns JOIN ids USING (c) WHERE i > h
  UNION ALL SELECT d.c, i, role, text FROM turns t JOIN ids d ON t.c = d.c - d.k WHERE i <= d.h),
whole AS (
  SELECT c, coalesce(list(struct_pack(r := role, t := text) ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS w
  FROM ids LEFT JOIN rebuilt USING (c) GROUP BY c),
prefixes AS (SELECT c, d, list_slice(w, 1, d) AS p, len(w) = d AS ends FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, p, min(c) AS c, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends) AS names,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[-1].t) END AS saved FROM prefixes GROUP BY d, p),
children AS (SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
sized AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (d, p)),
above AS (SELECT list_slice(p, 1, e) AS p, e AS d, saved, n_children FROM (SELECT p, saved, n_children, unnest(range(0, d + 1)) AS e FROM sized)),
sums AS (SELECT d, p, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY d, p)
SELECT s.c AS conv_id, CAST(s.d AS BIGINT) AS depth, u.c AS parent_conv_id, s.n AS n_convs, s.n_children, m.n_leaves,
  CAST(m.saved AS BIGINT) AS saved_tokens, sha256(coalesce(s.names, '')) AS ends_sha256
FROM sized s JOIN sums m USING (d, p) LEFT JOIN nodes u ON u.d = s.d - 1 AND u.p = list_slice(s.p, 1, s.d - 1)
"""
