"""SQL texts that the corpus queries must equal, where SQL can say them on whole tables."""

TRIE = """
WITH own AS (
  SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x.role, x.said) AS turns
  FROM (SELECT conv_id, turn, {'role': coalesce(role, ''), 'said': coalesce(text, '')} AS x
        FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
crc AS (
  SELECT conv_id, turns, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 9 AS h
  FROM own),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (
  SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '') AS ends
  FROM prefixes GROUP BY ALL),
children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
marked AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.path[n.depth].said) END AS saved
  FROM nodes n LEFT JOIN children c USING (path)),
above AS (
  SELECT path[1:d] AS path, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM marked) GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children,
       a.leaves AS n_leaves, a.saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM marked m JOIN above a USING (path)
LEFT JOIN marked p ON m.depth > 0 AND p.path = m.path[1:m.depth - 1]
"""

LEAKS = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM phrase),
place AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS p
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc CROSS JOIN sizes WHERE len(w) >= size)),
met AS (SELECT r, i, size, item_id FROM place JOIN phrase USING (size, p)),
hit AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS j FROM met) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

PHRASES = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
  FROM documents),
uni AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM piece) GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM uni GROUP BY lang),
bi AS (
  SELECT lang, w1, w2, count(*) AS f FROM (
    SELECT lang, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM piece)) GROUP BY ALL),
tri AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM (
    SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM piece))
  GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (
    SELECT lang, w1, w2, f FROM tri UNION ALL SELECT lang, w2, w3, f FROM tri) GROUP BY ALL),
cuts AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM bi b JOIN uni x ON x.lang = b.lang AND x.w = b.w1 JOIN uni y ON y.lang = b.lang AND y.w = b.w2
  LEFT JOIN longer g ON g.lang = b.lang AND g.w1 = b.w1 AND g.w2 = b.w2
  WHERE b.f >= 10 AND NOT coalesce(100 * g.f >= 50 * b.f, FALSE)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 1
  FROM tri t JOIN uni x ON x.lang = t.lang AND x.w = t.w1 JOIN bi y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, x.f, y.f, 2
  FROM tri t JOIN bi x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN uni y ON y.lang = t.lang AND y.w = t.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
