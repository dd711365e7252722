"""DuckDB SQL for the operators that SQL can express over whole tables.

The recursive parts follow links from every id to the ids it reaches, in rounds.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest id reachable from each id over the rows of ``links (x, y)``, both ways.
_COMPONENT = """
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS id, x AS other FROM both_ways UNION SELECT r.id, b.y FROM reach r JOIN both_ways b ON r.other = b.x),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

OP2 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM words),
elements AS (SELECT doc_id, unnest(sh) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM elements a JOIN elements b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * c >= 85 * (len(a.sh) + len(b.sh) - c)),
{_COMPONENT}
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN component c ON c.id = s.doc_id
"""

OP4 = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS p FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM words, sizes WHERE len(ws) >= n)),
found AS (SELECT doc_id, item_id, p, g.n FROM grams g JOIN windows w ON g.g = w.g AND g.n = w.n),
hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM words w LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS good FROM embeddings),
usable AS (SELECT vec_id, v FROM vectors WHERE good),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
{_COMPONENT},
direct AS (SELECT x AS id, count(*) AS n FROM both_ways GROUP BY x)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id,
  v.vec_id = coalesce(c.component_id, v.vec_id) AS kept
FROM vectors v LEFT JOIN direct d ON d.id = v.vec_id LEFT JOIN component c ON c.id = v.vec_id
"""

ORACLES = {"op2_minhash_near_dedup": OP2, "op4_benchmark_decontamination": OP4, "op6_embedding_near_dedup": OP6}

#: Operator 13. Hashes and blocks play no part: every pair of sources over every kept term.
OP13 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
places AS (SELECT row_id, lang, source, unnest(words) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM places GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
groups AS (SELECT DISTINCT lang, source FROM texts),
cells AS (
  SELECT g.lang, g.source, k.term, k.n AS n_lang, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM places GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n,
    1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER w + 5 * count(*) OVER w) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (n_lang + 5) // (sum(n_lang) OVER w + 5 * count(*) OVER w) AS q
  FROM cells WINDOW w AS (PARTITION BY lang, source)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) u)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES["op13_source_divergence"] = OP13
