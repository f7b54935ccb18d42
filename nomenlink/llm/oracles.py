"""DuckDB SQL for the queries whose results SQL can state on tables of moderate size."""

from __future__ import annotations

from . import cover_tree, suffix_dedup, weighted_minhash

COVER_TREE = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) = (SELECT mode(len(embedding)) FROM embeddings)
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
norms AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM usable),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM norms a JOIN norms b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {cover_tree.THRESHOLD}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN degree ON degree.a = vec_id JOIN least ON least.a = vec_id
"""

_W = suffix_dedup.WIDTH
SUFFIX_DEDUP = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
sized AS (SELECT *, length(hx) // 2 AS n FROM docs),
strings AS (
  SELECT r, pos, md5(substr(hx, 2 * pos + 1, {2 * _W})) AS s
  FROM (SELECT r, hx, unnest(range(0, n - {_W} + 1)) AS pos FROM sized WHERE n >= {_W})),
again AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
starts AS (SELECT r, pos FROM strings SEMI JOIN again USING (s)),
marked AS (
  SELECT r, pos, pos > coalesce(max(pos) OVER (
    PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -{_W} - 1) + {_W} AS fresh
  FROM starts),
numbered AS (
  SELECT r, pos, sum(fresh::INT) OVER (PARTITION BY r ORDER BY pos) AS k FROM marked),
spans AS (SELECT r, k, min(pos) AS a, max(pos) + {_W} AS b FROM numbered GROUP BY r, k),
pieces AS (
  SELECT r, k, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY k) AS low, a AS high, b FROM spans),
per_text AS (
  SELECT p.r, count(*) AS n_spans, sum(b - high) AS n_removed,
    string_agg(substr(hx, 2 * low + 1, 2 * (high - low)), '' ORDER BY k) AS before, max(b) AS last
  FROM pieces p JOIN sized USING (r) GROUP BY p.r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(before || substr(hx, 2 * last + 1), hx))) AS kept_sha256
FROM sized LEFT JOIN per_text USING (r)
"""

_RARE, _TABLE = weighted_minhash.RARE, weighted_minhash.TABLE_WORDS
_SHINGLE = weighted_minhash.SHINGLE
WEIGHTED_MINHASH = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w
  FROM documents),
texts AS (
  SELECT row_number() OVER () AS t, w FROM (SELECT DISTINCT w FROM docs WHERE len(w) > 0)),
frequency AS (
  SELECT word, count(*) AS df FROM (
    SELECT unnest(list_distinct(w)) AS word FROM docs) GROUP BY word),
totals AS (
  SELECT n, greatest(n / {_RARE}.0, (SELECT sum(df) FROM frequency) / {_TABLE}.0, 1.0) AS floor
  FROM (SELECT count(*) AS n FROM docs WHERE len(w) > 0)),
idf AS (SELECT word, ln(1 + n / greatest(df, floor)) AS idf FROM frequency, totals),
places AS (SELECT t, unnest(w) AS word, unnest(range(len(w))) AS pos FROM texts),
weighed AS (
  SELECT t, pos, word, idf FROM places JOIN idf USING (word)),
runs AS (
  SELECT t, pos, string_agg(word, ' ') OVER run AS shingle,
    sum(idf) OVER run / count(*) OVER run AS weight, count(*) OVER run AS k,
    count(*) OVER (PARTITION BY t) AS n
  FROM weighed
  WINDOW run AS (PARTITION BY t ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_SHINGLE - 1} FOLLOWING)),
sets AS (
  SELECT t, shingle, sum(weight) AS weight FROM runs
  WHERE k = {_SHINGLE} OR (n < {_SHINGLE} AND pos = 0) GROUP BY t, shingle),
sizes AS (SELECT t, sum(weight) AS total FROM sets GROUP BY t),
common AS (
  SELECT a.t AS a, b.t AS b, sum(least(a.weight, b.weight)) AS c
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.t <> b.t GROUP BY a.t, b.t),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b
  WHERE c / (x.total + y.total - c) >= {weighted_minhash.THRESHOLD} - 1e-9),
reach AS (
  SELECT t AS a, t AS b FROM texts
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
part AS (SELECT a AS t, min(b) AS p FROM reach GROUP BY a),
placed AS (SELECT doc_id, p FROM docs JOIN texts USING (w) JOIN part USING (t)),
named AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY p) AS class_id FROM placed)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM named
UNION ALL SELECT doc_id, doc_id, true FROM docs WHERE len(w) = 0
"""

# The values of CRC-32 per byte are computed, not listed. Gives ``crc`` of the id as text.
_CRC = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crcs),
hashed AS (
  SELECT documents.*, xor(4294967295, list_reduce(
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda c, b: xor(c // 256, crcs[CAST(xor(c, b) % 256 AS INT) + 1]), 4294967295)) AS crc
  FROM documents, crc_table),"""
MERKLE_MANIFEST = (
    "WITH RECURSIVE "
    + _CRC
    + """
framed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, crc,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id::VARCHAR, '-')
      || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
      || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars::VARCHAR, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
    coalesce(octet_length(encode(text)) || ':'
      || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low
  FROM hashed),
signed AS (
  SELECT doc_id, tree, sha256(head || body) AS leaf,
    sha256(head || CASE WHEN crc % 3 = 0 THEN low ELSE body END) AS claim FROM framed),
leaves AS (
  SELECT *, row_number() OVER () AS r, count(*) OVER (PARTITION BY tree) AS n,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM signed),
lower_nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM lower_nodes WHERE n > 1 GROUP BY tree, level, pos // 8, n),
subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
  FROM lower_nodes WHERE n = 1),
upper_nodes AS (
  SELECT 1000 AS level, pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 8, n),
nodes AS (
  SELECT tree, level, pos, digest FROM lower_nodes WHERE n > 1
  UNION ALL SELECT NULL, level, pos, digest FROM upper_nodes WHERE n > 1),
sides AS (
  SELECT a.tree, a.level, a.pos,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM nodes a JOIN nodes b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level
    AND a.pos // 8 = b.pos // 8
  GROUP BY a.tree, a.level, a.pos),
steps AS (
  SELECT r, level, before, after FROM leaves l JOIN sides s
    ON s.tree = l.tree AND s.pos = l.pos // CAST(8 ** s.level AS BIGINT)
  UNION ALL
  SELECT r, level, before, after FROM leaves l JOIN subroots t ON t.tree = l.tree JOIN sides s
    ON s.tree IS NULL AND s.pos = t.pos // CAST(8 ** (s.level - 1000) AS BIGINT)),
proofs AS (
  SELECT r, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256,
    list(before || '|' || after ORDER BY level) AS path
  FROM steps GROUP BY r),
folded AS (
  SELECT l.doc_id, l.leaf, t.digest AS subroot, u.digest AS root,
    coalesce(proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(coalesce(path, []), lambda c, s:
      sha256(split_part(s, '|', 1) || c || split_part(s, '|', 2)), l.claim) AS folded_root
  FROM leaves l JOIN subroots t USING (tree) JOIN upper_nodes u ON u.n = 1
  LEFT JOIN proofs USING (r))
SELECT *, folded_root = root AS verified FROM folded
"""
)

_NEAREST = """
near{i} AS (
  SELECT r, p, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT r, p, k, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS d
    FROM pieces x JOIN books{i} b USING (p)) GROUP BY r, p),"""
_MOVED = """
books{j} AS (
  SELECT p, k, coalesce(m.v, b.v) AS v FROM books{i} b LEFT JOIN (
    SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT p, k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM near{i} JOIN pieces USING (r, p)) GROUP BY p, k, i)
    GROUP BY p, k) m USING (p, k)),"""
# 16 parts, 64 entries, two rounds, as the task states them.
CODE_COMPRESSION = (
    """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = (SELECT mode(len(embedding)) FROM embeddings)
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (
  SELECT r, p, list_slice(q, p * w + 1, p * w + w) AS v
  FROM (SELECT r, q, len(q) // 16 AS w, unnest(range(16)) AS p FROM usable)),
books0 AS (
  SELECT p, k, v FROM pieces JOIN (
    SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM usable) USING (r) WHERE k < 64),"""
    + _NEAREST.format(i=0) + _MOVED.format(i=0, j=1)
    + _NEAREST.format(i=1) + _MOVED.format(i=1, j=2)
    + _NEAREST.format(i=2)
    + """
coded AS (
  SELECT r, lower(string_agg(printf('%02x', k), '' ORDER BY p)) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near2 GROUP BY r),
named AS (SELECT vec_id, label, code, error FROM coded JOIN usable USING (r)),
hashed AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM books2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  codebooks_sha256 FROM named, hashed
"""
)

# Profiles of 400 n-grams of one to three characters.
RANK_PROFILES = (
    "WITH "
    + _CRC
    + r"""
words AS (
  SELECT r, ' ' || unnest(regexp_extract_all(lower(text), '\p{L}[\p{L}\p{M}]*')) || ' ' AS w
  FROM (SELECT row_number() OVER () AS r, * FROM hashed)),
rows AS (SELECT row_number() OVER () AS r, doc_id, lang, crc FROM hashed),
cut AS (SELECT r, substr(w, i, k) AS g FROM (
    SELECT r, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k))
  WHERE substr(w, i, k) <> ' '),
counts AS (SELECT r, g, count(*) AS n FROM cut GROUP BY r, g),
own AS (
  SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, length(g), g) - 1 AS place
  FROM counts QUALIFY place < 400),
learned AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS place
  FROM counts JOIN rows USING (r) WHERE lang IS NOT NULL AND crc % 4 <> 2 GROUP BY lang, g
  QUALIFY place < 400),
away AS (
  SELECT r, l.lang, sum(coalesce(abs(p.place - own.place), 400)) AS d
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM learned) l
  LEFT JOIN learned p ON p.lang = l.lang AND p.g = own.g GROUP BY r, l.lang),
best AS (
  SELECT r, arg_min(lang, (d, lang)) AS lang_pred, list(CAST(d AS DOUBLE) ORDER BY d) AS ds FROM away GROUP BY r)
SELECT doc_id, coalesce(crc % 4 = 2, false) AS held_out, coalesce(lang_pred, 'und') AS lang_pred,
  CASE WHEN lang_pred IS NULL THEN 0.0::DOUBLE WHEN len(ds) = 1 THEN 1.0::DOUBLE WHEN ds[2] = 0 THEN 0.0::DOUBLE
    ELSE floor((1 - ds[1] / ds[2]) * 1e6 + 0.5) / 1e6 END AS score
FROM rows LEFT JOIN best USING (r)
"""
)
