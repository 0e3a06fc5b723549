"""DuckDB SQL for the contract queries that SQL can express."""

from . import license_scan

OP4 = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix'), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS fills_at,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS emptier,
             (sum(source_size) OVER ()) * 150 / 100.0::DOUBLE AS total FROM w),
l AS (SELECT *, (total - filled) / emptier AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN water IS NULL OR fills_at <= water THEN cap ELSE weight * water END AS target
      FROM l, (SELECT min_by(level, fills_at) FILTER (level < fills_at) AS water FROM l)),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS rounds FROM t),
b AS (SELECT *, floor(target + 0.5)::BIGINT - rounds * source_size AS budget FROM g),
c AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
r AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM c)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * b.rounds + CASE WHEN r.upto <= b.budget THEN d.size WHEN r.upto - r.words < b.budget THEN floor(d.size::DOUBLE * (b.budget - r.upto + r.words) / r.words) ELSE 0 END)::BIGINT AS taken, d.source
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h
"""

OP5 = """
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
marked AS (SELECT *, length(role) - length(replace(replace(replace(role, '\\', ''), '<', ''), '>', '')) + length(text) - length(replace(replace(replace(text, '\\', ''), '<', ''), '>', '')) AS escapes FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + escapes + 16)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP6 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, edge.y FROM reach JOIN edge ON reach.b = edge.x),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
many AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT m.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, m.vec_id) AS component_id, coalesce(c, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN least ON least.a = m.vec_id LEFT JOIN many ON many.x = m.vec_id
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

OP11 = """
WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS place, md5(length(role) || ':' || role || text) AS m, strlen(text) AS size
           FROM (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
b AS (SELECT conv_id, count(*) AS n, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT) AS bytes FROM r GROUP BY conv_id),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS source, xor(list_reduce(bytes, lambda crc, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(crc, x)), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h FROM b),
p AS (SELECT c.conv_id, c.source, c.h, least(c.h, coalesce(s.n, 0)) AS head FROM c LEFT JOIN c s ON s.conv_id = c.source),
t AS (SELECT p.conv_id, place AS depth, m, size FROM p JOIN r ON r.conv_id = source AND place <= head UNION ALL SELECT p.conv_id, place - h + head, m, size FROM p JOIN r ON r.conv_id = p.conv_id AND place > h),
y AS (SELECT conv_id, depth, size, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM t UNION ALL SELECT conv_id, 0, 0, '' FROM p),
e AS (SELECT conv_id, max(depth) AS last FROM y GROUP BY conv_id),
n AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256 FROM y JOIN e USING (conv_id) GROUP BY path),
k AS (SELECT left(path, 32 * (depth - 1)::INT) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path),
u AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved FROM f a JOIN f b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT f.conv_id, f.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u ON u.path = f.path LEFT JOIN f o ON f.depth > 0 AND o.path = left(f.path, 32 * (f.depth - 1)::INT)
"""

OP12 = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM x)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""

_strings = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
phrases(label, words) AS (VALUES {", ".join(f"('{label}', {_strings(p.split())})" for p, label in license_scan.PHRASES)}),
place AS (SELECT row, label, i FROM (SELECT row, w, unnest(range(len(w))) AS i FROM d) x JOIN phrases p ON w[i + 1] = p.words[1] AND w[i + 1:i + len(p.words)] = p.words),
base AS (SELECT row, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY row),
sections(label, words) AS (VALUES {", ".join(f"('{label}', {_strings(ws)})" for label, ws in license_scan.sections(license_scan.TEMPLATES))}),
block AS (SELECT row, list_distinct(w[{license_scan.STRIDE} * k + 1:{license_scan.STRIDE} * k + {license_scan.WINDOW}]) AS words FROM (SELECT row, w, unnest(range(greatest(ceil((len(w) - {license_scan.WINDOW}) / {license_scan.STRIDE}.0), 0)::BIGINT + 1)) AS k FROM d)),
met AS (SELECT row, label, len(list_intersect(b.words, s.words)) AS shared, len(s.words) AS n FROM block b JOIN sections s ON 100 * len(list_intersect(b.words, s.words)) >= {license_scan.PERCENT} * len(s.words)),
own AS (SELECT row, max(shared::DOUBLE / n) AS most, list(DISTINCT label) AS labels FROM met GROUP BY row)
SELECT doc_id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels, CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(most, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base ON base.row = d.row LEFT JOIN own ON own.row = d.row
"""

ORACLES = {"op4_mixing": OP4, "op5_chat_format": OP5, "op6_near_duplicates": OP6, "op7_embedding_duplicates": OP7, "op10_topk_search": OP10, "op11_prefix_trie": OP11, "op12_source_divergence": OP12, "op13_license_scan": OP13}
