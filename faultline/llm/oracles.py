"""SQL that gives the same rows as the queries, where SQL can express them."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_JOIN = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
grams AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT rid, doc_id AS low FROM docs UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.rid JOIN docs d ON d.rid = l.b WHERE r.low < d.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, low AS component_id
FROM docs LEFT JOIN sizes USING (rid) JOIN (SELECT rid, min(low) AS low FROM reach GROUP BY rid) USING (rid)"""

SUBSTRING_DEDUP = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE low < doc_id),
words AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM docs),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (rid)"""

DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
wanted AS (SELECT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM items WHERE len(ws) > 0)),
hit AS (SELECT DISTINCT rid, i, d.n, item_id FROM (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
    FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wanted) WHERE len(ws) >= n)) d JOIN wanted USING (n, w)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""

HARD_NEGATIVES = """
WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM pairs WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 5"""

# the standard CRC-32 (polynomial EDB88320), bit by bit over the bytes of a decimal number
CRC32 = """xor(list_reduce(list_transform(range(8 * len({0})), lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(substr({0}, i // 8 + 1, 1)) AS BIGINT) ELSE 0 END),
  lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) % 2)), 4294967295), 4294967295)"""

PREFIX_TRIE = f"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS base, {CRC32.format("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM turns)),
built AS (SELECT v.c, 0 AS part, t.pos, role, text FROM convs v JOIN turns t ON t.c = base AND pos < h UNION ALL SELECT v.c, 1, t.pos, role, text FROM convs v JOIN turns t ON t.c = v.c AND pos >= h),
placed AS (SELECT c, row_number() OVER w AS depth, len(text) AS n_chars, list(struct_pack(role, text)) OVER w AS path, count(*) OVER (PARTITION BY c) AS n FROM built WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
paths AS (SELECT c, depth, n_chars, path, depth = n AS last FROM placed UNION ALL SELECT c, 0, 0, [], NOT EXISTS (FROM built b WHERE b.c = v.c) FROM convs v),
named AS (SELECT *, min(c) OVER (PARTITION BY path) AS conv_id, count(*) OVER (PARTITION BY path) AS n_convs FROM paths),
ends AS (SELECT conv_id, depth, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM named WHERE last GROUP BY ALL),
nodes AS (SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_chars FROM named n LEFT JOIN named p ON p.c = n.c AND p.depth = n.depth - 1 WHERE n.c = n.conv_id),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (conv_id, depth)),
totals AS (SELECT a.conv_id, a.depth, count(*) FILTER (x.n_children = 0) AS n_leaves, CAST(sum((x.n_convs - 1) * x.n_chars) AS BIGINT) AS saved_tokens
  FROM full_nodes x JOIN named a ON a.c = x.conv_id AND a.depth <= x.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes JOIN totals USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)"""

WARC = """
WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM rows)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > low THEN low END AS refers_to FROM firsts"""
