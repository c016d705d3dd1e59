"""DuckDB SQL of the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER.format('coalesce(text, ' + repr('') + ')')}, '[\x20\t\n\v\f\r]+'), lambda w: w <> '')"

_TOKENS = r"string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The masks of the spaced seeds as places from 0.
_MASK_PLACES = "[0,1,2,4,6,7,10], [0,1,3,6,7,8,10], [0,2,3,5,8,9,10]"

SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, unhex(sha1(b))::BIT::VARCHAR AS bits FROM p),
e AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)))::BIGINT, 1)),
      'string_agg', '') AS payload_digest
  FROM d),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to, TRUE AS verified
FROM f""",
    "op2_decontamination": f"""
WITH items AS MATERIALIZED (
  SELECT min(item_id) AS item_id, w, len(w) AS n FROM (SELECT item_id, list_filter({_TOKENS}, lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) >= 8 GROUP BY w),
masks AS (SELECT unnest([{_MASK_PLACES}]) AS mask, 11 AS span UNION ALL SELECT range(n), n FROM (SELECT DISTINCT n FROM items WHERE n < 11)),
item_seeds AS (
  SELECT item_id, w, n, mask, p, list_transform(mask, lambda i: w[1 + p + i]) AS seed
  FROM (SELECT i.*, m.mask, unnest(range(n - span + 1)) AS p FROM items i JOIN masks m ON CASE WHEN n < 11 THEN span = n ELSE span = 11 END)),
windows AS MATERIALIZED (
  SELECT mask, seed, p - f AS back, w[f + 1 : f + least(20, n)] AS win, min(item_id) AS item_id
  FROM (SELECT *, least(greatest(p - 4, 0), n - least(20, n)) AS f FROM item_seeds) GROUP BY ALL),
docs AS MATERIALIZED (SELECT doc_id, {_TOKENS} AS w FROM documents),
hits AS (
  SELECT d.doc_id, d.w, x.p, x.mask, list_transform(x.mask, lambda i: d.w[1 + x.p + i]) AS seed
  FROM (SELECT doc_id, mask, unnest(range(len(w) - span + 1)) AS p FROM docs, masks WHERE len(w) >= span) x JOIN docs d USING (doc_id)),
checked AS (
  SELECT doc_id, item_id, p - back AS first_token,
    list_sum(list_transform(range(1, len(win) + 1), lambda i: CAST(win[i] = h.w[p - back + i] AS INTEGER))) / len(win) AS overlap
  FROM hits h JOIN windows v ON h.mask = v.mask AND h.seed = v.seed
  WHERE p - back >= 0 AND p - back + len(win) <= len(h.w))
SELECT doc_id, item_id, count(DISTINCT first_token) AS n_windows, min(first_token) AS first_token, round(max(overlap), 6) AS overlap
FROM checked WHERE overlap >= 0.8 GROUP BY doc_id, item_id""",
    "op8_partenum_join": rf"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
classes AS MATERIALIZED (SELECT min(doc_id) AS c, list_sort(s) AS s, list(doc_id) AS ids FROM sets GROUP BY 2),
items AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS e FROM classes),
pairs AS MATERIALIZED (
  SELECT a.c AS x, b.c AS y FROM items a JOIN items b ON a.e = b.e AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(x, y) AS (
  SELECT c, c FROM classes UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
roots AS (SELECT x AS c, min(y) AS root FROM reach GROUP BY x),
members AS (SELECT c, len(s) AS n, unnest(ids) AS doc_id FROM classes)
SELECT m.doc_id, m.n AS n_shingles, CASE WHEN m.n = 0 THEN m.doc_id ELSE r.root END AS component_id
FROM members m JOIN roots r USING (c)""",
    "op11_wavelet_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
    list_transform(range(4), lambda i: ('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8))::BIGINT) AS h FROM d),
c AS (SELECT *, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b FROM u),
f AS (
  SELECT doc_id, t, n, array_to_string(w[:a], '') AS p, array_to_string(w[a + 1 : b], '') AS m, array_to_string(w[b + 1 :], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f""",
    "op12_rotated_codes": """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, q.x AS x, c.vec_id AS vec_id, list_cosine_similarity(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op13_hybrid_search": rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format('text')}, '{_TERM}') AS w FROM documents WHERE text IS NOT NULL),
sizes AS MATERIALIZED (SELECT r, doc_id, len(w) AS n FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
items AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
asked AS MATERIALIZED (
  SELECT i, item_id, term, count(*)::BIGINT AS repeats
  FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERM}')) AS term FROM items) GROUP BY ALL),
tf AS MATERIALIZED (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs),
scores AS (
  SELECT i, item_id, doc_id, sum(w * repeats * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (r), totals GROUP BY i, item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20""",
}
