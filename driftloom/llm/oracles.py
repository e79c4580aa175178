"""DuckDB SQL for the corpus queries that SQL can express.

The language, quality and language-model scores, the vote weights, the packing plan and quotation parsing have no SQL;
tests hold those against brute force or held-out accuracy.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The smallest member that each node of `edges` (both directions) reaches.
_REACH = """reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"""

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 9))::BIGINT AS cell
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1])::DOUBLE AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS nth FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(size) FROM d)
      - coalesce(sum(2::DOUBLE * source_size) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM o),
t AS (
  SELECT source, source_size, least(2::DOUBLE * source_size,
    weight * coalesce((SELECT min_by(level, nth) FROM l WHERE 2 * source_size > weight * level), 0)) AS target
  FROM w),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
bars AS (
  SELECT source, cell, own, sum(own) OVER (PARTITION BY source ORDER BY cell) AS upto
  FROM (SELECT source, cell, sum(size) AS own FROM d GROUP BY source, cell)),
edge AS (
  SELECT p.source, min_by(cell + CASE WHEN upto - (target - copies * source_size) <= (target - copies * source_size) - (upto - own) THEN 1 ELSE 0 END, cell) AS threshold
  FROM p JOIN bars ON p.source IS NOT DISTINCT FROM bars.source
  WHERE target - copies * source_size > 0 AND upto >= target - copies * source_size GROUP BY p.source)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN cell < threshold THEN 1 ELSE 0 END))::BIGINT AS taken, d.source
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN edge ON d.source IS NOT DISTINCT FROM edge.source
"""

VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding::DOUBLE[], lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
edges AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
  WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
{_REACH},
n AS (SELECT a, count(*) AS k FROM edges GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings x LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM w SEMI JOIN again ON w.h = again.h),
gaps AS (SELECT r, list(k) AS ks FROM gone GROUP BY r),
words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone ON words.r = gone.r AND words.k = gone.k GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gaps ON d.r = gaps.r LEFT JOIN kept ON d.r = kept.r
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS grams FROM d),
x AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
edges AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM x p JOIN x q ON p.gram = q.gram AND p.doc_id <> q.doc_id
    AND p.n >= 0.8 * q.n - 0.001 AND q.n >= 0.8 * p.n - 0.001
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 10 * count(*) >= 8 * (p.n + q.n - count(*))),
{_REACH},
n AS (SELECT a, count(*) AS k FROM edges GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(k, 0)::BIGINT AS n_links, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN n ON n.a = doc_id LEFT JOIN least ON least.a = doc_id
"""
