"""DuckDB SQL of the corpus operators that SQL can express on the given tables."""
from __future__ import annotations

#: The conversations' repair from the last row to the first: the cheapest edits of the rest for each role before it, cost and
#: audit as one value, so that the least is also the first in ASCII order; then the audit is walked to write the rest.
STRUCTURE_REPAIR = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS UBIGINT)) AS bytes FROM conversations),
drawn AS (SELECT * EXCLUDE (bytes), xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS UBIGINT)) ELSE x // 2 END)), CAST(4294967295 AS UBIGINT)) % 20 AS k FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS odd,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM judged GROUP BY conv_id),
best AS (SELECT conv_id, n + 1 AS i, [{'c': CAST(0 AS BIGINT), 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''}] AS v FROM counted
  UNION ALL SELECT conv_id, i, [list_sort([b[1], {'c': b[3].c + 3, 'a': 'I' || b[3].a}, {'c': b[4].c + 6, 'a': 'II' || b[4].a}])[1], list_sort([b[2], {'c': b[3].c + 3, 'a': 'I' || b[3].a}, {'c': b[4].c + 6, 'a': 'II' || b[4].a}])[1],
      list_sort([b[3], {'c': b[4].c + 3, 'a': 'I' || b[4].a}])[1], list_sort([b[4], {'c': b[3].c + 3, 'a': 'I' || b[3].a}])[1]] FROM (
    SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda s: list_sort(list_filter([{'c': v[s].c + 4, 'a': 'D' || v[s].a},
        CASE WHEN may AND ((c = 's' AND s = 1) OR (c = 'u' AND s <> 3) OR (c = 'a' AND s = 3)) THEN {'c': v[CASE c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c + cut, 'a': 'K' || v[CASE c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a} END,
        CASE WHEN may THEN {'c': v[CASE WHEN s = 3 THEN 4 ELSE 3 END].c + 3 + cut, 'a': 'R' || v[CASE WHEN s = 3 THEN 4 ELSE 3 END].a} END], lambda x: x IS NOT NULL))[1]) AS b FROM (
      SELECT f.conv_id, j.i, f.v, j.c, j.fault NOT IN ('blank', 'duplicate') AS may, CASE WHEN j.fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM best f JOIN judged j ON j.conv_id IS NOT DISTINCT FROM f.conv_id AND j.i = f.i - 1))),
chosen AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM best WHERE i = 1),
walked AS (SELECT conv_id, 0 AS p, CAST(0 AS BIGINT) AS i, '' AS s, CAST([] AS VARCHAR[]) AS made FROM chosen
  UNION ALL SELECT conv_id, p + 1, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN c ELSE left(put, 1) END,
      CASE e WHEN 'D' THEN made WHEN 'K' THEN list_append(made, role || ':' || text) WHEN 'R' THEN list_append(made, put || ':' || text) ELSE list_append(made, put || ':') END FROM (
    SELECT w.*, substr(h.audit, w.p + 1, 1) AS e, CASE WHEN w.s = 'u' THEN 'assistant' ELSE 'user' END AS put, j.role, j.text, j.c FROM walked w JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND w.p < length(h.audit)
      LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1)),
final AS (SELECT w.conv_id, array_to_string(w.made, chr(10)) AS repaired FROM walked w JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND w.p = length(h.audit))
SELECT o.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(h.cost, 0) AS cost,
  coalesce(h.audit, '') AS audit, sha256(coalesce(f.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""

#: Base columns are octets, a digest and the least page of each payload.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to FROM d
"""

#: Shingle sets, all pairs that share a shingle, and the least document reachable.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(a) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS g FROM w),
c AS (SELECT min(doc_id) AS rep, g, len(g) AS n FROM s GROUP BY g),
e AS (SELECT rep, n, unnest(g) AS x FROM c),
k AS (SELECT a.rep AS u, b.rep AS v FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
t AS (SELECT u, v FROM k UNION ALL SELECT v, u FROM k),
r(x, y) AS (SELECT rep, rep FROM c UNION SELECT r.x, t.v FROM r JOIN t ON t.u = r.y),
m AS (SELECT x AS rep, min(y) AS least FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE m.least END AS component_id, s.doc_id = CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE m.least END AS kept FROM s JOIN c ON c.g = s.g JOIN m ON m.rep = c.rep
"""

#: Cosines of all pairs in double precision.
EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL),
g AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
k AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
t AS (SELECT u, v FROM k UNION ALL SELECT v, u FROM k),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, t.v FROM r JOIN t ON t.u = r.y),
m AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM m LEFT JOIN (SELECT u AS vec_id, count(*) AS n FROM t GROUP BY u) n USING (vec_id)
"""

ORACLES = {"op3_warc": WARC, "op4_cap_filters": EMBEDDINGS, "op5_minhash_forest": NEAR_DUPLICATES, "op12_branch_and_bound": STRUCTURE_REPAIR}
