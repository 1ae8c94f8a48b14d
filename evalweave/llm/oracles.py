"""SQL for the queries that SQL can express, written for the results and not for large tables."""

from __future__ import annotations

HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"

OP3 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, {HASH.format("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, source_size * 2 AS most FROM r),
f AS (SELECT *, most::DOUBLE / weight AS fills_at, sum(source_size) OVER () * 1.5::DOUBLE AS asked FROM w),
l AS (SELECT *, (asked - coalesce(sum(most) OVER (ORDER BY fills_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(weight) OVER (ORDER BY fills_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM f),
e AS (SELECT level AS final FROM l WHERE level < fills_at ORDER BY fills_at, rank LIMIT 1),
t AS (SELECT source, source_size, rank, CASE WHEN rank % 2 = 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS slope, CASE WHEN final IS NULL OR fills_at <= final THEN most::DOUBLE ELSE weight * final END AS target FROM l LEFT JOIN e ON true),
m AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle FROM d)
SELECT doc_id, size, source_size, target, (size * ((middle < target)::INT + (middle + source_size < target)::INT))::BIGINT AS taken,
  CASE WHEN size > 0 AND middle < target THEN (sqrt((1::DOUBLE - slope) * (1::DOUBLE - slope) + 4::DOUBLE * slope * (middle / target)) - (1::DOUBLE - slope)) / (2::DOUBLE * slope) END AS position
FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source
"""

#: Rows by cell; each shard keeps an even part of what is over its capacity, the rest goes to rooms in ring order.
OP4 = f"""
WITH k AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) x(i))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
  xor(4294967295, list_reduce(list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i::INT + 1, 2))::BIGINT),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295))::BIGINT AS text_crc32, {HASH.format("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents, k),
p AS (SELECT i // 64 AS shard, i % 64 AS vnode, {HASH.format("'point|' || i // 64 || '|' || i % 64")} AS ph FROM range(2560) x(i)),
q AS (SELECT *, row_number() OVER (ORDER BY ph >> 18, ph, shard, vnode) - 1 AS place FROM p),
c AS (SELECT cell, coalesce((SELECT min(place) FROM q WHERE (ph >> 18) >= cell), 0) AS place, n FROM (SELECT h >> 18 AS cell, count(*) AS n FROM d GROUP BY 1)),
o AS (SELECT cell, c.place, shard, n, sum(n) OVER (PARTITION BY shard) AS load, sum(n) OVER (PARTITION BY shard ORDER BY cell) - n AS before FROM c JOIN q ON c.place = q.place),
a AS (SELECT shard, (SELECT count(*) FROM documents) // 40 + (shard < (SELECT count(*) FROM documents) % 40)::INT AS cap, coalesce((SELECT sum(n) FROM o WHERE o.shard = s.shard), 0) AS load FROM range(40) s(shard)),
g AS (SELECT o.*, cap, CASE WHEN o.load > cap THEN before * cap // o.load ELSE before END AS kept_before, n - CASE WHEN o.load > cap THEN (before + n) * cap // o.load - before * cap // o.load ELSE n END AS over FROM o JOIN a USING (shard)),
v AS (SELECT q.*, a.load + CASE WHEN a.load < cap THEN (cap - a.load) * vnode // 64 ELSE 0 END AS to_slot, CASE WHEN a.load < cap THEN (cap - a.load) * (vnode + 1) // 64 - (cap - a.load) * vnode // 64 ELSE 0 END AS room FROM q JOIN a USING (shard)),
e AS (SELECT cell AS x, 0 AS kind, -1 AS place, cell, over, 0 AS room FROM g UNION ALL SELECT ph >> 18, 1, place, NULL, 0, room FROM v),
f AS (SELECT *, sum(over) OVER w AS os, sum(room) OVER w AS rs, row_number() OVER w AS pos, sum(over) OVER () AS t FROM e WINDOW w AS (ORDER BY x, kind, place ROWS UNBOUNDED PRECEDING)),
z AS (SELECT os AS oc, rs AS rc FROM f ORDER BY os - rs, pos LIMIT 1),
qo AS (SELECT cell, ((os - over - oc) % t + t) % t AS q_over FROM f, z WHERE kind = 0 AND over > 0),
qr AS (SELECT f.place, ((rs - f.room - rc) % t + t) % t AS q_room, v.shard, v.to_slot, v.room FROM f, z, v WHERE kind = 1 AND f.room > 0 AND v.place = f.place),
r AS (SELECT d.*, g.shard, g.cap, g.load, g.before, g.kept_before, g.cell, g.before + row_number() OVER (PARTITION BY g.cell ORDER BY h, doc_id, size, text_crc32) - 1 AS r FROM d JOIN g ON d.h >> 18 = g.cell),
y AS (SELECT *, CASE WHEN load > cap THEN r * cap // load ELSE r END AS below, load <= cap OR (r + 1) * cap // load > r * cap // load AS stays FROM r),
m AS (SELECT y.*, q_over + (r - below) - (before - kept_before) AS q FROM y LEFT JOIN qo ON y.cell = qo.cell)
SELECT doc_id, size, text_crc32, 'rows' AS law, CASE WHEN stays THEN m.shard ELSE qr.shard END::INT AS shard, CASE WHEN stays THEN below ELSE to_slot + q - q_room END::BIGINT AS slot, NULL::INT AS grown_shard
FROM m LEFT JOIN qr ON NOT stays AND q >= q_room AND q < q_room + qr.room
"""

OP8 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS v FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_hold FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_hold >= 85 * (na.n + nb.n - both_hold)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT c.id, e.b FROM c JOIN e ON e.a = c.root)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, n.doc_id = min(root) AS kept FROM n JOIN c ON c.id = n.doc_id GROUP BY n.doc_id, n.n
"""

OP11 = OP8.replace(">= 85 *", ">= 90 *").replace(", n.doc_id = min(root) AS kept", "")

ROUND = """m{r} AS MATERIALIZED (SELECT vec_id, p.part, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 16 + entry) AS k FROM p JOIN c{r} c ON p.part = c.part GROUP BY ALL),
"""
MOVE = """n{r} AS (SELECT part, k % 16 AS entry, i, floor(sum(x[i + 1])::DOUBLE / count(*))::BIGINT AS y FROM m{q} JOIN p USING (vec_id, part), unnest(range(len(x))) u(i) GROUP BY ALL),
c{r} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(any_value(l.y), any_value(c.c)) AS c FROM c{q} c LEFT JOIN (SELECT part, entry, list(y ORDER BY i) AS y FROM n{r} GROUP BY ALL) l USING (part, entry) GROUP BY c.part, c.entry),
"""
OP12 = (
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, r.part, q[r.part * (len(q) // 8) + 1:(r.part + 1) * (len(q) // 8)] AS x FROM v, range(8) r(part)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 16),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN s USING (vec_id)),
"""
    + "".join(ROUND.format(r=r - 1) + MOVE.format(r=r, q=r - 1) for r in range(1, 7))
    + ROUND.format(r=6)
    + """o AS (SELECT vec_id, string_agg(printf('%02x', (k % 16)::INT), '' ORDER BY part) AS code, sum(k // 16)::BIGINT AS error FROM m6 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c6) AS codebooks_sha256 FROM o JOIN v USING (vec_id)
"""
)

OP13 = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t), regexp_matches(t, '[#$%&*|]'),
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM d),
c AS (SELECT part, f, count(*) AS n, count_if(quality = 1) AS good, count_if(toxic = 1) AS toxic, len(list_filter(f, lambda x: x)) AS fails FROM m LEFT JOIN labels USING (doc_id) GROUP BY part, f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
z AS (SELECT c.*, filter_order, step, f[strpos('ABCDE', filter_order[step])] AS x, len(list_filter(range(1, step), lambda j: f[strpos('ABCDE', filter_order[j])])) > 0 AS earlier FROM c, o, range(1, 6) s(step))
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT x AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (x AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (x AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (x AND fails = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (x AND NOT earlier), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (x AND NOT earlier), 0)::BIGINT AS toxic_lost, coalesce(sum(n * 120 // greatest(fails, 1)) FILTER (x), 0)::BIGINT AS shapley
FROM z GROUP BY part, filter_order, step
"""

ORACLES = {"op3_curriculum": OP3, "op4_ring_shards": OP4, "op8_near_dedup": OP8, "op11_fragment_join": OP11, "op12_vector_codes": OP12, "op13_filter_audit": OP13}
