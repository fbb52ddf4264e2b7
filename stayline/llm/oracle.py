"""DuckDB SQL for the registered queries of this folder that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_LETTERS = ", ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"CAST((('0x' || substr(h, {i + 1}, 5))::BIGINT >> {shift}) & 31 AS BIGINT) + 1, 1)"
    for i in range(0, 40, 5)
    for shift in (15, 10, 5, 0)
)

ORACLE["op1_warc"] = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
         concat({_LETTERS}) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       CASE WHEN page_id = first THEN true END AS checked
FROM d
"""

_WORDS = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')," \
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE["op4_decontaminate"] = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
w AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM w),
d AS (SELECT doc_id, {_WORDS.format('text')} AS t FROM documents),
places AS (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS s FROM d, lengths WHERE len(t) >= n),
hits AS (
  SELECT doc_id, s, p.n, item FROM (
    SELECT doc_id, s, n, array_to_string(t[s : s + n - 1], ' ') AS win FROM places) p
  JOIN w ON w.n = p.n AND w.win = p.win),
words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op6_mix"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS place,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, CAST(source_size AS HUGEINT) * 4 AS full_,
         sum(CAST(source_size AS HUGEINT)) OVER () * 3
           - coalesce(sum(CAST(source_size AS HUGEINT) * 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)),
f AS (SELECT *, full_ * rest_ < left_ * weight AS is_full FROM o),
g AS (SELECT left_ AS open_left, rest_ AS open_rest FROM f WHERE NOT is_full ORDER BY rest_ DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN source_size * CAST(2 AS DOUBLE)
         ELSE CAST(weight AS DOUBLE) * CAST(open_left AS DOUBLE) / (CAST(open_rest AS DOUBLE) * 2) END AS target
  FROM f LEFT JOIN g ON true),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
u AS (
  SELECT d.source, d.place, CAST(sum(d.size) AS BIGINT) AS unit,
         row_number() OVER (PARTITION BY d.source ORDER BY d.place) AS i FROM d GROUP BY d.source, d.place),
-- One place after the other: `room` is what is left, `most` what was left when the turn began.
walk(source, i, place, more, room, most, target, done) AS (
  SELECT source, CAST(0 AS BIGINT), '', false, CAST(floor(target - copies * source_size) AS HUGEINT),
         CAST(floor(target - copies * source_size) AS HUGEINT), target, false FROM c
  UNION ALL
  SELECT u.source, u.i, u.place, NOT done AND unit > 0 AND unit <= room,
         CASE WHEN NOT done AND unit <= room THEN room - unit ELSE room END,
         CASE WHEN NOT done AND unit > room AND unit <= most THEN room ELSE most END, target,
         done OR (unit > room AND unit <= most AND room * 1000 <= CAST(round(target) AS HUGEINT))
  FROM walk g JOIN u ON u.source IS NOT DISTINCT FROM g.source AND u.i = g.i + 1),
r AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, c.copies, g.more AND d.size > 0 AS more
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
  JOIN walk g ON g.source IS NOT DISTINCT FROM d.source AND g.place = d.place)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

ORACLE["op10_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_CODE = "CAST(('0x' || substr(h, {0}, 8)) AS BIGINT)"

ORACLE["op11_jaccard"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + least(3, len(w)) - 1], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLE["op12_fill_middle"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
  FROM documents),
c AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
         least({_CODE.format(1)} % (len(u) + 1), {_CODE.format(9)} % (len(u) + 1)) AS a,
         greatest({_CODE.format(1)} % (len(u) + 1), {_CODE.format(9)} % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_CODE.format(17)} % 100 >= 50
              THEN 'plain' WHEN {_CODE.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(u[1 : a], '') AS x, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

# CRC-32 of the UTF-8 bytes: the register after each byte, by a table of 256.
_CRC = """
WITH RECURSIVE shifts(i, k, v) AS (
  SELECT range, 0, CAST(range AS UBIGINT) FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END FROM shifts WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM shifts WHERE k = 8)"""

ORACLE["op13_resample"] = f"""
{_CRC},
w AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS row, {_WORDS.format('text')} AS w FROM documents),
i AS MATERIALIZED (SELECT {_WORDS.format('text')} AS w FROM benchmark),
f AS MATERIALIZED (
  SELECT row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM w),
g AS MATERIALIZED (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM i),
h AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM (SELECT f FROM f UNION ALL SELECT f FROM g))),
b AS MATERIALIZED (
  SELECT f, xor(list_reduce(
    list_transform(range(0, length(x) // 2), lambda k: CAST(CAST('0x' || substr(x, 2 * k + 1, 2) AS INTEGER) AS UBIGINT)),
    lambda s, y: xor(s >> 8, t[CAST(xor(s, y) & 255 AS BIGINT) + 1]), CAST(4294967295 AS UBIGINT)),
    CAST(4294967295 AS UBIGINT)) % 10000 AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS n FROM f JOIN b USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM g JOIN b USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
           / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
sums AS (
  SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN b USING (f) JOIN gains USING (bucket) GROUP BY row),
k AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN CAST(floor(total / n) AS BIGINT) ELSE 0 END AS weight,
         CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN sums USING (row)),
z AS (
  SELECT doc_id, n_words, n_features, weight,
         weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM k),
o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         sum(CASE WHEN n_words >= 20 THEN 1 ELSE 0 END) OVER () AS able FROM z)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 25 * CAST(able AS BIGINT) // 100 THEN place END AS rank
FROM o
"""
