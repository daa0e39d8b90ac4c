"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS body FROM documents),
g AS (SELECT doc_id, sha256(body) AS text_sha256,
             max(doc_id) OVER (PARTITION BY body) AS keep_id,
             count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP2 = """
WITH RECURSIVE n AS (SELECT source, count(*) AS rows_of FROM documents GROUP BY source),
w AS (SELECT source, rows_of,
             greatest(1, CAST(floor(pow(rows_of, 0.7) / sum(pow(rows_of, 0.7)) OVER () * 1000 + 0.5) AS BIGINT)) AS weight,
             row_number() OVER (ORDER BY source) AS k FROM n),
c AS (SELECT CAST(sum(weight) AS BIGINT) AS cycle, list(weight ORDER BY k) AS ws FROM w),
s(slot, done, pick, pick_block) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ws, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM c
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), best, done[best]
  FROM (
    SELECT slot, done,
      list_min(list_filter(list_transform(done, lambda x, i:
        CASE WHEN x < ws[i] AND (x * cycle) // ws[i] <= slot + 1
             THEN ((((x + 1) * cycle + ws[i] - 1) // ws[i]) * 100000 + i) ELSE NULL END), lambda v: v IS NOT NULL)) % 100000 AS best
    FROM s, c WHERE slot + 1 < cycle)
),
slots AS (SELECT w.source, s.pick_block AS j, s.slot AS at FROM s JOIN w ON s.pick = w.k WHERE s.slot >= 0),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id % 4096, doc_id) AS source_rank FROM documents),
b AS (SELECT r.doc_id, r.source, w.weight, c.cycle, r.source_rank, (r.source_rank - 1) // 16 AS block
      FROM r JOIN w ON r.source = w.source CROSS JOIN c),
p AS (SELECT b.*, (block // b.weight) * b.cycle + slots.at AS slot FROM b JOIN slots ON slots.source = b.source AND slots.j = b.block % b.weight),
h AS (SELECT min(((rows_of // 16) // weight) * cycle + slots.at) AS horizon
      FROM w CROSS JOIN c JOIN slots ON slots.source = w.source AND slots.j = (rows_of // 16) % weight)
SELECT doc_id, source, weight, cycle, source_rank, block, (block * cycle) // weight AS release,
       ((block + 1) * cycle + weight - 1) // weight AS deadline, slot, slot < horizon AS in_mix
FROM p CROSS JOIN h
"""

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM g),
s AS (SELECT doc_id, unnest(g) AS s FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
WITH q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 75 + (25 * CAST(len(w) AS BIGINT) * docs) // total AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
x AS (SELECT q.item_id, p.r, CAST(sum(q.c * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * m.m))) AS BIGINT) AS score
      FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY q.item_id, p.r),
y AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM x JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM y WHERE rank <= 20
"""

_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "coalesce(strlen({0}) || ':' || {0}, '-')"
_CRC = """list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""

OP11 = f"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS r, doc_id, source, sha256({_FIELDS} || {_TEXT.format('text')}) AS leaf, {_FIELDS} AS fields, text,
         xor({_CRC}, 4294967295) % 2 = 0 AS hit FROM documents),
o AS (SELECT r, doc_id, source, leaf,
             CASE WHEN hit THEN sha256(fields || {_TEXT.format("replace(text, chr(10), '')")}) ELSE leaf END AS changed,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS width FROM l),
n(lev, source, pos, digest, width) AS (
  SELECT 0, source, pos, leaf, width FROM o
  UNION ALL
  SELECT lev + 1, source, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (width + 2) // 3 FROM n WHERE width > 1 GROUP BY lev, source, pos // 3, width),
sub AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS width FROM n WHERE width = 1),
t(lev, pos, digest, width) AS (
  SELECT 0, pos, subroot, width FROM sub
  UNION ALL
  SELECT lev + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (width + 2) // 3 FROM t WHERE width > 1 GROUP BY lev, pos // 3, width),
a AS (SELECT lev, source, pos // 3 AS run, list(digest ORDER BY pos) AS sides FROM n WHERE width > 1 GROUP BY lev, source, pos // 3),
b AS (SELECT lev, pos // 3 AS run, list(digest ORDER BY pos) AS sides FROM t WHERE width > 1 GROUP BY lev, pos // 3),
u(r, lev, pos, source, proof, fold) AS (
  SELECT r, 0, pos, source, '', changed FROM o
  UNION ALL
  SELECT u.r, u.lev + 1, u.pos // 3, u.source,
         u.proof || array_to_string(list_filter(a.sides, lambda x, i: i <> u.pos % 3 + 1), ''),
         sha256(array_to_string(list_transform(a.sides, lambda x, i: CASE WHEN i = u.pos % 3 + 1 THEN u.fold ELSE x END), ''))
  FROM u JOIN a ON a.lev = u.lev AND a.source IS NOT DISTINCT FROM u.source AND a.run = u.pos // 3),
g AS (SELECT u.r, u.proof, u.fold, sub.pos, sub.subroot FROM u JOIN sub ON sub.source IS NOT DISTINCT FROM u.source
      WHERE u.lev = (SELECT max(lev) FROM n WHERE n.source IS NOT DISTINCT FROM u.source)),
v(r, lev, pos, subroot, proof, fold) AS (
  SELECT r, 0, pos, subroot, proof, fold FROM g
  UNION ALL
  SELECT v.r, v.lev + 1, v.pos // 3, v.subroot,
         v.proof || array_to_string(list_filter(b.sides, lambda x, i: i <> v.pos % 3 + 1), ''),
         sha256(array_to_string(list_transform(b.sides, lambda x, i: CASE WHEN i = v.pos % 3 + 1 THEN v.fold ELSE x END), ''))
  FROM v JOIN b ON b.lev = v.lev AND b.run = v.pos // 3),
h AS (SELECT digest AS root, lev FROM t WHERE width = 1)
SELECT o.doc_id, o.leaf, v.subroot, h.root, sha256(v.proof) AS proof_sha256, v.fold AS folded_root, v.fold = h.root AS verified
FROM v JOIN h ON v.lev = h.lev JOIN o ON o.r = v.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1, "op2_mix_sources": OP2, "op3_exact_dedup": OP3, "op11_merkle_manifest": OP11, "op12_lexical_search": OP12}
