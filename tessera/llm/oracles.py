"""SQL (DuckDB) that gives the rows of the contract queries it can express, each in the plainest way and not by the operator's method."""

from __future__ import annotations

from tessera.llm.fingerprint import LEAF, RUN
from tessera.llm.licenses import NOTICES, PHRASES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"[^\x20\x09-\x0D]+"

DECONTAMINATE = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS s
  FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k) WHERE len(w) > 0),
d AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM w, (SELECT DISTINCT n FROM g), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)),
h AS (SELECT d.doc_id, d.k, d.n, g.id FROM d JOIN g ON d.n = g.n AND d.s = g.s),
c AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM h, LATERAL (SELECT unnest(range(0, n)) AS j) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: The order of hashes, the apportionments by all quotients and the blocks one by one.
MIXING = f"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) AS size, CAST('0x' || substr(md5('17:' || doc_id), 1, 15) AS BIGINT) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s GROUP BY 1),
tot AS (SELECT CAST(sum(source_size) AS BIGINT) AS total, count(*) AS n, CAST(ceil(sum(source_size) / (count(*) * 4096.0)) AS BIGINT) AS block FROM src),
lev AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS theta
  FROM src, tot WINDOW b AS (ORDER BY 3 * source_size / weight::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT *, least(3.0::DOUBLE * source_size, max(CASE WHEN theta * weight <= 3 * source_size THEN theta END) OVER () * weight) AS target,
  greatest(1, CAST(ceil(source_size / block::DOUBLE) AS BIGINT)) AS blocks, CAST(ceil(total / block::DOUBLE) AS BIGINT) AS seats FROM lev),
won AS (SELECT source, count(*) AS quota FROM (SELECT source, seats, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST, k) AS r FROM tgt, LATERAL (SELECT unnest(range(1, seats + 1)) AS k)) WHERE r <= seats GROUP BY 1),
q AS (SELECT tgt.*, least(quota, 3 * blocks) AS quota, least(quota, 3 * blocks) // blocks AS passes, least(quota, 3 * blocks) % blocks AS rest, least(blocks, 16) AS shards FROM tgt JOIN won ON won.source IS NOT DISTINCT FROM tgt.source),
sh AS (SELECT source, rest, block, shard, shard * blocks // shards AS first, (shard + 1) * blocks // shards - shard * blocks // shards AS n FROM q, LATERAL (SELECT unnest(range(0, shards)) AS shard)),
shw AS (SELECT source, shard, count(*) AS won FROM (SELECT source, shard, rest, row_number() OVER (PARTITION BY source ORDER BY n / (2 * k - 1)::DOUBLE DESC, shard, k) AS r FROM sh, LATERAL (SELECT unnest(range(1, least(rest, n) + 1)) AS k)) WHERE r <= rest GROUP BY 1, 2),
bl AS (SELECT sh.source, first + i AS b, CASE WHEN (i - CAST('0x' || substr(md5('17:' || coalesce(sh.source, '') || ':' || sh.shard), 1, 15) AS BIGINT) % n + n) % n < coalesce(won, 0) THEN 1 ELSE 0 END AS chosen
  FROM sh LEFT JOIN shw ON shw.source IS NOT DISTINCT FROM sh.source AND shw.shard = sh.shard, LATERAL (SELECT unnest(range(0, n)) AS i)),
p AS (SELECT s.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ FROM s),
o AS (SELECT p.doc_id, CAST(sum(least(at_ + size, (x.b + 1) * block) - greatest(at_, x.b * block)) FILTER (WHERE chosen = 1) AS BIGINT) AS part
  FROM p JOIN tot ON true, LATERAL (SELECT unnest(range(at_ // block, (at_ + size - 1) // block + 1)) AS b) x JOIN bl ON bl.source IS NOT DISTINCT FROM p.source AND bl.b = x.b WHERE size > 0 GROUP BY 1)
SELECT p.doc_id, size, q.source_size, q.target, CAST(size * passes + coalesce(part, 0) AS BIGINT) AS taken
FROM p JOIN q ON q.source IS NOT DISTINCT FROM p.source LEFT JOIN o ON o.doc_id = p.doc_id
"""


def _templates() -> str:
    rows = [(k, t, k < len(PHRASES)) for k, t in enumerate([*PHRASES, *NOTICES])]
    return ", ".join(f"({k}, '{t.label}', '{t.text}', {str(exact).lower()})" for k, t, exact in rows)


LICENSES = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT k AS t, label, string_split(txt, ' ') AS tw, exact FROM (VALUES {_templates()}) v(k, label, txt, exact)),
tg AS (SELECT t, label, exact, len(tw) - 2 AS grams, i - 1 AS i, array_to_string(tw[i:i + 2], ' ') AS g FROM t, LATERAL (SELECT unnest(range(1, len(tw) - 1)) AS i)),
dg AS (SELECT doc_id, p - 1 AS p, array_to_string(w[p:p + 2], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS p)),
v AS (SELECT doc_id, t, label, exact, grams, p - i AS dia, count(*) AS votes, min(p) AS lo, max(p) + 3 AS hi FROM dg JOIN tg USING (g) GROUP BY ALL),
r AS (SELECT *, sum(CASE WHEN exact OR dia - prev > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t ORDER BY dia) AS run FROM (SELECT *, lag(dia) OVER (PARTITION BY doc_id, t ORDER BY dia) AS prev FROM v)),
s AS (SELECT doc_id, t, label, exact, grams, sum(votes) AS votes, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY doc_id, t, label, exact, grams, run),
f AS (SELECT *, least(1.0::DOUBLE, votes / grams::DOUBLE) AS score FROM s WHERE CASE WHEN exact THEN votes = grams ELSE least(1.0::DOUBLE, votes / grams::DOUBLE) >= 0.7 AND hi - lo <= 2 * (grams + 2) END),
a AS (SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(lo) FILTER (WHERE exact) AS f1, max(lo) FILTER (WHERE exact) AS l1, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM f GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(f1 AS BIGINT) AS first_word, CAST(l1 AS BIGINT) AS last_word, coalesce(base, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN a USING (doc_id)
"""

#: All pairs that share a shingle, their exact similarity, and what their links reach.
NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id, coalesce(b, w.doc_id) >= w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""


def _print(prefix: str, text: str) -> str:
    leaves = f"list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{RUN}'), lambda x: md5(x)))"
    return f"{text} AS {prefix}t_, {leaves} AS {prefix}l"


def _shown(prefix: str) -> str:
    def body(cut: str) -> str:
        return f"replace(array_to_string(list_transform({prefix}l, lambda p: array_to_string(list_transform(p, lambda h: {cut}), '')), ','), ',,', ';')"

    root = f"md5(array_to_string(list_transform(string_split({body('h')}, ';'), lambda s: md5(array_to_string(list_transform(string_split(s, ','), lambda p: md5(p)), ''))), ''))"
    return f"{root} AS {prefix}root, {body(f'substr(h, 1, {LEAF})')} AS {prefix}body"


def _like(a: str, b: str) -> str:
    return f"CASE WHEN {a}root = {b}root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce({a}{b}.common, 0) / (2 + coalesce({a}{b}.n, 0)) END"


def _shared(a: str, b: str) -> str:
    """Branches of each level counted on either side and met by their names."""
    return f"""SELECT doc_id, sum(least(x, y)) AS common, sum(x + y) AS n FROM (
  SELECT doc_id, lvl, node, count(*) FILTER (WHERE side = '{a}') AS x, count(*) FILTER (WHERE side = '{b}') AS y FROM v WHERE side IN ('{a}', '{b}') GROUP BY 1, 2, 3) GROUP BY 1"""


FINGERPRINT = f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM o),
e AS (SELECT doc_id, text, nxt, substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2) AS edited FROM x),
l AS (SELECT doc_id, {_print('a', 'text')}, {_print('b', 'edited')}, {_print('c', 'nxt')} FROM e),
p AS (SELECT doc_id, at_, bt_, {_shown('a')}, {_shown('b')}, {_shown('c')} FROM l),
w AS (SELECT doc_id, 'a' AS side, abody AS body FROM p UNION ALL SELECT doc_id, 'b', bbody FROM p UNION ALL SELECT doc_id, 'c', cbody FROM p),
v AS (SELECT doc_id, side, 1 AS lvl, unnest(list_filter(string_split(body, ';'), lambda s: regexp_matches(s, '[0-9a-f]'))) AS node FROM w
  UNION ALL SELECT doc_id, side, 2, unnest(list_filter(string_split(replace(body, ';', ','), ','), lambda s: s <> '')) FROM w
  UNION ALL SELECT doc_id, side, 3, unnest(regexp_extract_all(body, '[0-9a-f]{{{LEAF}}}')) FROM w),
ab AS ({_shared('a', 'b')}), ac AS ({_shared('a', 'c')})
SELECT p.doc_id, CAST(length(at_) AS BIGINT) AS n_chars, sha256(bt_) AS edited_sha256, aroot || ':' || abody AS fingerprint, broot || ':' || bbody AS edited_fingerprint,
  {_like('a', 'b')} AS near_edited, {_like('a', 'c')} AS near_next FROM p LEFT JOIN ab ON ab.doc_id = p.doc_id LEFT JOIN ac ON ac.doc_id = p.doc_id
"""


def _told(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


#: Levels by grouping runs; CRC-32 bit by bit; a proof step is L or R and the sibling, or - where there is none.
MANIFEST = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_told("doc_id", "source", "lang", "n_chars", "text")} AS leaf, {_told("doc_id", "source", "lang", "n_chars + 1", "text")} AS altered,
  xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT lang FROM d)),
o AS (SELECT d.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d JOIN g ON g.lang IS NOT DISTINCT FROM d.lang),
t AS (SELECT 0 AS lvl, tree, idx, n, leaf AS h FROM o UNION ALL SELECT lvl + 1, tree, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY lvl, tree, idx // 2),
u AS (SELECT 0 AS lvl, tree AS idx, trees AS n, h FROM t JOIN g USING (tree) WHERE n = 1 UNION ALL SELECT lvl + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 2),
s AS (SELECT tree, idx, lvl, CASE WHEN h IS NULL THEN '-' WHEN (idx >> lvl) % 2 = 1 THEN 'L' || h ELSE 'R' || h END AS step
  FROM (SELECT o.tree, o.idx, v.lvl, b.h FROM o JOIN (SELECT DISTINCT tree, lvl FROM t WHERE n > 1) v ON v.tree = o.tree LEFT JOIN t b ON b.tree = o.tree AND b.lvl = v.lvl AND b.idx = xor(o.idx >> v.lvl, 1))),
r AS (SELECT tree, lvl, CASE WHEN h IS NULL THEN '-' WHEN (tree >> lvl) % 2 = 1 THEN 'L' || h ELSE 'R' || h END AS step
  FROM (SELECT g.tree, v.lvl, b.h FROM g, (SELECT DISTINCT lvl FROM u WHERE n > 1) v LEFT JOIN u b ON b.lvl = v.lvl AND b.idx = xor(g.tree >> v.lvl, 1))),
p AS (SELECT tree, idx, list(step ORDER BY lvl) AS steps FROM s GROUP BY 1, 2),
q AS (SELECT tree, list(step ORDER BY lvl) AS steps FROM r GROUP BY 1),
a AS (SELECT o.*, CASE WHEN crc % 7 = 0 THEN altered ELSE leaf END AS claimed, coalesce(p.steps, []) || coalesce(q.steps, []) AS steps, t.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root
  FROM o LEFT JOIN p ON p.tree = o.tree AND p.idx = o.idx LEFT JOIN q ON q.tree = o.tree JOIN t ON t.tree = o.tree AND t.n = 1),
f AS (SELECT *, list_reduce([claimed] || steps, lambda c, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || c WHEN x[1] = 'R' THEN c || x[2:] ELSE c END)) AS folded_root FROM a)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

#: All scores of all anchors.
HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""

SQL = {"op1_decontaminate": DECONTAMINATE, "op3_mixing": MIXING, "op4_licenses": LICENSES, "op6_near_dedup": NEAR_DEDUP, "op10_fingerprint": FINGERPRINT, "op11_manifest": MANIFEST, "op13_hard_negatives": HARD_NEGATIVES}
