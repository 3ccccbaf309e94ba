"""DuckDB SQL for the operators that SQL can express, written independently of them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: crc: one row with the table of the CRC-32 of single bytes.
CRC = """
crc_steps AS (
  SELECT b, 0 AS step, b AS c FROM range(256) r(b)
  UNION ALL
  SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE step < 8
),
crc AS (SELECT list(c ORDER BY b) AS t FROM crc_steps WHERE step = 8)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, beside the row of `crc`."""
    hexed = f"hex(encode({text}))"
    digit = lambda i: f"strpos('0123456789ABCDEF', substr({hexed}, {i}, 1)) - 1"
    data = f"list_transform(range(0, strlen({text})), lambda i: (({digit('2 * i + 1')}) * 16 + {digit('2 * i + 2')})::BIGINT)"
    return f"xor(list_reduce({data}, lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def encoded(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"({encoded(v)})" for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, base: str) -> str:
    """The nodes of trees with runs of three, up from `base` (g, idx, d, n), and each node's siblings."""
    return f"""
{name} AS (
  SELECT g, 0 AS lvl, idx, d, n FROM {base}
  UNION ALL
  SELECT g, lvl + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lvl, idx // 3, n
),
{name}_near AS (
  SELECT g, lvl, idx,
         coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY g, lvl, idx // 3 ORDER BY idx)
)"""


MERKLE = f"""
WITH RECURSIVE {CRC},
tamper AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
  FROM documents, crc
),
leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {_leaf('text')} AS leaf, {_leaf('cut')} AS other
  FROM tamper
),
low AS (
  SELECT rid, doc_id, g, leaf AS d, other, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n
  FROM leaves
),
{_levels('t', 'low')},
high AS (SELECT 0 AS g, g AS idx, d, count(*) OVER () AS n FROM t WHERE n = 1),
{_levels('u', 'high')},
way AS (
  SELECT rid, g, 0 AS lvl, idx, other AS cur, '' AS proof, false AS above FROM low
  UNION ALL
  SELECT w.rid, CASE WHEN m.g IS NULL THEN 0 ELSE w.g END, CASE WHEN m.g IS NULL THEN 0 ELSE w.lvl + 1 END,
         CASE WHEN m.g IS NULL THEN w.g ELSE w.idx // 3 END,
         CASE WHEN m.g IS NULL THEN w.cur ELSE sha256(m.l || w.cur || m.r) END,
         CASE WHEN m.g IS NULL THEN w.proof ELSE w.proof || m.l || m.r END, m.g IS NULL
  FROM way w LEFT JOIN t_near m ON m.g = w.g AND m.lvl = w.lvl AND m.idx = w.idx WHERE NOT w.above
),
top AS (
  SELECT rid, 0 AS lvl, idx, cur, proof FROM way WHERE above
  UNION ALL
  SELECT w.rid, w.lvl + 1, w.idx // 3, sha256(m.l || w.cur || m.r), w.proof || m.l || m.r
  FROM top w JOIN u_near m ON m.lvl = w.lvl AND m.idx = w.idx
),
done AS (SELECT rid, arg_max(cur, lvl) AS cur, arg_max(proof, lvl) AS proof FROM top GROUP BY rid)
SELECT low.doc_id, low.d AS leaf, high.d AS subroot, root.d AS root, sha256(done.proof) AS proof_sha256, done.cur AS folded_root, done.cur = root.d AS verified
FROM low JOIN done USING (rid) JOIN high ON high.idx = low.g CROSS JOIN (SELECT d FROM u WHERE n = 1) root
"""

VARIANTS = f"""
WITH RECURSIVE {CRC},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, k, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM each, crc),
damaged AS (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
vocabulary AS (SELECT word, sum(k)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
gaps AS (
  SELECT word, pos, substr(word, 1, pos) || substr(word, pos + 2) AS gap
  FROM (SELECT word, unnest(range(length(word))) AS pos FROM vocabulary)
),
near AS (
  SELECT word AS a, gap AS b FROM gaps WHERE gap IN (SELECT word FROM vocabulary)
  UNION SELECT gap, word FROM gaps WHERE gap IN (SELECT word FROM vocabulary)
  UNION SELECT x.word, y.word FROM gaps x JOIN gaps y ON x.gap = y.gap AND x.pos = y.pos AND x.word <> y.word
),
best AS (
  SELECT a, b, v.n AS bn, count(*) OVER (PARTITION BY a) AS near_words, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS place
  FROM near JOIN vocabulary v ON v.word = b
),
chosen AS (
  SELECT word, n, coalesce(near_words, 0) AS n_near, CASE WHEN bn >= 5 * n THEN b END AS form, CASE WHEN bn >= 5 * n THEN bn END AS form_n
  FROM vocabulary LEFT JOIN best ON a = word AND place = 1
),
follow AS (
  SELECT word, coalesce(form, word) AS root, 0 AS step FROM chosen
  UNION ALL
  SELECT f.word, c.form, f.step + 1 FROM follow f JOIN chosen c ON c.word = f.root WHERE c.form IS NOT NULL
)
SELECT c.word, c.form, arg_max(f.root, f.step) AS root, c.n, c.n_near::BIGINT AS n_near, c.form_n
FROM chosen c JOIN follow f ON f.word = c.word GROUP BY c.word, c.form, c.n, c.n_near, c.form_n
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, pos + 1, pos + 10), ' ') AS key
  FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS pos FROM items WHERE len(w) > 0)
),
places AS (
  SELECT rid, size, pos, array_to_string(list_slice(w, pos + 1, pos + size), ' ') AS key
  FROM (SELECT rid, w, size, unnest(range(greatest(0, len(w) - size + 1))) AS pos FROM docs, (SELECT DISTINCT size FROM windows))
),
hits AS (SELECT rid, pos, size, item FROM places JOIN windows USING (size, key)),
covered AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS word FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

ORACLE = {"op11_merkle_manifest": MERKLE, "op13_partenum_variants": VARIANTS, "op5_prefix_decontamination": CONTAMINATION}
