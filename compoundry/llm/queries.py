"""Named queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import functools

from compoundry.llm import (katz, merkle_manifest, pfair_mix, piece_nbest, piece_table, positional_index, projection_join, quality_rules,
                            sketch_dedup, substring_words, suffix_dedup, token_codes, wrapper_induction)
from compoundry.plans.registry import ship_package

_PLAIN = {
    "op1_katz_scores": katz.op1_katz_scores,
    "op4_substring_words": substring_words.op4_substring_words,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_projection_join": projection_join.op3_projection_join,
    "op5_piece_nbest": piece_nbest.op5_piece_nbest,
    "op6_wrapper_induction": wrapper_induction.op6_wrapper_induction,
    "op7_pfair_mix": pfair_mix.op7_pfair_mix,
    "op8_token_codes": token_codes.op8_token_codes,
    "op9_setsketch_dedup": sketch_dedup.op9_setsketch_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_piece_table": piece_table.op11_piece_table,
    "op12_positional_index": positional_index.op12_positional_index,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}


def _shipped(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


QUERIES = {name: _shipped(fn) for name, fn in _PLAIN.items()}

#: Words as in the contract; every window of 20 words with its first place.
_OP4 = r"""
WITH w AS (SELECT doc_id, string_split_regex(trim(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\x20\x09-\x0D]+') AS ws FROM documents),
d AS (SELECT doc_id, CASE WHEN len(ws) = 1 AND ws[1] = '' THEN []::VARCHAR[] ELSE ws END AS ws FROM w),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i+19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM rep) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT w.doc_id, string_agg(w.x, ' ' ORDER BY w.p) AS t, count(*) AS n FROM word w LEFT JOIN
  (SELECT doc_id, unnest(ps) AS p FROM gone) g ON g.doc_id = w.doc_id AND g.p = w.p WHERE g.p IS NULL GROUP BY w.doc_id),
runs AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM (SELECT doc_id, unnest(ps) AS p FROM gone)) WHERE q IS NULL OR p <> q + 1 GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256, coalesce(r.n, 0)::BIGINT AS n_spans
FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN runs r USING (doc_id)
"""

#: Base figures word by word; line counts per host over distinct texts; the first document keeps a line.
_OP10 = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls FROM t),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM t),
line AS (SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
    '[^\p{L}\p{N}\s]+', '', 'g'), '\s+', ' ', 'g')) AS norm, len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM raw),
host AS (SELECT source, count(DISTINCT text) AS h FROM t GROUP BY source),
bad AS (SELECT source, norm, min(doc_id) AS first FROM line JOIN host USING (source) WHERE length(norm) >= 8
  GROUP BY source, norm, h HAVING count(DISTINCT text) >= 20 AND count(DISTINCT text) > 0.02 * h),
gone AS (SELECT line.doc_id, count(*) AS n_lines, sum(n) AS n_gone FROM line JOIN bad ON bad.source = line.source AND bad.norm = line.norm AND line.doc_id <> bad.first GROUP BY line.doc_id),
base AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_removed_lines, n_gone,
  greatest(len(ws) - coalesce(n_gone, 0), 0)::BIGINT AS n_left_words FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_gone IS NOT NULL AND (n_left_words < 50 OR n_left_words < 0.3 * n_words)) AS kept,
  n_removed_lines, n_left_words FROM base
"""

#: Lines as a list; cuts and form from the digest of the id.
_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, CASE WHEN t = '' THEN []::VARCHAR[] ELSE regexp_extract_all(t, '[^\n]*\n|[^\n]+') END AS ls,
  ('0x' || substr(h, 1, 8))::UBIGINT::BIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::UBIGINT::BIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT::BIGINT AS h4 FROM d),
c AS (SELECT *, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(ls[1:a], '') AS pre, array_to_string(ls[a+1:b], '') AS mid, array_to_string(ls[b+1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

#: Windows of items against all windows of the same lengths in the documents.
_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT dw.r, dw.s, dw.n, iw.item FROM dw JOIN iw ON iw.w = dw.w AND iw.n = dw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def _field(column: str, value: str = "") -> str:
    value = value or f"{column}::VARCHAR"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def _leaf(length: str = "") -> str:
    return "sha256(" + " || ".join([_field("doc_id"), _field("source"), _field("lang"), _field("n_chars", length), _field("text")]) + ")"


#: Trees level by level; a leaf's path is the list of its siblings with their side, folded from the leaf on.
_OP13 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS k, {_leaf()} AS leaf,
    {_leaf("(n_chars + 1)::VARCHAR")} AS changed, doc_id IS NOT NULL AND n_chars IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
      lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 7 = 0 AS touched FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM d),
lev AS (SELECT k, 0 AS level, pos, leaf AS h, n FROM l UNION ALL
  SELECT k, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM lev WHERE n > 1 GROUP BY k, level, pos // 2, n),
s AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM lev WHERE n = 1),
top AS (SELECT 0 AS level, pos, subroot AS h, n FROM s UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
step AS (SELECT l.k, l.pos, o.level AS lvl, o.pos % 2 AS side, x.h AS sib FROM l
    JOIN lev o ON o.k = l.k AND o.n > 1 AND o.pos = l.pos >> o.level LEFT JOIN lev x ON x.k = o.k AND x.level = o.level AND x.pos = xor(o.pos, 1)
  UNION ALL SELECT l.k, l.pos, 1000 + o.level, o.pos % 2, x.h FROM l JOIN s ON s.k = l.k
    JOIN top o ON o.n > 1 AND o.pos = s.pos >> o.level LEFT JOIN top x ON x.level = o.level AND x.pos = xor(o.pos, 1)),
path AS (SELECT k, pos, list(CASE WHEN sib IS NULL THEN 'N' WHEN side = 1 THEN 'L' || sib ELSE 'R' || sib END ORDER BY lvl) AS steps,
  string_agg(sib, '' ORDER BY lvl) AS sibs FROM step GROUP BY k, pos),
r AS (SELECT h AS root FROM top WHERE n = 1),
o AS (SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.sibs, '')) AS proof_sha256,
  list_reduce(list_prepend(CASE WHEN touched THEN changed ELSE leaf END, coalesce(p.steps, []::VARCHAR[])),
    lambda a, b: sha256(CASE b[1] WHEN 'L' THEN b[2:] || a WHEN 'R' THEN a || b[2:] ELSE a END)) AS folded_root
  FROM l JOIN s USING (k) LEFT JOIN path p ON p.k = l.k AND p.pos = l.pos CROSS JOIN r)
SELECT *, folded_root = root AS verified FROM o
"""

ORACLES = {"op4_substring_words": _OP4, "op10_quality_rules": _OP10, "op11_piece_table": _OP11, "op12_positional_index": _OP12,
           "op13_merkle_manifest": _OP13}
