"""DuckDB SQL that checks the operators on conversations by other means: prefixes as lists, and a plain dynamic programme over whole audits."""

# CRC-32 of an ASCII text, bit by bit for the table and byte by byte for the text
CRC = """
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM range(256) r(b))"""


def _crc(text: str) -> str:
    return (
        f"(SELECT xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(substring({text}, i, 1))::BIGINT), "
        f"lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295) FROM crc_table)"
    )


PREFIX_TRIE = f"""
WITH {CRC},
given AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, seq, conv_id - conv_id % 100 AS donor, {_crc("conv_id::VARCHAR")} % 6 AS h FROM given),
built AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(b.seq, 1, a.h::BIGINT), []), list_slice(a.seq, a.h::BIGINT + 1, length(a.seq))) AS seq
  FROM heads a LEFT JOIN given b ON b.conv_id = a.donor),
prefixes AS (
  SELECT conv_id, length(seq) AS whole, d::BIGINT AS depth, sha256(list_slice(seq, 1, d)::VARCHAR) AS id, CASE WHEN d > 0 THEN sha256(list_slice(seq, 1, d - 1)::VARCHAR) END AS above,
         CASE WHEN d > 0 THEN length(seq[d][2]) ELSE 0 END AS chars
  FROM built, unnest(range(length(seq) + 1)) u(d)),
nodes AS (
  SELECT depth, id, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, id),
children AS (SELECT depth - 1 AS depth, above AS id, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, id)),
subtrees AS (
  SELECT p.depth, p.id, sum((m.n_convs - 1) * m.chars) AS saved_tokens, count_if(m.n_children = 0) AS n_leaves
  FROM full_nodes m JOIN prefixes p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY 1, 2)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN subtrees s USING (depth, id) LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.id = n.above
"""

_W = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

STRUCTURE_REPAIR = f"""
WITH RECURSIVE {CRC},
words AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM words, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) u(copy) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || length(text) || ':' || text)) AS place, rtrim(text, {_W}) AS bare FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth, lead(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS next FROM placed),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, substring(role, 1, 1) AS initial FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
         count_if(fault = 'truncated') AS truncated, count_if(next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
-- insertions in a state, and where they lead
inserted AS (SELECT * FROM (VALUES (0, '', 0), (0, 'u', 2), (0, 'ua', 3), (1, '', 1), (1, 'u', 2), (1, 'ua', 3), (2, '', 2), (2, 'a', 3), (3, '', 3), (3, 'u', 2)) t(start, ins, mid)),
-- edits of a row in a state: a kept initial, any role anew (null), or none
edits AS (
  SELECT * FROM (VALUES (0, 's', 1, 'K', 0), (0, 'u', 2, 'K', 0), (1, 'u', 2, 'K', 0), (2, 'a', 3, 'K', 0), (3, 'u', 2, 'K', 0),
    (0, NULL, 2, 'R', 3), (1, NULL, 2, 'R', 3), (2, NULL, 3, 'R', 3), (3, NULL, 2, 'R', 3), (0, NULL, 0, 'D', 4), (1, NULL, 1, 'D', 4), (2, NULL, 2, 'D', 4), (3, NULL, 3, 'D', 4)
  ) t(mid, initial, stop, edit, price)),
-- the path keeps what each row becomes: inserted initials, then the edit
ways AS (
  SELECT i.start, e.stop, e.initial, e.edit, 3 * length(i.ins) + e.price AS price, repeat('I', length(i.ins)) || e.edit AS audit,
         i.ins || e.edit || CASE WHEN e.edit = 'R' THEN CASE WHEN e.mid = 2 THEN 'a' ELSE 'u' END ELSE '' END AS path
  FROM inserted i JOIN edits e USING (mid)),
dp AS (
  SELECT conv_id, 0::BIGINT AS place, 0 AS state, (0::BIGINT, '', ''::VARCHAR) AS best FROM counts
  UNION ALL
  SELECT dp.conv_id, j.place, w.stop, min((best[1] + w.price + CASE WHEN j.fault = 'truncated' AND w.edit <> 'D' THEN 3 ELSE 0 END, best[2] || w.audit, best[3] || w.path || ';'))
  FROM dp JOIN judged j ON j.conv_id IS NOT DISTINCT FROM dp.conv_id AND j.place = dp.place + 1 JOIN ways w ON w.start = dp.state
   AND (w.edit = 'D' OR coalesce(j.fault, '') NOT IN ('blank', 'duplicate')) AND (w.initial IS NULL OR w.initial = j.initial)
  GROUP BY dp.conv_id, j.place, w.stop),
ends AS (SELECT conv_id, max(place) AS place FROM judged GROUP BY conv_id),
closed AS (
  SELECT dp.conv_id, min((best[1] + 3 * length(c.ins), best[2] || repeat('I', length(c.ins)), best[3] || c.ins || 'E')) AS best
  FROM dp JOIN ends e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.place = dp.place JOIN (VALUES (0, ''), (1, 'ua'), (2, 'a'), (3, '')) c(state, ins) ON c.state = dp.state
  GROUP BY dp.conv_id),
steps AS (SELECT conv_id, unnest(string_split(best[3], ';')) AS step, generate_subscripts(string_split(best[3], ';'), 1) AS place FROM closed),
lines AS (
  SELECT s.conv_id, s.place, k, CASE k_char WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' END AS line
  FROM (SELECT conv_id, place, unnest(range(1, length(regexp_extract(step, '^[ua]*')) + 1)) AS k, unnest(string_split(regexp_extract(step, '^[ua]*'), '')) AS k_char FROM steps WHERE step SIMILAR TO '[ua]+.*') s
  UNION ALL
  SELECT s.conv_id, s.place, 1000, CASE WHEN step LIKE '%K' THEN j.role WHEN step LIKE '%Ru' THEN 'user' ELSE 'assistant' END || ':' || j.text
  FROM steps s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.place = s.place WHERE step LIKE '%K' OR step LIKE '%R_'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place, k) AS text FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(x.best[1], 0)::BIGINT AS cost, coalesce(x.best[2], '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN closed x ON x.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
