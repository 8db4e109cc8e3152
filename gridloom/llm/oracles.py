"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from gridloom.llm import license_scan as ls
from gridloom.llm import quality_rules as qr

_WORD = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


EXACT_DEDUP = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(t) AS text_sha256
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  WINDOW w AS (PARTITION BY t))
"""

# every line, block and whole text against every template that shares a bigram, without bounds; less what is another template's own wording. Windows are beyond it:
# the brute force of the tests has them.
LICENSE_SCAN = f"""
WITH t(template, text) AS (VALUES {', '.join(f'({_text(k)}, {_text(v)})' for k, v in ls.TEMPLATES.items())}),
 tw AS (SELECT template, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM t),
 tb AS (SELECT template, len(ws) - 1 AS size, unnest(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) AS bigram FROM tw),
 tg AS (SELECT template, size, bigram, count(*) AS held FROM tb GROUP BY ALL),
 l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
 w AS (SELECT doc_id, i, regexp_extract_all(lower(line), '[a-z0-9]+') AS ws FROM l),
 p AS (SELECT *, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY i) AS b, sum(CASE WHEN len(ws) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM w),
 s AS (SELECT *, b - len(ws) AS a FROM p WHERE len(ws) > 0),
 b AS (SELECT doc_id, block, count(*) AS n, flatten(list(ws ORDER BY i)) AS ws, min(a) AS a, max(b) AS b FROM s GROUP BY 1, 2),
 u AS (SELECT doc_id, 'line' || i AS unit, ws, a, b FROM s UNION ALL SELECT doc_id, 'block' || block, ws, a, b FROM b WHERE n > 1
       UNION ALL SELECT doc_id, 'text', flatten(list(ws ORDER BY block)), min(a), max(b) FROM b GROUP BY doc_id HAVING count(*) > 1),
 g AS (SELECT doc_id, unit, len(ws) - 1 AS own, unnest(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) AS bigram FROM u WHERE len(ws) > 1),
 c AS (SELECT doc_id, unit, own, bigram, count(*) AS n FROM g GROUP BY ALL),
 d AS (SELECT doc_id, unit, template, CAST(2 AS DOUBLE) * sum(least(n, held)) / (own + size) AS dice, count(*) AS shared FROM c JOIN tg USING (bigram) GROUP BY doc_id, unit, own, template, size),
 h AS (SELECT d.*, u.a, u.b FROM d JOIN u USING (doc_id, unit) WHERE dice >= {ls.LEAST_DICE}),
 shared_ AS (SELECT doc_id, unit, x.template, o.template AS other, count(*) AS n FROM (SELECT c.doc_id, c.unit, c.bigram FROM c SEMI JOIN h USING (doc_id, unit)) AS cs JOIN tg x USING (bigram) JOIN tg o USING (bigram) GROUP BY 1, 2, 3, 4),
 foreign_ AS (SELECT DISTINCT x.doc_id, x.unit, x.template FROM h x JOIN h o ON o.doc_id = x.doc_id AND o.template <> x.template AND o.a <= x.a AND x.b <= o.b
     AND (o.dice > x.dice OR (o.dice = x.dice AND o.b - o.a > x.b - x.a))
   JOIN shared_ s ON s.doc_id = x.doc_id AND s.unit = x.unit AND s.template = x.template AND s.other = o.template WHERE s.n = x.shared)
SELECT doc_id, template, count(*) AS passages, max(dice) AS dice FROM h ANTI JOIN foreign_ USING (doc_id, unit, template) GROUP BY 1, 2
"""

# shortest windows of 50 words from both ends, by their text
LINE_DEDUP = rf"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 s AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '{_WORD}')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
       FROM l WHERE regexp_matches(line, '{_WORD}')),
 c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM s),
 w AS (SELECT a.doc_id, a.k AS first, min(b.k) AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49
         WHERE b.upto - a.upto + a.n >= 50 GROUP BY 1, 2
       UNION SELECT b.doc_id, max(a.k), b.k FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49
         WHERE b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.k),
 t AS (SELECT w.doc_id, first, last, string_agg(line, chr(10) ORDER BY k) AS body FROM w JOIN s ON w.doc_id = s.doc_id AND s.k BETWEEN first AND last GROUP BY 1, 2, 3),
 o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS place FROM t),
 gone AS (SELECT DISTINCT o.doc_id, s.pos FROM o JOIN s ON o.doc_id = s.doc_id AND s.k BETWEEN first AND last WHERE place > 1),
 kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, CAST(coalesce(n_removed, 0) AS INT) AS n_removed,
       length(coalesce(kept.text, '')) AS n_chars, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY 1) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1) USING (doc_id)
"""

# lengths of marks: user 18, assistant 5, any other role 16 and its name; one character for each escaped control string
CHAT_FORMAT = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE 16 + length(role) END
    + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]|\[\\*/?ROLE\]|\[\\*ROLE '))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _classes(text: str) -> str:
    """Characters of each class: what every pattern takes out of what the ones before it left."""
    rest, sizes = rf"regexp_replace({text}, '[\x20\x09-\x0D]+', '', 'g')", []
    for pattern in qr._CLASSES.values():
        after = f"regexp_replace({rest}, {_text(pattern)}, '', 'g')"
        sizes.append(f"length({rest}) - length({after})")
        rest = after
    return f"[{', '.join([*sizes, f'length({rest})'])}]"


def _distance(p: str, q: str) -> str:
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    one, two = part.format("z[1]", "z[2]"), part.format("z[2]", "z[1]")
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {one} + {two})) / 2))"


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
 w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
 g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) AS gram FROM w),
 r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g), (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY 1),
 base AS (SELECT w.doc_id, lang, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
   len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))
     - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) AS n_dup_lines,
   coalesce(r.n, 0) AS n_repeat_words, {_classes('text')} AS chars FROM w LEFT JOIN r USING (doc_id)),
 cnt AS (SELECT lang, unnest(ws) AS word, count(*) AS n FROM w GROUP BY 1, 2),
 tot AS (SELECT lang, sum(n) AS words FROM cnt GROUP BY 1),
 cls AS (SELECT lang, k, sum(n * c) AS n FROM (SELECT lang, n, unnest({_classes('word')}) AS c, unnest(range(6)) AS k FROM cnt) GROUP BY 1, 2),
 ref_chars AS (SELECT lang, list(n ORDER BY k) AS ref_chars FROM cls GROUP BY 1),
 top AS (SELECT * FROM (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM cnt WHERE regexp_full_match(word, '\p{{L}}+')) WHERE k <= {qr.COMMON}),
 ref_words AS (SELECT lang, list(word ORDER BY k) AS common, list(n ORDER BY k) AS counts FROM top GROUP BY 1),
 ref AS (SELECT lang, coalesce(common, []) AS common, coalesce(counts, []) AS counts, ref_chars, words FROM tot JOIN ref_chars USING (lang) LEFT JOIN ref_words USING (lang)),
 own AS (SELECT base.*, words - n_words AS rest_words, list_sum(ref_chars) - word_chars AS rest_chars, ref_chars, counts,
           list_transform(common, lambda c: len(list_filter(ws, lambda x: x = c))) AS held FROM base LEFT JOIN ref USING (lang)),
 hits AS (SELECT *, list_transform(held, lambda h: h / CAST(greatest(n_words, 1) AS DOUBLE)) AS bins,
            list_transform(list_zip(counts, held), lambda z: (z[1] - z[2]) / CAST(greatest(rest_words, 1) AS DOUBLE)) AS shares,
            list_transform(list_zip(ref_chars, chars), lambda z: (z[1] - z[2]) / CAST(greatest(rest_chars, 1) AS DOUBLE)) AS rest_classes FROM own),
 far AS (SELECT *,
   CASE WHEN word_chars >= {qr.LEAST_CHARS} AND rest_chars >= {qr.LEAST_REST_CHARS}
     THEN {_distance('list_transform(chars, lambda c: c / CAST(word_chars AS DOUBLE))', 'rest_classes')} ELSE 0 END AS char_distance,
   CASE WHEN n_words >= {qr.LEAST_WORDS} AND rest_words >= {qr.LEAST_REST_WORDS} AND len(bins) > 0
     THEN {_distance('list_append(bins, greatest(0, 1 - list_sum(bins)))', 'list_append(shares, greatest(0, 1 - list_sum(shares)))')} ELSE 0 END AS word_distance,
   n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM hits)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND char_distance <= {qr.MOST_CHARS} AND word_distance <= {qr.MOST_WORDS} + {qr.SLACK} / n_words AS kept FROM far
"""
