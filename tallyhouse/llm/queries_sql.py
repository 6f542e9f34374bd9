"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from . import chat, fim, linerules

_SPACE = r"\x20\x09-\x0D"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(x: str) -> str:
    out = rf"replace({x}, '\', '\s')"
    for mark in chat.CONTROLS:
        out = f"replace({out}, {_quote(mark)}, {_quote(mark[0] + chr(92) + 'e' + mark[1:])})"
    return out


def op1_chat_format() -> str:
    said = _quote("</s>[INST] ok [/INST]")
    head = len(chat.TURN) + 1 + len(chat.END)
    return rf"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said})),
 c AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt, ({len(chat.START)} + sum({head} + length(replace({_escaped('role')}, chr(10), '\n')) + length({_escaped('text')})))::BIGINT AS formatted_chars FROM m GROUP BY 1)
 SELECT conv_id, n_turns, turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens FROM c"""


def op2_minhash_near_dedup() -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_SPACE}]+') AS ws FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
 u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), p AS (SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS ni, any_value(b.n) AS nj, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT i, j FROM p WHERE 100 * k >= 85 * (ni + nj - k)), e AS (SELECT i AS a, j AS b FROM l UNION ALL SELECT j, i FROM l),
 r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), m AS (SELECT id, min(c) AS component_id FROM r GROUP BY 1)
 SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.id = s.doc_id"""


def op9_line_rules() -> str:
    boilerplate = linerules.BOILERPLATE.pattern.decode()
    separators = ", ".join(_quote(x.decode()) for x in sorted(linerules.SEPARATORS))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS ws FROM documents),
 x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS ln FROM d), y AS (SELECT *, regexp_extract_all(line, '[^{_SPACE}]+') AS ws FROM x), z AS (SELECT * FROM y WHERE len(ws) > 0),
 a AS (SELECT *, len(ws) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY ln) > 1 AS again, len(list_filter(ws, lambda w: w IN ({separators}))) AS seps, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(line, '[^a-z]', '', 'g')) AS low,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS syms, len(list_filter(ws, lambda w: regexp_matches(w, '[#*$%&|<>]'))) AS symbolic, len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS same FROM z),
 j AS (SELECT *, CASE WHEN 4 * seps >= n AND (n > 1 OR seps = 1) THEN 'navigation' WHEN again OR (n <= {linerules.BOILERPLATE_WORDS} AND regexp_matches(line, {_quote('(?i)' + boilerplate)})) THEN 'boilerplate'
  WHEN n >= 5 AND ((2 * up > up + low AND up > 0) OR (2 * syms >= n AND 2 * symbolic >= n) OR 4 * same >= n) THEN 'noise'
  WHEN NOT regexp_matches(line, '([.!?:;")'']|…|”|»|。)[{_SPACE}]*$') THEN CASE WHEN n <= {linerules.MENU_WORDS} THEN 'navigation' ELSE 'punctuation' END END AS rule FROM a),
 g AS (SELECT doc_id, count(*) FILTER (again) AS dup, {', '.join(f"coalesce(sum(n) FILTER (rule = '{r}'), 0) AS lost_{r}" for r in linerules.RULES)} FROM j GROUP BY 1),
 v AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS win FROM d),
 c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM v), q AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE k > 1) GROUP BY 1),
 o AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[{_SPACE}]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words,
  {', '.join(f'coalesce(lost_{r}, 0)::BIGINT AS lost_{r}' for r in linerules.RULES)} FROM d LEFT JOIN g USING (doc_id) LEFT JOIN q USING (doc_id)),
 b AS (SELECT *, n_words < {linerules.MIN_WORDS} OR 100 * n_repeat_words > {linerules.MAX_REPEATED} * n_words AS base_failed, ({' + '.join(f'lost_{r}' for r in linerules.RULES)})::BIGINT AS lost_words FROM o)
 SELECT *, NOT base_failed AND 100 * lost_words <= {linerules.MAX_LOST} * n_words AS kept FROM b"""


def op11_fill_in_middle() -> str:
    p, s, m = map(_quote, (fim.PREFIX, fim.SUFFIX, fim.MIDDLE))
    h = ", ".join(f"('0x' || substr(x, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
 h AS (SELECT *, {h} FROM d), c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m}) OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
 k AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c)
 SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || pre || {s} || suf || {m} || mid ELSE {s} || suf || {p} || pre || {m} || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM k"""


def op12_prefix_trie() -> str:
    crc = "xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT] || repeat([-1::BIGINT], 8))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    return rf"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
 z AS (SELECT conv_id, max(i) AS n FROM t GROUP BY 1), h AS (SELECT conv_id, {crc} % 4 AS h FROM z), g AS (SELECT h.conv_id, h, h.conv_id - h.conv_id % 20 AS base, least(h, coalesce(n, 0)) AS taken FROM h LEFT JOIN z ON z.conv_id = h.conv_id - h.conv_id % 20),
 r AS (SELECT t.conv_id, i - h + taken AS d, role, text FROM t JOIN g USING (conv_id) WHERE i > h UNION ALL SELECT g.conv_id, i, role, text FROM g JOIN t ON t.conv_id = g.base AND i <= taken),
 k AS (SELECT conv_id, d AS depth, len(regexp_extract_all(text, '[^{_SPACE}]+')) AS words, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r),
 p AS (SELECT conv_id, depth, words, k, CASE WHEN depth = 1 THEN '' ELSE lag(k) OVER (PARTITION BY conv_id ORDER BY depth) END AS up FROM k UNION ALL SELECT conv_id, 0, 0, '', NULL FROM g),
 n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, max(up) AS up FROM p GROUP BY 1, 2), c AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
 m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, k)),
 s AS (SELECT p.depth, p.k, sum((n_convs - 1) * m.words) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY 1, 2),
 l AS (SELECT conv_id, max(depth) AS depth, arg_max(k, depth) AS k FROM p GROUP BY 1), e AS (SELECT depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM l GROUP BY 1, 2)
 SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
 FROM m JOIN s USING (depth, k) LEFT JOIN e USING (depth, k) LEFT JOIN n q ON q.depth = m.depth - 1 AND q.k = m.up"""


SQL = {f.__name__: f() for f in (op1_chat_format, op2_minhash_near_dedup, op9_line_rules, op11_fill_in_middle, op12_prefix_trie)}
