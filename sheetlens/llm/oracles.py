"""SQL of the training-data queries that SQL can express whole; the others are tested against brute force."""

from __future__ import annotations

import string

from .chatformat import END, ESCAPED, RAW, SEP
from .urlgraph import RULES

_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase
_FITS = {(v, h, p): f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for v, h, p in RULES}
_LONGEST = sorted(_FITS, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

#: Rules, and the seeds' verdicts: the tables' pages hold no link to another host (the first
#: column fails where one does), so that propagation leaves the scores of the seeds.
URLS = f"""WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 r AS (SELECT page_id, host, path, CASE {' '.join(f"WHEN {_FITS[k]} THEN '{k[1] + k[2]}'" for k in _LONGEST)} END AS rule, CASE {' '.join(f"WHEN {_FITS[k]} THEN '{k[0]}'" for k in _LONGEST)} END AS judged FROM h),
 s AS (SELECT host, avg((coalesce(judged, '') = 'allow')::INT) AS t, avg((coalesce(judged, '') = 'block')::INT) AS d FROM r WHERE host <> '' GROUP BY host),
 m AS (SELECT host, t / nullif(sum(t) OVER (), 0) AS t, d / nullif(sum(d) OVER (), 0) AS d FROM s),
 x AS (SELECT count(*) AS links FROM h WHERE len(list_filter(regexp_extract_all(html, 'href\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1), lambda l: starts_with(l, '//') OR contains(l, '://'))) > 0),
 w AS (SELECT r.*, coalesce(d / nullif(coalesce(t, 0) + d, 0), 0.0) AS share FROM r LEFT JOIN m ON r.host = m.host)
 SELECT CASE WHEN (SELECT links FROM x) = 0 THEN page_id ELSE error('pages link to other hosts') END AS page_id, host, path, rule, coalesce(judged, CASE WHEN share >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
 floor(share * 1e6 + 0.5) / 1e6 AS distrust FROM w"""

#: All pairs, which is for small tables only.
VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
 ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
 c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
 SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON v.vec_id = c.vec_id LEFT JOIN n ON v.vec_id = n.vec_id"""


def _escaped(x: str) -> str:
    for a, b in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_SAID = "\\### Assistant: </turn> ok"
#: A turn is escaped if its text or role holds a control string; the rest is taken from the source.
CHATS = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
 c AS (SELECT *, contains(text, '</turn>') OR contains(text, '###') OR contains(role, '</turn>') OR contains(role, '###') OR contains(role, '{SEP}') OR ends_with(role, ':') AS conflict FROM t),
 f AS (SELECT *, CASE WHEN conflict THEN {len(ESCAPED) + len(SEP) + len(END)} + length({_escaped('role')}) + length({_escaped('text')}) ELSE {len(RAW) + len(SEP) + len(END)} + length(role) + length(text) END AS size FROM c)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(size) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""

COPIES = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS t FROM documents),
 g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
 SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t"""

_H = [f"CAST('0x' || substring(h, {8 * i + 1}, 8) AS BIGINT)" for i in range(4)]
#: Outputs are arranged from the cuts; what is restored from them must be the text.
MIDDLES = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 c AS (SELECT doc_id, t, n, least({_H[0]} % (n + 1), {_H[1]} % (n + 1)) AS a, greatest({_H[0]} % (n + 1), {_H[1]} % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_H[2]} % 100 >= 90 THEN 'plain' WHEN {_H[3]} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: crc32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split(x::VARCHAR, ''), lambda q: ascii(q)::BIGINT), lambda c, b: list_reduce(range(8), lambda k, u: xor(k >> 1, 3988292384 * (k & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"
#: A node is the list of turns up to it; nodes of a smallest member's path are the ancestors.
TRIE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, h.h FROM (SELECT DISTINCT conv_id, conv_id AS x, ({_CRC}) % 4 AS h FROM t) h),
 r AS (SELECT c.conv_id, t.d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.d <= c.h UNION ALL SELECT c.conv_id, t.d, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.d > c.h),
 o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY d) AS d, role, text FROM r),
 p AS (SELECT conv_id, d, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY d) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM o UNION ALL SELECT conv_id, 0, [], 0 FROM c),
 e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS at_end FROM p),
 n AS (SELECT d AS depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256 FROM e GROUP BY 1, 2),
 m AS (SELECT e.conv_id AS member, e.d, n.conv_id FROM e JOIN n ON e.d = n.depth AND e.k = n.k),
 q AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN m u ON u.member = n.conv_id AND u.d = n.depth - 1),
 ch AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS c FROM q WHERE depth > 0 GROUP BY 1, 2),
 l AS (SELECT q.conv_id, q.depth, (ch.c IS NULL)::INT AS leaf, (q.n_convs - 1) * q.w AS saved FROM q LEFT JOIN ch USING (conv_id, depth)),
 s AS (SELECT m.conv_id, m.d AS depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM l JOIN m ON m.member = l.conv_id AND m.d <= l.depth GROUP BY 1, 2)
 SELECT q.conv_id, q.depth, parent_conv_id, n_convs, coalesce(ch.c, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
 FROM q JOIN s USING (conv_id, depth) LEFT JOIN ch USING (conv_id, depth)"""

ORACLES: dict[str, str] = {"op2_url_filter": URLS, "op6_embedding_dedup": VECTORS, "op9_chat_format": CHATS, "op11_exact_dedup": COPIES, "op12_fill_in_middle": MIDDLES, "op13_prefix_trie": TRIE}
