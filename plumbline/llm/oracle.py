"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

#: Shared by the windows of op3: words of each text, and those in windows of n words found twice or more in it.
_OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
sizes(n) AS (VALUES (5), (6), (31)),
win AS (
  SELECT doc_id, n, i, list_aggregate(ws[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes)
),
twice AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, g) AS c FROM win) WHERE c > 1),
hit AS (SELECT doc_id, n, count(DISTINCT j) AS k FROM (SELECT doc_id, n, unnest(range(i, i + n)) AS j FROM twice) GROUP BY doc_id, n),
lines AS (
  SELECT doc_id, sum(c - 1)::BIGINT AS k FROM (
    SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)
  GROUP BY doc_id
),
base AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.k, 0)::BIGINT AS n_dup_lines, coalesce(h5.k, 0)::BIGINT AS n_repeat_words,
    coalesce(h6.k, 0) AS covered, h31.k IS NOT NULL AS too_long
  FROM w LEFT JOIN lines ON w.doc_id = lines.doc_id
    LEFT JOIN hit h5 ON w.doc_id = h5.doc_id AND h5.n = 5
    LEFT JOIN hit h6 ON w.doc_id = h6.doc_id AND h6.n = 6
    LEFT JOIN hit h31 ON w.doc_id = h31.doc_id AND h31.n = 31
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT too_long AND covered <= 0.2 * n_words AS kept
FROM base
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
items AS (SELECT DISTINCT item_id, n, list_aggregate(ws[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0))),
sizes AS (SELECT DISTINCT n FROM items),
win AS (SELECT doc_id, n, i, list_aggregate(ws[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
found AS (SELECT doc_id, item_id, win.n AS n, i FROM win JOIN items ON win.n = items.n AND win.g = items.g),
hit AS (SELECT doc_id, count(DISTINCT j) AS k FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.k, 0)::BIGINT AS n_hit, coalesce(named.k, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.k, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""

_OP1 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (SELECT *, CASE role WHEN 'user' THEN 'User' WHEN 'system' THEN 'System' WHEN 'assistant' THEN 'Assistant' ELSE role END AS name,
  length(text) + length(text) - length(replace(replace(text, '\', ''), '#', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(name) + 2 + n + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(ws[i:i + least(len(ws), 5) - 1], 'string_agg', ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS component FROM w UNION SELECT e.b, r.component FROM r JOIN e ON r.doc_id = e.a AND r.component < e.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(component) FROM r WHERE r.doc_id = w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""

_OP11 = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
r AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT k, max_by(rules.host || rules.path, length(rules.host || rules.path)) AS rule, max_by(verdict, length(rules.host || rules.path)) AS verdict
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.k = f.k
"""

#: States: 0 start, 1 after system, 2 after user, 3 after assistant. Costs and strings are kept together, the least for each state after each row.
_OP13 = r"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: list_reduce(range(8), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS h
  FROM conversations),
e AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended FROM e),
r AS (SELECT *, left(role, 1) AS c, CASE WHEN ended = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
fill(q, k, q2) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
edit(q, letter, needs, cost, q2) AS (VALUES (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3), (3, 'K', 'u', 0, 2), (0, 'R', '', 1, 2), (1, 'R', '', 1, 2), (2, 'R', '', 1, 3), (3, 'R', '', 1, 2), (0, 'D', '', 2, 0), (1, 'D', '', 2, 1), (2, 'D', '', 2, 2), (3, 'D', '', 2, 3)),
move AS (SELECT f.q, repeat('I', k) || letter AS letters, letter, needs, 5 * k + cost AS cost, e.q2 AS to_q FROM fill f JOIN edit e ON f.q2 = e.q),
step AS (
  SELECT DISTINCT conv_id, 1::BIGINT AS i, 0 AS q, {'c': 0::BIGINT, 'a': ''} AS best FROM conversations
  UNION ALL
  SELECT s.conv_id, s.i + 1, m.to_q, min({'c': s.best.c + m.cost + CASE WHEN m.letter <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END, 'a': s.best.a || m.letters})
  FROM step s JOIN r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.i = r.i JOIN move m ON m.q = s.q AND (m.needs = '' OR m.needs = r.c) AND (m.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY s.conv_id, s.i, m.to_q),
ends AS (SELECT conv_id, max(i) AS i FROM step GROUP BY conv_id),
best AS (SELECT s.conv_id, min({'c': best.c + 5 * k, 'a': best.a || repeat('I', k)}) AS b FROM step s JOIN ends ON s.conv_id IS NOT DISTINCT FROM ends.conv_id AND s.i = ends.i JOIN fill f ON f.q = s.q WHERE f.q2 IN (0, 3) GROUP BY s.conv_id),
letters AS (SELECT conv_id, b.a AS a, unnest(range(1, length(b.a) + 1)) AS j FROM best),
walk AS (SELECT conv_id, j, substr(a, j, 1) AS letter, length(replace(left(a, j), 'I', '')) AS i FROM letters),
said AS (SELECT w.conv_id, j, letter, r.role, r.c, r.text, row_number() OVER (PARTITION BY w.conv_id ORDER BY j) AS n FROM walk w LEFT JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i = r.i WHERE letter <> 'D'),
first AS (SELECT conv_id, bool_or(n = 1 AND letter = 'K' AND c = 's') AS led FROM said GROUP BY conv_id),
lines AS (SELECT s.conv_id, n, CASE WHEN letter = 'K' THEN role WHEN (n + led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END AS line FROM said s JOIN first f ON s.conv_id IS NOT DISTINCT FROM f.conv_id),
whole AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY n)) AS sha FROM lines GROUP BY conv_id),
pairs AS (SELECT conv_id, c || coalesce(lead(c) OVER (PARTITION BY conv_id ORDER BY i), '-') AS p, i, max(i) OVER (PARTITION BY conv_id) AS n FROM r),
illegal AS (SELECT conv_id, count(*) FILTER (i < n AND p NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM r GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  b.b.c::BIGINT AS cost, b.b.a AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN illegal x ON b.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN whole w ON b.conv_id IS NOT DISTINCT FROM w.conv_id
"""

SQL = {"op9_jaccard_join": _OP9, "op1_warc_bundles": _OP1, "op6_chat_formatting": _OP6, "op3_quality_rules": _OP3, "op5_benchmark_decontamination": _OP5, "op11_url_filter": _OP11, "op13_conversation_repair": _OP13}
