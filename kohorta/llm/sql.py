"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"


def _words(pattern: str, column: str = "text") -> str:
    return f"regexp_extract_all({_LOWER.format(f"coalesce({column}, '')")}, '{pattern}')"


SQL = {
    "op7_near_duplicates": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_words(_SPACE)} AS w FROM documents),
runs AS (
  SELECT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(list_slice(w, k, k + 3), ' ') for k in range(1, len(w) - 2)] END) AS s
  FROM words),
shingles AS (SELECT DISTINCT doc_id, s FROM runs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.other),
roots AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN roots r ON r.node = d.doc_id
""",
    "op8_warc_index": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
""",
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {_words(_ALNUM)} AS w FROM documents),
i AS (SELECT item_id, {_words(_ALNUM)} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size,
    unnest([array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') for k in range(1, len(w) - least(10, len(w)) + 2)]) AS win
  FROM i WHERE len(w) > 0),
lengths AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d, lengths WHERE len(w) >= size),
hits AS (
  SELECT x.doc_id, x.pos, x.size, y.item_id FROM doc_windows x
  JOIN item_windows y ON x.size = y.size AND y.win = array_to_string(list_slice(x.w, x.pos, x.pos + x.size - 1), ' ')),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
""",
    "op11_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_ALNUM)} AS w FROM documents),
totals AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
counts AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM counts, totals GROUP BY term, n_docs),
impacts AS (
  SELECT r, doc_id, c.term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs)::BIGINT // n_terms::BIGINT))) AS gain
  FROM counts c JOIN weights USING (term), totals),
q AS (SELECT row_number() OVER () AS k, item_id, {_words(_ALNUM)} AS w FROM benchmark),
asked AS (SELECT k, item_id, term, count(*) AS times FROM (SELECT k, item_id, unnest(w) AS term FROM q) GROUP BY ALL),
scores AS (
  SELECT k, item_id, r, doc_id, sum(times * gain)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY k, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
sums AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, [ascii(k[i])::BIGINT for i in range(1, length(k) + 1)]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM sums WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    lag(role[1]) OVER w AS earlier, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (
  SELECT *, last_char = '' AS blank, last_char <> '' AND nth > 1 AS dup,
    last_char <> '' AND nth = 1 AND last_char NOT IN ('.', '!', '?') AS trunc FROM placed),
inserts(source, pre, mid, paid) AS (
  VALUES (0, '', 0, 0), (0, 'I', 2, 2), (0, 'II', 3, 4), (1, '', 1, 0), (1, 'I', 2, 2), (1, 'II', 3, 4),
    (2, '', 2, 0), (2, 'I', 3, 2), (3, '', 3, 0), (3, 'I', 2, 2)),
keeps(mid, initial, target) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edges AS (
  SELECT conv_id, i, source, mid AS target, paid + 3 AS cost, pre || 'D' AS label FROM faults, inserts
  UNION ALL SELECT conv_id, i, source, CASE mid WHEN 2 THEN 3 ELSE 2 END, paid + 2 + trunc::INTEGER, pre || 'R'
    FROM faults, inserts WHERE NOT blank AND NOT dup
  UNION ALL SELECT conv_id, i, source, target, paid + trunc::INTEGER, pre || 'K'
    FROM faults, inserts JOIN keeps USING (mid) WHERE role[1] = initial AND NOT blank AND NOT dup),
cells AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0, 'audit': ''} AS best FROM conversations
  UNION ALL
  SELECT c.conv_id, c.i + 1, target, min({'cost': c.best.cost + e.cost, 'audit': c.best.audit || e.label})
  FROM cells c JOIN edges e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = c.i + 1 AND e.source = c.state
  GROUP BY c.conv_id, c.i, target),
lengths AS (SELECT conv_id, max(i) AS n FROM cells GROUP BY conv_id),
ends(state, rest, more) AS (VALUES (0, '', 0), (3, '', 0), (2, 'I', 2), (1, 'II', 4)),
plans AS (
  SELECT c.conv_id, min({'cost': best.cost + more, 'audit': best.audit || rest}) AS best
  FROM cells c JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.n = c.i JOIN ends USING (state) GROUP BY c.conv_id),
edits AS (SELECT conv_id, unnest(range(1, length(best.audit) + 1)) AS j, best.audit AS audit FROM plans),
marked AS (
  SELECT conv_id, j, audit[j] AS edit, sum((audit[j] <> 'I')::BIGINT) OVER w AS i, sum((audit[j] <> 'D')::BIGINT) OVER w AS place
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
lines AS (
  SELECT m.conv_id, j, edit, place, f.role AS own, f.text AS own_text,
    first_value(CASE WHEN edit = 'K' THEN f.role[1] END) OVER (PARTITION BY m.conv_id ORDER BY j) AS opening
  FROM marked m LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i WHERE edit <> 'D'),
hashes AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN edit = 'K' THEN own WHEN (place + (opening IS NOT DISTINCT FROM 's')::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE own_text END, chr(10) ORDER BY j)) AS digest
  FROM lines GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::BIGINT) AS blank,
    sum(dup::BIGINT) AS duplicate, sum(trunc::BIGINT) AS truncated,
    sum((i > 1 AND earlier || role[1] NOT IN ('su', 'ua', 'au'))::BIGINT) AS illegal
  FROM faults GROUP BY conv_id)
SELECT p.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, p.best.cost::BIGINT AS cost, p.best.audit AS audit,
  coalesce(digest, sha256('')) AS repaired_sha256
FROM plans p LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
""",
}
