"""DuckDB SQL for the operators that SQL can express; the others are held against brute force in the tests."""

from __future__ import annotations

from rastertable.llm import chat, license_scan


def license_sql() -> str:
    """The license scan, word by word and without the index."""
    found = license_scan.templates()
    posts = ", ".join(f"({t.number}, {i}, '{w}', {1 if t.mandatory(i) else 0})" for t in found for i, w in enumerate(t.words))
    facts = ", ".join(f"({t.number}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {len(t.key)})" for t in found)
    return rf"""
WITH posts(template, spot, word, mandatory) AS (VALUES {posts}), facts(template, label, base, n, n_key) AS (VALUES {facts}),
lists AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
words AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM lists),
met AS (SELECT * FROM (SELECT doc_id, template, pos - spot AS start, count(*) AS matched, sum(mandatory) AS keyed FROM words JOIN posts USING (word) GROUP BY ALL) JOIN facts USING (template) WHERE keyed = n_key),
hits AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(matched/n) AS score FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM lists LEFT JOIN hits USING (doc_id)"""


def chat_sql() -> str:
    """Chat formatting for tables whose turns are unique in a conversation; passages of all four kinds and shingles, threads by recursion."""
    return rf"""
WITH RECURSIVE m AS (SELECT conv_id AS conv, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT conv, turn, string_split(text, chr(10)) AS ls FROM m), l AS (SELECT conv, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM k),
p AS (SELECT conv, turn, i, len(replace(regexp_extract(line, '^(?: ?>)+'), ' ', '')) AS level, trim(regexp_replace(lower(regexp_replace(line, '^(?: ?>)+', '')), '\s+', ' ', 'g')) AS body FROM l),
g AS (SELECT *, CASE WHEN i = 1 OR body = '' OR lag(body) OVER w = '' OR lag(level) OVER w <> level THEN 1 ELSE 0 END AS begins FROM p WINDOW w AS (PARTITION BY conv, turn ORDER BY i)),
h AS (SELECT *, sum(begins) OVER (PARTITION BY conv, turn ORDER BY i) AS block FROM g),
j AS (SELECT conv, turn, min(level) AS level, string_agg(body, ' ' ORDER BY i) AS body FROM h GROUP BY conv, turn, block),
z AS (SELECT conv, turn, level, unnest(string_split(regexp_replace(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1))) AS body FROM j),
q AS (SELECT DISTINCT * FROM (SELECT conv, turn, CASE WHEN len(body) >= {chat.LEAST_CHARS} THEN 0 ELSE 3 END AS kind, level, body FROM p UNION ALL SELECT conv, turn, 1, level, body FROM j UNION ALL SELECT conv, turn, 2, level, body FROM z WHERE len(body) >= {chat.LEAST_CHARS}) WHERE body <> ''),
s AS (SELECT a.conv, a.turn, a.kind, a.level, a.body, max(b.turn) AS source FROM q a JOIN q b ON a.conv = b.conv AND a.kind = b.kind AND a.body = b.body AND b.level = 0 AND b.turn < a.turn WHERE a.level > 0 GROUP BY ALL),
v AS (SELECT conv, turn, kind, level, source, count(*) AS n FROM s GROUP BY ALL),
one AS (SELECT conv, turn, source AS parent FROM v QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY kind, level, n DESC, source DESC) = 1),
w AS (SELECT conv, turn, level, regexp_extract_all(body, '{chat._WORD}') AS ws FROM j),
e AS (SELECT conv, turn, level, unnest(list_transform(range(1, len(ws) - {chat.SHINGLE - 2}), lambda i: ws[i:i + {chat.SHINGLE - 1}])) AS sh FROM w),
d AS (SELECT DISTINCT * FROM e WHERE NOT list_bool_or(list_transform(sh, lambda x: regexp_matches(x, '{chat._OMISSION}')))),
y AS (SELECT d.*, count(*) OVER (PARTITION BY conv, turn, level) AS total FROM d LEFT JOIN one USING (conv, turn) WHERE level > 0 AND parent IS NULL),
r AS (SELECT a.conv, a.turn, a.level, a.sh, total, max(b.turn) AS source FROM y a JOIN d b ON a.conv = b.conv AND a.sh = b.sh AND b.level = 0 AND b.turn < a.turn GROUP BY ALL),
x AS (SELECT conv, turn, level, source, total, count(*) AS n FROM r GROUP BY ALL HAVING 2 * count(*) >= total),
up AS (SELECT * FROM one UNION ALL SELECT conv, turn, source FROM x QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY level, n DESC, source DESC) = 1),
t AS (SELECT m.conv, m.turn, m.turn AS root, 0 AS depth FROM m LEFT JOIN up USING (conv, turn) WHERE parent IS NULL UNION ALL SELECT up.conv, up.turn, t.root, t.depth + 1 FROM up JOIN t ON up.conv = t.conv AND up.parent = t.turn),
o AS (SELECT m.*, parent, row_number() OVER (PARTITION BY m.conv ORDER BY root, depth, m.turn) - 1 AS position FROM m JOIN t USING (conv, turn) LEFT JOIN up USING (conv, turn)),
f AS (SELECT conv, position, parent, role, string_split(text, chr(10)) AS ls FROM o),
c AS (SELECT conv, position, parent, role, trim(array_to_string(list_filter(ls, lambda x, i: NOT regexp_matches(x, '^(?: ?>)+') AND NOT (regexp_matches(x, 'wrote:\s*$') AND regexp_matches(coalesce(ls[i + 1], ''), '^(?: ?>)+'))), chr(10)), concat(' ', chr(9), chr(10), chr(13))) AS content FROM f)
SELECT conv AS conv_id, CAST(floor(position/{chat.SEGMENT}) AS BIGINT) AS segment, count(*) AS n_messages, count(parent) AS n_linked, string_agg(concat('<|im_start|>', role, chr(10), content, '<|im_end|>', chr(10)), '' ORDER BY position) AS chat
FROM c GROUP BY 1, 2"""


ORACLE_SQL = {"op2_license_scan": license_sql(), "op7_chat": chat_sql()}
