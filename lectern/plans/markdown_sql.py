"""Markdown blocks as SQL: a fold over a document's lines gives each its role, windows gather the rest."""

from __future__ import annotations


def blocks_sql(source: str, inline, normal, caption: str, number: str, known: str) -> str:
    """CTEs over `source` (doc_id, t), for WITH: mblocks (doc_id, block_id, kind, text, number, heading, rows). inline, normal: SQL of an expression's inline rewrites and white space."""
    return rf"""
raw AS (SELECT doc_id, unnest(range(len(l))) AS i, regexp_replace(unnest(l), '\s+$', '') AS line FROM (SELECT doc_id, string_split(replace(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(9), '    '), chr(10)) AS l FROM {source})),
bare AS (SELECT doc_id, i, line, trim(line) AS b FROM raw),
typed AS (SELECT *, CASE WHEN b = '' THEN 'blank' WHEN regexp_matches(b, '^(```|~~~)') THEN 'fence' WHEN regexp_matches(b, '^(\$\$|\\\[)') THEN 'formula' WHEN regexp_matches(b, '^#{{1,6}}\s+.') THEN 'head' WHEN regexp_matches(b, '^(-{{3,}}|\*{{3,}}|_{{3,}})$') THEN 'rule'
 WHEN regexp_matches(b, '^!\[[^\]]*\]\([^)]*\)\s*$') OR regexp_matches(b, '(?i)^<img\b') THEN 'rule' WHEN b LIKE '|%' OR regexp_matches(b, '\S\s*\|\s*\S') THEN 'row' WHEN regexp_matches(b, '^\[\^[^\]]+\]:\s*') THEN 'note' WHEN regexp_matches(b, '^([-*+]|[0-9]+[.)])\s+') THEN 'item' ELSE 'para' END AS role FROM bare),
listed AS (SELECT doc_id, list({{'role': role, 'b': b, 'state': '', 'n': 0, 'out': []::VARCHAR[]}} ORDER BY i) AS l FROM typed GROUP BY doc_id),
-- state: open fence or formula; n: lines of the open paragraph; out: the role of each line in its place
folded AS (SELECT doc_id, list_reduce(list_prepend({{'role': '', 'b': '', 'state': '', 'n': 0, 'out': []::VARCHAR[]}}, l), lambda a, e: CASE
 WHEN a.state = 'code' THEN {{'role': '', 'b': '', 'state': CASE WHEN e.role = 'fence' THEN '' ELSE 'code' END, 'n': 0, 'out': list_append(a.out, CASE WHEN e.role = 'fence' THEN 'shut' ELSE 'code' END)}}
 WHEN a.state = 'equation' THEN {{'role': '', 'b': '', 'state': CASE WHEN regexp_matches(e.b, '\$\$\s*$|^\\\]\s*$') THEN '' ELSE 'equation' END, 'n': 0, 'out': list_append(a.out, 'equation')}}
 WHEN e.role <> 'blank' AND regexp_matches(e.b, '^(=+|-{{3,}})$') AND a.n = 1 THEN {{'role': '', 'b': '', 'state': '', 'n': 0, 'out': list_append(a.out, 'under')}}
 WHEN e.role = 'fence' THEN {{'role': '', 'b': '', 'state': 'code', 'n': 0, 'out': list_append(a.out, 'open')}}
 WHEN e.role = 'formula' AND length(e.b) > 4 AND regexp_matches(substr(e.b, 3), '\$\$\s*$|\\\]\s*$') THEN {{'role': '', 'b': '', 'state': '', 'n': 0, 'out': list_append(a.out, 'formula')}}
 WHEN e.role = 'formula' THEN {{'role': '', 'b': '', 'state': 'equation', 'n': 0, 'out': list_append(a.out, 'begin')}}
 ELSE {{'role': '', 'b': '', 'state': '', 'n': CASE e.role WHEN 'para' THEN a.n + 1 WHEN 'item' THEN 1 ELSE 0 END, 'out': list_append(a.out, e.role)}} END).out AS roles FROM listed),
lines AS (SELECT t.doc_id, i, line, b, f.roles[i + 1] AS role, f.roles[i + 2] AS after FROM typed t JOIN folded f USING (doc_id)),
-- a unit begins where a line doesn't go on with the one before
units AS (SELECT *, sum(CASE WHEN (role = 'para' AND prev IN ('para', 'item')) OR (role = 'code' AND prev IN ('open', 'code')) OR (role = 'equation' AND prev IN ('begin', 'equation')) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS unit
 FROM (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM lines)),
said AS (SELECT *, CASE role WHEN 'item' THEN regexp_replace(b, '^([-*+]|[0-9]+[.)])\s+', '') WHEN 'para' THEN regexp_replace(b, '^>\s?', '') WHEN 'note' THEN regexp_replace(b, '^\[\^[^\]]+\]:\s*', '') WHEN 'head' THEN regexp_replace(regexp_replace(b, '^#{{1,6}}\s+', ''), '\s*#*$', '') WHEN 'code' THEN line
 WHEN 'open' THEN '' ELSE regexp_replace(b, '\$\$|\\\]|^\\\[', '', 'g') END AS s FROM units),
rewritten AS (SELECT *, CASE WHEN role IN ('item', 'para', 'note', 'head') THEN {inline('s')} ELSE s END AS x FROM said),
joined AS (SELECT doc_id, unit, min(i) AS i, first(role ORDER BY i) AS role, last(after ORDER BY i) AS after, first(b ORDER BY i) AS b, string_agg(x, chr(10) ORDER BY i) AS x FROM rewritten GROUP BY doc_id, unit),
gathered AS (SELECT doc_id, i, b, CASE WHEN role IN ('para', 'item') AND after = 'under' THEN 'head' WHEN role = 'item' THEN 'para' WHEN role IN ('open', 'code') THEN 'code' WHEN role IN ('begin', 'formula', 'equation') THEN 'equation' ELSE role END AS role,
 {normal(r"replace(regexp_replace(regexp_replace(x, '([A-Za-z])-\n([a-z])', '\1\2', 'g'), '([A-Za-z])-\n([a-z])', '\1\2', 'g'), chr(10), ' ')")} AS x FROM joined WHERE role NOT IN ('blank', 'rule', 'shut', 'under')),
sound AS (SELECT * FROM gathered WHERE (role <> 'row' AND x <> '') OR (role = 'row' AND NOT regexp_matches(b, '^\|?\s*:?-{{2,}}'))),
facts AS (SELECT *, trim(regexp_extract(x, {number}, 1)) AS num, regexp_replace(trim(regexp_replace(x, {number}, '')), '\s*[.:]$', '') AS rest FROM sound),
heads AS (SELECT *, regexp_matches(rest, {known}) AS listed, regexp_matches(x, {caption}) AS cap, length(x) <= 80 AND NOT regexp_matches(x, '[.!?,;:]$') AND regexp_matches(x, '^[A-Z0-9]') AND (num <> '' OR regexp_matches(rest, {known})
 OR (2 * len(list_filter(regexp_split_to_array(rest, '\s+'), lambda w: regexp_matches(w, '^[A-Z]'))) >= len(regexp_split_to_array(rest, '\s+')) AND len(regexp_split_to_array(rest, '\s+')) <= 8)) AS short FROM facts),
placed AS (SELECT *, row_number() OVER d AS place, lag(role) OVER d AS prev, first_value(role = 'head' AND NOT listed OR (role = 'para' AND short AND NOT listed AND NOT cap)) OVER d AS titled FROM heads WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
named AS (SELECT *, coalesce(role = 'para' AND place = 2 AND titled AND NOT cap AND length(x) < 160 AND NOT regexp_matches(x, '[.!?]$'), false) AS authors FROM placed),
modes AS (SELECT *, coalesce(last_value(CASE WHEN role = 'head' THEN listed WHEN role = 'para' AND short AND listed AND NOT cap AND NOT authors THEN true END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS refs FROM named),
kinds AS (SELECT *, CASE WHEN role = 'row' THEN 'table' WHEN role IN ('code', 'equation') THEN role WHEN role = 'note' THEN 'footnote' WHEN role = 'head' THEN CASE WHEN listed THEN 'reference' ELSE 'heading' END WHEN cap THEN 'caption' WHEN refs THEN 'entry'
 WHEN authors THEN 'authors' WHEN short THEN CASE WHEN listed THEN 'reference' ELSE 'heading' END ELSE 'body' END AS kind FROM modes),
tables AS (SELECT *, sum(CASE WHEN role = 'row' AND prev = 'row' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM kinds),
cells AS (SELECT doc_id, part, list(list_filter(list_transform(string_split(regexp_replace(regexp_replace(b, '^\|', ''), '\|$', ''), '|'), lambda c: {normal(inline('c'))}), lambda c: c <> '') ORDER BY i) AS rows FROM tables WHERE role = 'row' GROUP BY doc_id, part),
whole AS (SELECT t.*, c.rows FROM tables t LEFT JOIN cells c USING (doc_id, part) WHERE role <> 'row' OR prev IS DISTINCT FROM 'row'),
split AS (SELECT *, CASE WHEN kind = 'entry' THEN string_split(regexp_replace(x, '\s+(\[[0-9]+\]\s)', chr(1) || '\1', 'g'), chr(1)) WHEN rows IS NOT NULL THEN [array_to_string(list_transform(rows, lambda r: array_to_string(r, ', ')), '. ')]
 WHEN kind IN ('heading', 'reference') THEN [rest] ELSE [x] END AS texts FROM whole),
out AS (SELECT doc_id, i, unnest(range(len(texts))) AS j, CASE kind WHEN 'entry' THEN 'reference' ELSE kind END AS kind, trim(unnest(texts)) AS text, CASE WHEN kind IN ('heading', 'reference') AND num <> '' THEN num END AS number, kind = 'reference' AS heading, rows FROM split),
mblocks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS block_id, kind, text, number, heading, rows FROM out WHERE text <> '' OR rows IS NOT NULL)"""
