"""Sentence splitting and chunking as SQL, by a fold over pieces that end in stops; it shares no constant with the operator."""

from __future__ import annotations

_CLOSERS = """.!?…"''’”)\\]}"""
_MARKS = rf"[.!?…][{_CLOSERS}]*\s*$"
# Words after which a full stop doesn't end a sentence.
_SHORT = (
    "al alg ann app appl approx appx apr assoc aug avg biol ca cf ch chap chem co comput conf cont cor dec def dept dr e.g ed eds eng eq eqs est et etc ex fig figs fn i.e ibid inc inst int jan jr jul jun lem ltd"
    " a.k.a acad mar max min misc mr mrs ms mt natl no nos nov oct op p ph ph.d pg phys pp proc prof prop ref refs rep resp rev sci sec secs sep sept seq soc sqrt sr st std tab tech thm trans u.k u.s univ ver viz vol vols vs w.r.t"
)


def _stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _last(mark: str, width: int) -> str:
    """Place of the last `mark` in w from 0, -1 if none."""
    return f"CASE WHEN strpos(reverse(w), '{mark[::-1]}') = 0 THEN -1 ELSE length(w) - strpos(reverse(w), '{mark[::-1]}') - {width - 1} END"


def parts_sql(source: str) -> str:
    """CTEs over `source` (k, t), for WITH RECURSIVE: parts (k, i, j, part), sentence i of text k in chunks j."""
    return rf"""
pieces AS (SELECT k, t, regexp_extract_all(t, '[^.!?…]*[.!?…][{_CLOSERS}]*\s*') AS p FROM {source}),
heads AS (SELECT k, p, substr(t, length(array_to_string(p, '')) + 1) AS rest FROM pieces),
marked AS (SELECT k, rest, list_transform(range(1, len(p) + 1), lambda i: {{'piece': p[i], 'next': coalesce(left(nullif(p[i + 1], ''), 1), left(rest, 1)), 'stop': substr(p[i], length(regexp_extract(p[i], '^[^.!?…]*')) + 1, 1),
  'word': regexp_replace(regexp_extract(array_to_string(p[1:i], ''), '(\S*?){_MARKS}', 1), '^[(\["''“‘]+', '')}}) AS m FROM heads),
told AS (SELECT k, rest, list_transform(m, lambda e: {{'sofar': '', 'cuts': []::VARCHAR[], 'piece': e.piece, 'dot': e.stop = '.',
  'ends': e.next <> '' AND CASE WHEN regexp_matches(e.piece, '\s$') THEN NOT regexp_matches(e.next, '[a-z]') ELSE e.stop = '.' AND regexp_matches(e.next, '[A-Z]') AND regexp_full_match(e.word, '[a-z]{{4,}}') END
   AND NOT (e.stop = '.' AND (list_contains(string_split('{_SHORT}', ' '), lower(e.word)) OR list_contains(string_split('{_SHORT}', ' '), regexp_replace(lower(e.word), '\.$', '')) OR regexp_full_match(e.word, '([A-Za-z]\.)*[A-Za-z]'))),
  'section': regexp_full_match(e.word, '[0-9]+(\.[0-9]+)*')}}) AS m FROM marked),
held AS (SELECT k, rest, list_reduce(m, lambda a, e: CASE WHEN e.ends AND NOT (e.dot AND (regexp_full_match({_stripped(f"regexp_replace(a.sofar || e.piece, '{_MARKS}', '')")}, '[0-9]+') OR (e.section AND length({_stripped(f"regexp_replace(a.sofar || e.piece, '{_MARKS}', '')")}) < 8)))
  THEN {{'sofar': '', 'cuts': list_append(a.cuts, {_stripped('a.sofar || e.piece')}), 'piece': '', 'dot': false, 'ends': false, 'section': false}}
  ELSE {{'sofar': a.sofar || e.piece, 'cuts': a.cuts, 'piece': '', 'dot': false, 'ends': false, 'section': false}} END,
  {{'sofar': '', 'cuts': []::VARCHAR[], 'piece': '', 'dot': false, 'ends': false, 'section': false}}) AS h FROM told),
said AS (SELECT k, list_filter(list_append(h.cuts, {_stripped('h.sofar || rest')}), lambda s: s <> '') AS s FROM held),
chunks AS (SELECT k, unnest(range(len(s))) AS i, -1 AS j, NULL::VARCHAR AS part, unnest(s) AS rest FROM said
 UNION ALL SELECT k, i, j + 1, CASE WHEN length(rest) <= 380 THEN rest ELSE {_stripped('left(rest, spot + 1)')} END, CASE WHEN length(rest) <= 380 THEN '' ELSE {_stripped('substr(rest, spot + 2)')} END FROM
 (SELECT *, CASE WHEN clause >= 380 / 3.0 THEN clause WHEN space >= 1 THEN space ELSE 380 END AS spot FROM
  (SELECT *, greatest({_last(', ', 2)}, {_last('; ', 2)}, {_last(': ', 2)}) AS clause, {_last(' ', 1)} AS space FROM (SELECT *, left(rest, 380) AS w FROM chunks WHERE rest <> '')))),
parts AS (SELECT k, i, j, part FROM chunks WHERE j >= 0)"""
