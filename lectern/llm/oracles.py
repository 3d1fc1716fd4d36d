"""SQL of further queries of this subpackage, over whole tables."""

from __future__ import annotations

#: Every 100-byte string as 200 hex digits; a string that starts earlier elsewhere marks its bytes.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS p FROM n)),
later AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
runs AS (SELECT doc_id, p, sum(CASE WHEN p <= coalesce(q, -1000) + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM later)),
spans AS (SELECT doc_id, run, min(p) AS lo, max(p) + 100 AS hi FROM runs GROUP BY ALL),
gaps AS (SELECT doc_id, hi AS a, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY lo), 1000000000) AS b FROM spans UNION ALL SELECT n.doc_id, 0, coalesce(min(lo), 1000000000) FROM n LEFT JOIN spans USING (doc_id) GROUP BY n.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (least(b, n) - a)), '' ORDER BY a) AS k FROM gaps JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, any_value(n) AS n_bytes, coalesce(sum(hi - lo), 0)::BIGINT AS n_removed, count(lo) AS n_spans, any_value(sha256(unhex(k))) AS kept_sha256 FROM n LEFT JOIN spans USING (doc_id) JOIN kept USING (doc_id) GROUP BY n.doc_id"""

# Kinds in the order in which spans that start together are listed; pattern, the part that counts, its least length.
_SECRETS = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""^(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?""", 8),
    ("access", "AKIA[A-Z0-9]+", "", 16),
    ("hex", "[0-9a-f]+", "", 32),
    ("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "", 0),
    ("forge_token", "gh[pousr]_[A-Za-z0-9]+", "", 40),
    ("chat_token", r"xox[abprs]-[0-9A-Za-z\-]+", "", 20),
    ("web_token", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "", 40),
)


def _secrets_of(k: int, kind: str, pattern: str, head: str, least: int) -> str:
    counted = f"length(regexp_replace(m, '{head}', ''))" if head else "length(m)"
    return rf"""SELECT doc_id, {k} AS k, '{kind}' AS kind, start, start + length(m) AS stop FROM (SELECT doc_id, m[i] AS m, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
 FROM (SELECT doc_id, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS s FROM d))) WHERE {counted} >= {least}"""


SECRET_SCAN = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(_secrets_of(k, *x) for k, x in enumerate(_SECRETS))}),
g AS (SELECT doc_id, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

QUALITY_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
 len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)"""


def _jump(shards: int) -> str:
    return f"""list_reduce(list_transform(range({shards + 1}), lambda i: {{'key': k, 'b': -1::BIGINT, 'j': 0::BIGINT}}), lambda a, x: CASE WHEN a.j >= {shards} THEN a ELSE
 {{'key': (a.key * 2862933555777941757 + 1) % 18446744073709551616, 'b': a.j, 'j': floor((a.j + 1) * (2147483648.0::DOUBLE / (((a.key * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE))::BIGINT}} END).b::INT"""


#: The jump hash by its published steps, the CRC by its polynomial, bit by bit for a byte and byte by byte for a text.
JUMP_SHARDS = f"""
WITH tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS tab FROM (SELECT unnest(range(256)) AS n)),
d AS (SELECT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END AS k, encode(coalesce(text, '')) AS e FROM documents),
h AS (SELECT doc_id, k, octet_length(e) AS n, hex(e) AS x FROM d),
c AS (SELECT doc_id, n, {_jump(16)} AS shard, {_jump(17)} AS grown_shard, xor(list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)), lambda a, b: xor(a // 256, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM h, tab)
SELECT doc_id, n + 1 AS size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM c"""
