"""Queries of the layout rules, each with SQL of its own making over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.rules import quoted
from lectern.operators import layout_rules as L
from lectern.operators import layout_stats

from . import inputs as I

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return register


_STYLE = r"[-,_ ]?(?:bold|italic|oblique|regular|regu|medium|medi|ital|roman|book|light|semibold|demibold|black|heavy|mt|ps|std|pro)+.*$"
_FAMILY = f"regexp_replace(regexp_replace(lower(regexp_replace(font, '^[A-Z]{{6}}\\+', '')), '{_STYLE}', ''), '[0-9]+$', '')"
_BLOCKS = f"b AS (SELECT *, size / body_size AS ratio FROM ({I.LAID_BLOCKS}))"


def _blocks(spark, sf_dir):
    return I.sql(spark, sf_dir, I.LAID_BLOCKS, "lineitem")


@query(f"""WITH w AS (SELECT doc_id, page, seq % 2 AS part, family, n_lines, size, text, seq FROM ({I.LAID_BLOCKS})),
s AS (SELECT doc_id, page, part, floor(size * 2 + 0.5) / 2 AS v, sum(length(text)) AS n, min(seq) AS o FROM w GROUP BY ALL), f AS (SELECT doc_id, page, part, family AS v, sum(length(text)) AS n, min(seq) AS o FROM w GROUP BY ALL)
SELECT doc_id, page, part, s.size, f.family FROM (SELECT doc_id, page, part, first(v ORDER BY n DESC, o) AS size FROM s GROUP BY ALL) s JOIN (SELECT doc_id, page, part, first(v ORDER BY n DESC, o) AS family FROM f GROUP BY ALL) f USING (doc_id, page, part)""")
def dominant_style(spark, sf_dir):
    """Size and family of blocks by the characters of their lines."""
    lines, keys = _blocks(spark, sf_dir).withColumn("part", F.col("seq") % 2), ["doc_id", "page", "part"]
    size = layout_stats.mode(lines, keys, T.half_round(F.col("size")), F.length("text"), F.col("seq"), "size")
    return size.join(layout_stats.mode(lines, keys, F.col("family"), F.length("text"), F.col("seq"), "family"), keys)


@query(f"""WITH r AS (SELECT *, length(trim(str)) AS n, floor(size * 2 + 0.5) / 2 AS v, {_FAMILY} AS fam, font LIKE '%Bold%' OR font LIKE 'CMBX%' AS strong, font = 'Courier' AS typed FROM ({I.LINE_RUNS})),
m AS (SELECT doc_id, page, line_seq, first(v ORDER BY n DESC, o) AS ls FROM (SELECT doc_id, page, line_seq, v, sum(n) AS n, min(x) AS o FROM r GROUP BY ALL) GROUP BY ALL),
z AS (SELECT * FROM r JOIN m USING (doc_id, page, line_seq)),
y AS (SELECT doc_id, page, line_seq, list_sort(list(y) FILTER (abs(size - ls) < 0.6::DOUBLE))[count(*) FILTER (abs(size - ls) < 0.6::DOUBLE) // 2 + 1] AS ly FROM z GROUP BY ALL),
f AS (SELECT doc_id, page, line_seq, first(fam ORDER BY n DESC, o) AS family FROM (SELECT doc_id, page, line_seq, fam, sum(n) AS n, min(x) AS o FROM z WHERE abs(size - ls) < 0.6::DOUBLE GROUP BY ALL) GROUP BY ALL),
p AS (SELECT * FROM z JOIN y USING (doc_id, page, line_seq) WHERE NOT (size <= 0.8::DOUBLE * ls AND abs(y - ly) > 0.15::DOUBLE * ls))
SELECT doc_id, page, line_seq, any_value(ls) AS size, any_value(ly) AS y, sum(n)::BIGINT AS chars, 10 * sum(CASE WHEN strong THEN n ELSE 0 END) >= 8 * sum(n) AS bold, first(strong ORDER BY x DESC) AS bold_end, 10 * sum(CASE WHEN typed THEN n ELSE 0 END) >= 7 * sum(n) AS mono, any_value(family) AS family
FROM p JOIN f USING (doc_id, page, line_seq) GROUP BY doc_id, page, line_seq""")
def line_facts(spark, sf_dir):
    return L.line_facts(I.sql(spark, sf_dir, I.LINE_RUNS, "lineitem"))


@query(f"""WITH {I.RUNS_DUCK}, p AS (SELECT doc_id, page, CAST(1000 - y AS INT) AS line_seq, x, w, length(trim(str)) AS n, size FROM runs),
l AS (SELECT doc_id, page, line_seq, min(x) AS x0, max(x + w) AS x1 FROM p GROUP BY ALL),
e AS (SELECT doc_id, page, list_sort(list(x0))[floor(count(*) * 0.05::DOUBLE)::INT + 1] AS lo, list_sort(list(x1))[floor(count(*) * 0.95::DOUBLE)::INT + 1] AS hi FROM l GROUP BY ALL HAVING count(*) >= 6),
c AS (SELECT doc_id, page, unnest(range(0, 200)) AS k, lo, hi FROM e), d AS (SELECT doc_id, page, k, lo + (hi - lo) * 0.35::DOUBLE + 2 * k AS spot FROM c WHERE 2 * k <= (hi - lo) * 0.3::DOUBLE + 2e-9::DOUBLE),
t AS (SELECT doc_id, page, k, spot, line_seq, sum(CASE WHEN x + w <= spot - 5 THEN n ELSE 0 END) AS a, sum(CASE WHEN x + w > spot - 5 AND x >= spot + 5 THEN n ELSE 0 END) AS b, sum(n) AS n FROM d JOIN p USING (doc_id, page) WHERE floor(size * 2 + 0.5) / 2 >= 8 GROUP BY ALL),
u AS (SELECT doc_id, page, k, spot, sum(n - a - b)::BIGINT AS across, sum(n) AS n, count_if(a > 0 AND n = a + b) AS left_lines, count_if(b > 0 AND n = a + b) AS right_lines FROM t GROUP BY ALL)
SELECT doc_id, page, spot AS gutter, left_lines, right_lines, across, left_lines >= 3 AND right_lines >= 3 AND 4 * across <= greatest(n, 1) AS two FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY across, k) = 1""")
def gutter_search(spark, sf_dir):
    runs = I.sql(spark, sf_dir, I.RUNS_SPARK + "SELECT * FROM runs", "documents")
    return L.gutters(runs.select("doc_id", "page", (1000 - F.col("y")).cast("int").alias("line_seq"), "x", "w", F.length(F.trim("str")).alias("n"), "size", F.lit(10.0).alias("body_size")))


@query(f"""WITH l AS (SELECT *, CASE n WHEN 1 THEN [c1] WHEN 2 THEN [c1, c2] ELSE [c1, c2, c3] END AS xs FROM ({I.CELL_LINES})),
v AS (SELECT a.doc_id, a.page, a.line_seq, bool_or(b.col = a.col AND len(a.xs) > 1 AND len(b.xs) > 1 AND abs(a.y - b.y) <= 1.8::DOUBLE * a.pitch * (a.size / a.body_size)
 AND len(list_filter(a.xs, lambda p: len(list_filter(b.xs, lambda q: abs(p - q) <= 0.6::DOUBLE * greatest(a.size, b.size))) > 0)) > 1) AS under
 FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.page = b.page AND abs(a.line_seq - b.line_seq) = 1 GROUP BY ALL)
SELECT doc_id, page, line_seq, tabular OR (numeric_row AND (size < 0.95::DOUBLE * body_size OR x1 - x0 < 0.9::DOUBLE * (cr - cl))) OR coalesce(under, false) AS tabular FROM l LEFT JOIN v USING (doc_id, page, line_seq)""")
def promoted_rows(spark, sf_dir):
    lines = I.sql(spark, sf_dir, I.CELL_LINES, "lineitem").withColumn("cell_x", F.slice(F.array("c1", "c2", "c3"), F.lit(1), F.col("n").cast("int")))
    return L.promote_rows(lines.withColumnsRenamed({"cl": "left", "cr": "right"})).select("doc_id", "page", "line_seq", "tabular")


@query(f"""WITH f AS (SELECT doc_id, seq, concat_ws(chr(10), nullif(a, ''), nullif(b, ''), nullif(c, ''), nullif(d, '')) AS t FROM ({I.FRAGMENTS})),
k AS (SELECT doc_id, seq, regexp_replace(t, '(^|^\\n|[^A-Za-z\\n-]|[^-]\\n)((?i:self|non|well|cross|end-to|state-of-the))-\\n([a-z])', '\\1\\2-\\3', 'g') AS t FROM f),
g AS (SELECT doc_id, seq, regexp_replace(regexp_replace(t, '([A-Za-z-])-\\n([a-z])', '\\1\\2', 'g'), '([A-Za-z-])-\\n([a-z])', '\\1\\2', 'g') AS t FROM k)
SELECT doc_id, seq, replace(regexp_replace(t, '([0-9]-)\\n([a-z])', '\\1\\2', 'g'), chr(10), ' ') AS text FROM g""".replace("\\\\", "\\"))
def joined_lines(spark, sf_dir):
    """Lines of a block as one text, broken words closed."""
    return I.sql(spark, sf_dir, I.FRAGMENTS, "lineitem").select("doc_id", "seq", L.join_lines(F.array("a", "b", "c", "d")).alias("text"))


_HEADING_LIST = T.HEADING_WORDS.removeprefix("(?i)")


@query(rf"""WITH b AS (SELECT *, size / body_size AS ratio, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM ({I.LAID_BLOCKS})),
n AS (SELECT *, trim(regexp_extract(t, {quoted(T.NUMBER)}, 1)) AS num, trim(regexp_replace(t, {quoted(T.NUMBER)}, '')) AS rest FROM b),
f AS (SELECT *, len(list_filter(regexp_split_to_array(rest, '\s+'), lambda x: x <> '')) AS words, regexp_matches(trim(regexp_replace(rest, '[.:]$', '')), {quoted('(?i)^' + _HEADING_LIST + '$')}) AS listed,
 NOT regexp_matches(rest, '[a-z0-9]') AND regexp_matches(rest, '[A-Z][A-Z][A-Z]') AS caps FROM n),
g AS (SELECT *, n_lines < 4 AND n_tabular + n_eq = 0 AND length(t) BETWEEN 2 AND 120 AND (caps OR regexp_matches(rest, '^["A-Z0-9“(]')) AND right(rest, 1) NOT IN (',', ';')
 AND NOT (right(rest, 1) IN ('.', '!', '?') AND words > 6) AND NOT (words > 4 AND regexp_matches(rest, '[.!?]\s+[A-Z(]')) AS shaped,
 (bold OR ratio >= 1.12::DOUBLE OR caps) AND CASE WHEN num <> '' OR listed OR caps THEN true WHEN words > 12 THEN false ELSE ratio >= 1.12::DOUBLE OR (bold AND words <= 8) END AS lax,
 listed OR (num <> '' AND (bold OR ratio >= 1.1::DOUBLE)) AS strict FROM f)
SELECT doc_id, seq, CASE WHEN shaped AND lax THEN num END AS number, CASE WHEN shaped AND lax THEN regexp_replace(rest, '\s*[.:]$', '') END AS title, CASE WHEN shaped AND lax THEN listed END AS known, shaped AND strict AS strict FROM g""")
def heading_test(spark, sf_dir):
    ratio, flat = F.col("size") / F.col("body_size"), (F.col("n_tabular") + F.col("n_eq")) == 0
    of = lambda strict: L.heading(F.col("text"), F.col("n_lines"), flat, ratio, F.col("bold"), strict)
    rows = _blocks(spark, sf_dir).withColumn("h", of(False)).withColumn("strict", of(True).isNotNull())
    return rows.select("doc_id", "seq", F.col("h.number").alias("number"), F.col("h.rest").alias("title"), F.col("h.known").alias("known"), "strict")


_FURNITURE = r"""CASE WHEN (last > 732.6 OR first < 59.4) AND n_lines < 3 AND regexp_matches(text, '(?i)^([-–—]\s*)?([0-9]{1,4}|[ivxlcdm]{1,7}|page\s+[0-9]+(\s+of\s+[0-9]+)?|[0-9]+\s*(of|/|\|)\s*[0-9]+)(\s*[-–—])?$') THEN 'pageNumber'
 WHEN (last > 732.6 OR first < 59.4) AND (repeats OR ratio < 0.95::DOUBLE OR length(text) < 60 OR n_lines < 3) THEN CASE WHEN last > 732.6 THEN 'header' ELSE 'footer' END
 WHEN n_lines < 3 AND repeats AND ratio >= 0.8::DOUBLE AND last / height > 0.86::DOUBLE THEN 'header' WHEN n_lines < 3 AND repeats AND ratio >= 0.8::DOUBLE AND first / height < 0.14::DOUBLE THEN 'footer' END"""


def _furniture():
    c = F.col
    return L.furniture(c("text"), c("n_lines"), c("size") / c("body_size"), c("first"), c("last"), c("height"), c("repeats"))


@query(f"WITH {_BLOCKS} SELECT doc_id, seq, {_FURNITURE} AS furniture FROM b")
def page_furniture(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "seq", _furniture().alias("furniture"))


@query(rf"""WITH {_BLOCKS}, f AS (SELECT *, {_FURNITURE} AS furniture FROM b),
m AS (SELECT doc_id, max(size) AS top FROM f WHERE page = 1 AND first > 356.4 GROUP BY 1),
t AS (SELECT doc_id, min(seq) AS title FROM f JOIN m USING (doc_id) WHERE page = 1 AND furniture IS NULL AND first > 356.4 AND ratio >= 1.15::DOUBLE AND n_lines < 5 AND size >= top - 0.5 GROUP BY 1),
a AS (SELECT f.*, title, furniture IS NULL AND page = 1 AND seq > title AS behind FROM f LEFT JOIN t USING (doc_id)),
s AS (SELECT doc_id, min(seq) AS stop FROM a WHERE behind AND (known OR (n_lines > 2 AND length(text) > 120 AND ratio BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE AND NOT bold)) GROUP BY 1)
SELECT doc_id, seq, CASE WHEN seq = title THEN 'title' WHEN behind AND seq < coalesce(stop, 1000) THEN CASE WHEN regexp_matches(text, '(?i)@|https?://|www\.') THEN 'meta' ELSE 'authors' END END AS front FROM a LEFT JOIN s USING (doc_id)""")
def front_matter(spark, sf_dir):
    return L.front_matter(_blocks(spark, sf_dir).withColumn("furniture", _furniture()).withColumn("stops", F.col("known"))).select("doc_id", "seq", "front")


@query(rf"""WITH {_BLOCKS}, l AS (SELECT doc_id, page, col, min(lowest_body) AS floor FROM b GROUP BY ALL), e AS (SELECT *, right(text, 1) IN ('.', '!', '?') AS ended FROM b JOIN l USING (doc_id, page, col))
SELECT doc_id, seq, CASE WHEN ratio < 0.75::DOUBLE THEN 'figure' WHEN 2 * n_tabular >= n_lines THEN 'table' WHEN 2 * n_eq >= n_lines THEN 'equation'
 WHEN ratio < 0.93::DOUBLE AND first < floor THEN 'footnote' WHEN ratio < 0.93::DOUBLE AND length(text) < 40 AND n_lines < 5 AND NOT ended THEN 'figure' WHEN n_lines > 1 AND n_mono = n_lines THEN 'code'
 WHEN family NOT IN ('', body_family) AND n_lines < 3 AND length(text) < 60 AND NOT ended AND NOT bold THEN 'figure' WHEN n_lines < 3 AND regexp_matches(text, '\S+@\S+\.\S+') THEN 'meta' ELSE 'body' END AS kind FROM e""")
def content_kinds(spark, sf_dir):
    return L.content_kinds(_blocks(spark, sf_dir).drop("kind")).select("doc_id", "seq", "kind")


@query(r"""WITH b AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, kind IN ('figure', 'table') OR (kind = 'equation' AND size < 9) AS floaty FROM (%s)),
i AS (SELECT *, right(text, 1) NOT IN ('.', '!', '?') AND ((kind IN ('body', 'heading', 'equation') AND n_lines < 3 AND length(text) < 60 AND words < 7 AND NOT regexp_matches(text, '[.!?]\s') AND NOT (kind = 'heading' AND (number IS NOT NULL OR known)))
 OR (kind IN ('body', 'heading', 'footnote') AND size < 9.3 AND n_lines < 4 AND words < 15)) AS soft FROM b),
g AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id, page, floaty OR soft ORDER BY seq) AS island FROM i),
r AS (SELECT doc_id, page, island, min(seq) AS lo, max(seq) AS hi, count_if(floaty) AS floats, count(*) AS n, bool_or(kind = 'table') AS tables FROM g WHERE floaty OR soft GROUP BY ALL),
c AS (SELECT r.*, p.kind IN ('body', 'heading', 'reference') AS text_before, q.kind IN ('body', 'heading', 'reference') AS text_behind,
 CASE WHEN q.kind = 'caption' THEN q.caption_type WHEN p.kind = 'caption' THEN p.caption_type END AS caption
 FROM r LEFT JOIN g p ON p.doc_id = r.doc_id AND p.page = r.page AND p.seq = r.lo - 1 LEFT JOIN g q ON q.doc_id = r.doc_id AND q.page = r.page AND q.seq = r.hi + 1),
k AS (SELECT g.doc_id, g.seq, g.size, c.caption, c.floats, CASE WHEN c.n IS NULL THEN kind WHEN floats >= 2 AND 2 * floats >= c.n
  THEN CASE WHEN soft AND NOT (coalesce(text_before, false) AND g.seq = lo) AND NOT (coalesce(text_behind, false) AND g.seq = hi) THEN CASE WHEN tables THEN 'table' ELSE 'figure' END ELSE kind END
  WHEN floats = 0 AND caption IS NOT NULL AND (family <> body_family OR multi) THEN caption ELSE kind END AS kind
 FROM g LEFT JOIN c ON c.doc_id = g.doc_id AND c.page = g.page AND c.island = g.island AND (g.floaty OR g.soft))
SELECT doc_id, seq, CASE WHEN floats > 0 AND caption IS NOT NULL AND (kind IN ('figure', 'table') OR (kind = 'equation' AND size < 9)) THEN caption ELSE kind END AS kind FROM k""" % I.LAID_BLOCKS)
def float_runs(spark, sf_dir):
    return L.float_runs(_blocks(spark, sf_dir)).select("doc_id", "seq", "kind")


@query(rf"""WITH b AS (SELECT *, kind IN ('body', 'footnote') AND regexp_matches(text, '^\[[0-9]+\]\s') AND size < 9.7 AS entry FROM ({I.ENTRY_BLOCKS})),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, seq) - row_number() OVER (PARTITION BY doc_id, entry ORDER BY page, seq) AS island FROM b WHERE entry OR kind NOT IN ('pageNumber', 'header', 'footer')),
n AS (SELECT doc_id, seq FROM e WHERE entry QUALIFY count(*) OVER (PARTITION BY doc_id, island) >= 6)
SELECT doc_id, seq, CASE WHEN n.seq IS NOT NULL THEN 'reference' ELSE kind END AS kind FROM b LEFT JOIN n USING (doc_id, seq)""")
def implicit_references(spark, sf_dir):
    return L.implicit_references(I.sql(spark, sf_dir, I.ENTRY_BLOCKS, "orders")).select("doc_id", "seq", "kind")


@query(rf"""WITH b AS (SELECT *, [[text, '  '], ['', ' '], [kind]] AS cells FROM ({I.LAID_BLOCKS}) WHERE size >= 8 OR length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) > 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, seq) - 1)::INT AS block_id, page, kind, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, size, number, known AS heading,
 to_json(list_filter(list_transform(cells, lambda r: list_filter(list_transform(r, lambda c: trim(regexp_replace(c, '\s+', ' ', 'g'))), lambda c: c <> '')), lambda r: len(r) > 0))::VARCHAR AS rows FROM b""")
def finalised_blocks(spark, sf_dir):
    """Specks gone, ids dense, text and cells normalised."""
    rows = F.array(F.array("text", F.lit("  ")), F.array(F.lit(""), F.lit(" ")), F.array("kind"))
    return L.finalise(_blocks(spark, sf_dir).withColumn("rows", rows).withColumn("heading", F.col("known"))).withColumn("rows", F.to_json("rows"))
