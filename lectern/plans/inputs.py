"""Inputs that queries derive from the tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A document with a title, authors, a numbered heading, a caption and references around its text; each line a paragraph.
PAPER = """concat('Study of Item ', doc_id, chr(10), chr(10), 'Ann Author, Bo Writer', chr(10), chr(10), '1. Introduction', chr(10), chr(10),
 replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10), 'A co-', chr(10), 'operative line', chr(10), chr(10), 'Table ', doc_id % 9 + 1, ': Results', chr(10), chr(10),
 'References', chr(10), chr(10), '[1] Foo et al. [2] Bar.')"""
#: A text in which every speech rule has something to do.
SPOKEN = """concat(text, ' See Fig. ', doc_id % 9 + 1, ' and Figs. 4, Eq. (', doc_id % 7, ') e.g., cats i.e. cf. Li vs. Wu; 5−', doc_id % 5,
 ' is ≤ 9% of A & B, 10^', doc_id % 4, ' or 10^−5, pages 1–2–', doc_id % 6, ' takes ~5 ms → x ± 2 × 3 ≥ 1 (Smith et al., 20', 10 + doc_id % 10,
 ') [', doc_id % 30, ', 3–5] (see Fig. 3) (Smith, 2020; Jones and Li, 2019b) a ( , b) ; c Appx. B, Ref. [4] w.r.t. it, Secs. 2 Sec. 3 Tab. 1 Refs. 5 Alg. 2 approx. 7° ●')"""
#: A paper whose every line of text stands in Markdown: heads of both kinds, items, quotes, tables, code, formulas, a note and references that another head ends.
MARKED_PAPER = """concat('# Study of *Item* ', doc_id, chr(10), chr(10), 'Ann Author, Bo Writer', chr(10), chr(10), '## 1. Introduction ##', chr(10), replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10),
 'A co-', chr(10), 'operative line of **words**', chr(10), '- one [item](u)', chr(10), '  that goes on', chr(10), '2) two', chr(10), '> quoted', chr(10), chr(10), 'Setup', chr(10), '-----', chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '| ', doc_id, ' | ', lang, ' |', chr(10), chr(10), 'c | d', chr(10),
 '```sql', chr(10), '  SELECT | 1', chr(10), '# no head', chr(10), '~~~', chr(10), '$$', chr(10), 'x = ', doc_id, chr(10), '+ 1 $$', chr(10), '$$ y = 2 $$', chr(10), '***', chr(10), '![p](q)', chr(10), '[^1]: a note `here`', chr(10), 'Table ', doc_id % 9 + 1, ': Results', chr(10), chr(10),
 'References', chr(10), chr(10), '[1] Foo et al. [2] Bar.', chr(10), chr(10), '[3] Baz', chr(10), chr(10), '# Appendix', chr(10), 'Last words &amp; more.')"""
#: Ligatures, separate accents, invisible characters and odd spaces around a text.
UNCOMPOSED = "concat('ﬁne´ etude ´e¨o gar¸ con\u00ad x\u200by½ ', text, '\u00a0ﬂat²\u2009Ａ e\u0301 ')"
SENTENCES = """SELECT conv_id AS doc_id, CAST(turn AS INT) AS sentence_id, CAST(floor(turn / 2) AS INT) AS block_id, CAST(turn % 2 AS INT) AS ordinal, CAST(floor(turn / 3) AS INT) + 1 AS page, 'body' AS kind, text FROM conversations"""
APPLIED = """SELECT conv_id AS doc_id, CAST(turn AS INT) AS block_id, CAST(floor(turn / 4) AS INT) + 1 AS page,
 CASE (conv_id + turn) % 6 WHEN 0 THEN 'body' WHEN 1 THEN 'reference' WHEN 2 THEN 'reference' WHEN 3 THEN 'table' WHEN 4 THEN 'caption' ELSE 'heading' END AS kind, text,
 (conv_id + turn) % 6 IN (0, 5) AS included FROM conversations"""
CHANGES = "SELECT user_id AS doc_id, CAST(event_id % 7 AS INT) AS block_id, event_id AS seq, event_id % 3 = 0 AS included FROM events"
RUN_TAIL = """, body AS (SELECT doc_id, source, i, str, CAST(floor(i/40) AS INT)+1 AS page, i%40 AS r FROM chunks)
, runs AS (
 SELECT doc_id, page, CAST(i AS BIGINT) AS seq, str,
  CAST(CASE WHEN i=0 THEN 120 WHEN doc_id%2=0 AND r>=20 THEN 315 ELSE 54 END AS DOUBLE) AS x,
  CAST(CASE WHEN i=0 THEN 724 ELSE 700-14*(CASE WHEN doc_id%2=0 THEN r%20 ELSE r END) END AS DOUBLE) AS y,
  CAST(least(240, 4*length(str)) AS DOUBLE) AS w, CAST(CASE WHEN i=0 THEN 18 ELSE 10 END AS DOUBLE) AS size,
  CASE WHEN i=0 THEN 'ABCDEF+NimbusRomNo9L-Medi' ELSE 'ABCDEF+NimbusRomNo9L-Regu' END AS font FROM body
 UNION ALL SELECT doc_id, page, CAST(1000000+page AS BIGINT), concat('Synthetic Proceedings ', source), CAST(54 AS DOUBLE),
  CAST(770 AS DOUBLE), CAST(120 AS DOUBLE), CAST(8 AS DOUBLE), 'ABCDEF+NimbusRomNo9L-Regu' FROM (SELECT DISTINCT doc_id, source, page FROM body) a
 UNION ALL SELECT doc_id, page, CAST(2000000+page AS BIGINT), concat(page), CAST(300 AS DOUBLE),
  CAST(30 AS DOUBLE), CAST(8 AS DOUBLE), CAST(9 AS DOUBLE), 'ABCDEF+NimbusRomNo9L-Regu' FROM (SELECT DISTINCT doc_id, page FROM body) b)
"""
RUNS_SPARK = r"""WITH w AS (SELECT doc_id, source, split(text, '[ \\n]+') AS w FROM documents),
chunks AS (SELECT doc_id, source, i, array_join(slice(w, i*10+1, 10), ' ') AS str FROM w LATERAL VIEW explode(sequence(0, CAST(floor((size(w)-1)/10) AS INT))) t AS i)""" + RUN_TAIL
RUNS_DUCK = r"""w AS (SELECT doc_id, source, regexp_split_to_array(text, '[ \n]+') AS w FROM documents),
chunks AS (SELECT doc_id, source, i, array_to_string(w[i*10+1:i*10+10], ' ') AS str FROM w, unnest(range(0, CAST(floor((len(w)-1)/10) AS INT)+1)) t(i))""" + RUN_TAIL
#: Raw items: some rotated, blank or without size.
ITEMS = """SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey AS seq, CASE WHEN l_partkey % 11 = 0 THEN ' ' ELSE l_returnflag END AS str,
 CAST(l_quantity % 13 - 1 AS DOUBLE) AS a, CAST(l_suppkey % 5 AS DOUBLE) AS b, CAST(l_extendedprice AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y, CAST(l_tax AS DOUBLE) AS width,
 CAST(9 AS DOUBLE) AS height, CAST(10 AS DOUBLE) AS view_x0, CAST(l_linenumber AS DOUBLE) AS view_y0, 'F1' AS font FROM lineitem"""
FONTS = """SELECT * FROM (VALUES ('ABCDEF+NimbusRomNo9L-Medi'), ('NimbusRomNo9L-Regu'), ('XYZABC+CMR10'), ('CMMI7'), ('CMBX12'), ('Courier-Bold'), ('Helvetica-Oblique'), ('Futura-Medium'),
 ('ABCDEF+NimbusRomNo9L-MediItal'), ('Symbol'), ('STIXMath'), ('LMTypewriter10'), ('cmcsc10'), ('Times New Roman,Italic'), ('Inconsolata'), ('Arial-Black')) AS t(name)"""
NAMES = """SELECT * FROM (VALUES ('A study of things', 'x.pdf', 'application/pdf'), ('untitled', 'y.PDF', ''), ('abc', 'notes.md', ''), ('paper.tex', 'z.pdf', ''), (' Long title ', 'q.txt', 'text/plain'),
 ('Été: bits & bobs!', 'pic.png', 'image/png'), ('!!!', 'r', 'text/csv'), ('Untitled 3', 'deep.name.pdf', '')) AS t(title, name, mime)"""
VOICES = """SELECT * FROM (VALUES ('a1', 'Bella', 'en-us', 'Female', 'A-'), ('a2', 'Adam', 'en-us', 'Male', 'F'), ('a3', 'Heart', 'en-us', 'Female', 'A'), ('b1', 'Emma', 'en-gb', 'Female', 'B'),
 ('b2', 'Alice', 'en-gb', 'Female', 'B'), ('f1', 'Luc', 'fr-fr', 'Male', 'A'), ('a4', 'Anna', 'en-us', 'Female', 'A')) AS t(id, name, language, gender, grade)"""
PROGRESS = "SELECT CAST(user_id % 50 AS BIGINT) AS job, event_type AS file, event_id AS seq, CAST(floor(value) AS BIGINT) AS loaded, CAST(floor(value * 2) AS BIGINT) AS total FROM events"
REQUESTS = "SELECT conv_id % 20 AS doc_id, conv_id % 60 AS session, CAST(turn AS INT) AS sentence_id, role AS text, 'v' AS voice, CAST(1 AS DOUBLE) AS speed FROM conversations"
#: Table-like, formula-like and plain lines.
LINES = """SELECT l_orderkey AS doc_id, l_linenumber AS line_seq, CAST(l_partkey % 4 AS INT) AS math_chars,
 CASE l_suppkey % 5 WHEN 0 THEN concat(l_linenumber, ' 3.5 7% – ', l_returnflag) WHEN 1 THEN concat('x = y + ', l_linenumber, ' (', l_partkey % 9, 'a)') WHEN 2 THEN 'Plain words that go on.'
  WHEN 3 THEN concat('Method 1.0 ', l_linenumber, ' 3') ELSE '∑ ≤ α b c' END AS text,
 CASE l_suppkey % 5 WHEN 0 THEN concat(l_linenumber, '|3.5|7%|–|', l_returnflag) WHEN 1 THEN concat('x = y + ', l_linenumber, '|(', l_partkey % 9, 'a)') WHEN 2 THEN 'Plain words that go on.'
  WHEN 3 THEN concat('Method|1.0|', l_linenumber) ELSE '∑ ≤ α b c' END AS joined FROM lineitem"""
#: Line items with a place of their own in the order.
PLACED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS place FROM lineitem)"
#: Text runs of lines: sizes, fonts, raised runs and odd baselines.
LINE_RUNS = f"""SELECT l_orderkey AS doc_id, 1 AS page, CAST(place % 2 AS INT) AS line_seq, substring('abcdefghijklmnop', 1, CAST(1 + l_partkey % 12 AS INT)) AS str, CAST(place * 50 AS DOUBLE) AS x,
 CAST(700 + l_suppkey % 3 AS DOUBLE) + CASE WHEN l_partkey % 4 = 0 THEN 4 ELSE 0 END AS y, CAST(CASE l_suppkey % 5 WHEN 0 THEN 6.9 WHEN 1 THEN 12 WHEN 2 THEN 10.2 ELSE 10 END AS DOUBLE) AS size,
 CASE l_partkey % 6 WHEN 0 THEN 'ABCDEF+Times-Bold' WHEN 1 THEN 'CMBX12' WHEN 2 THEN 'Courier' WHEN 3 THEN 'ABCDEF+NimbusRomNo9L-Regu' ELSE 'Times-Roman' END AS font FROM {PLACED}"""
#: Lines of two columns with up to three cells.
CELL_LINES = f"""SELECT l_orderkey AS doc_id, 1 AS page, place AS line_seq, CAST(CASE WHEN place > 4 THEN 1 ELSE 0 END AS INT) AS col, CAST(54 AS DOUBLE) AS x0, CAST(100 + (l_partkey * 13) % 200 AS DOUBLE) AS x1,
 CAST(700 - place * (8 + l_suppkey % 12) AS DOUBLE) AS y, CAST(8 + l_suppkey % 4 AS DOUBLE) AS size, l_partkey % 9 = 0 AS tabular, l_suppkey % 5 = 0 AS numeric_row, CAST(54 AS DOUBLE) AS c1,
 CAST(150 + 9 * (l_partkey % 3) AS DOUBLE) AS c2, CAST(220 + 7 * (l_suppkey % 4) AS DOUBLE) AS c3, 1 + l_partkey % 3 AS n, CAST(54 AS DOUBLE) AS cl, CAST(290 AS DOUBLE) AS cr, CAST(10 AS DOUBLE) AS body_size, CAST(12 AS DOUBLE) AS pitch FROM {PLACED}"""
_TEXTS = """CASE l_suppkey % 20 WHEN 0 THEN 'Results' WHEN 1 THEN '2.1 Data and methods' WHEN 2 THEN 'A plain sentence of the text, which goes on for a while and says little before it ends.' WHEN 3 THEN 'INTRODUCTION'
  WHEN 4 THEN 'write to ann@lab.org' WHEN 5 THEN concat('[', place, '] Foo and Bar, a title') WHEN 6 THEN concat('- ', l_partkey % 3000, ' -') WHEN 7 THEN 'see https://lab.org for more' WHEN 8 THEN 'page 3 of 9'
  WHEN 9 THEN 'axis label' WHEN 10 THEN 'Figure 3: what it shows' WHEN 11 THEN 'A. Proofs and other things.' WHEN 12 THEN 'Ann Author, Bo Writer' WHEN 13 THEN 'a lower case line; it goes on' WHEN 14 THEN 'IV. Related Work'
  WHEN 15 THEN 'What is it? Nobody (so far) has said so in all these years of work' WHEN 16 THEN '– . –' WHEN 17 THEN 'xii'
  WHEN 18 THEN concat('Long paragraphs have three lines or more and over one hundred and twenty characters, as this one has, which says nothing else than that, number ', l_partkey, '.') ELSE 'Title-like words 12' END"""
#: Blocks of pages of a document, of every kind and place.
LAID_BLOCKS = f"""SELECT l_orderkey AS doc_id, CAST(1 + floor(place / 5) AS INT) AS page, place AS seq, CAST(l_partkey % 2 AS INT) AS col, {_TEXTS} AS text,
 CAST((CASE WHEN l_partkey % 3 = 0 THEN 10 ELSE 6 + (l_partkey * 7 + place) % 9 END) AS DOUBLE) AS size, CASE WHEN l_partkey % 7 = 0 THEN 'symbol' WHEN l_partkey % 11 = 0 THEN '' ELSE 'times' END AS family,
 CAST(1 + (l_partkey + l_suppkey) % 5 AS INT) AS n_lines, CAST(l_partkey % 13 % 3 AS INT) AS n_tabular, CAST(l_suppkey % 17 % 3 AS INT) AS n_eq, CAST(CASE WHEN l_partkey % 10 = 0 THEN 1 + (l_partkey + l_suppkey) % 5 ELSE 0 END AS INT) AS n_mono,
 CAST((l_partkey * 31 + place * 97) % 792 AS DOUBLE) AS first, CAST(greatest(0, (l_partkey * 31 + place * 97) % 792 - 12 * ((l_partkey + l_suppkey) % 5)) AS DOUBLE) AS last, CAST(792 AS DOUBLE) AS height,
 l_partkey % 4 = 0 AS bold, l_suppkey % 3 = 0 AS repeats, CAST(10 AS DOUBLE) AS body_size, 'times' AS body_family, CAST(CASE WHEN l_partkey % 5 = 0 THEN (l_partkey * 17) % 400 END AS DOUBLE) AS lowest_body,
 CASE (l_partkey + place) % 10 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'caption' WHEN 3 THEN 'body' WHEN 4 THEN 'heading' WHEN 5 THEN 'equation' WHEN 6 THEN 'footnote' WHEN 7 THEN 'reference' WHEN 8 THEN 'figure' ELSE 'table' END AS kind,
 CASE WHEN l_suppkey % 4 = 0 THEN '2.1' END AS number, l_suppkey % 6 = 0 AS known, l_partkey % 3 = 1 AS multi, CASE WHEN l_suppkey % 2 = 0 THEN 'table' ELSE 'figure' END AS caption_type FROM {PLACED}"""
#: Short entries in brackets, some of them parted by page furniture, a heading or a larger one.
ENTRY_BLOCKS = """SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(1 + o_orderkey % 4 AS INT) AS page, o_orderkey AS seq, CASE WHEN o_orderkey % 23 = 0 THEN 'heading' WHEN o_orderkey % 5 = 0 THEN 'footer' WHEN o_orderkey % 7 = 0 THEN 'footnote' ELSE 'body' END AS kind,
 CASE WHEN o_orderkey % 19 = 0 THEN 'No entry' ELSE concat('[', o_orderkey % 99, '] A. Writer, a book') END AS text, CAST(CASE WHEN o_orderkey % 17 = 0 THEN 10 ELSE 9 END AS DOUBLE) AS size, CAST(10 AS DOUBLE) AS body_size FROM orders"""
_FRAGMENT = "CASE {n} % 8 WHEN 0 THEN 'inter-' WHEN 1 THEN 'national work' WHEN 2 THEN 'of a self-' WHEN 3 THEN 'made state-of-the-' WHEN 4 THEN 'art in 3-' WHEN 5 THEN 'fold' WHEN 6 THEN 'End-To-' ELSE '' END"
FRAGMENTS = f"SELECT l_orderkey AS doc_id, l_linenumber AS seq, {_FRAGMENT.format(n='l_suppkey')} AS a, {_FRAGMENT.format(n='l_partkey')} AS b, {_FRAGMENT.format(n='(l_suppkey + l_partkey)')} AS c, {_FRAGMENT.format(n='l_linenumber')} AS d FROM lineitem"
NUMBERS = "SELECT o_orderkey AS id, CAST(o_totalprice / 7 - 20000 AS DOUBLE) AS x, CAST(o_totalprice * 100 AS BIGINT) AS n FROM orders"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str, *tables: str) -> DataFrame:
    """A query over tables of sf_dir, each by its own name."""
    for name in tables:
        query = query.replace(f"FROM {name}", "FROM {" + name + "}")
    return spark.sql(query, **{name: table(spark, sf_dir, name) for name in tables})
