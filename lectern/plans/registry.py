"""The registered queries of the engine and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import rules as R
from lectern.functions import text as T
from lectern.operators import audio, layout_fold, layout_rules, layout_stats, markdown, speech, views
from lectern.operators.sentences import sentence_parts, sentences, text_sentences
from lectern.operators.text_blocks import text_blocks

from . import inputs as I
from . import layout_queries
from .markdown_sql import blocks_sql
from .sentence_sql import parts_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(layout_queries.QUERIES)
ORACLES: dict[str, str] = dict(layout_queries.ORACLES)


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sql(spark, sf_dir, f"SELECT doc_id, lang, {I.PAPER} AS text FROM documents", "documents")


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sql(spark, sf_dir, f"SELECT doc_id, {I.SPOKEN} AS text FROM documents", "documents")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sql(spark, sf_dir, I.SENTENCES, "conversations")


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sql(spark, sf_dir, I.APPLIED, "conversations")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sql(spark, sf_dir, I.RUNS_SPARK + "SELECT * FROM runs", "documents")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("doc_id", "page", F.col("seq").alias("line_seq"), F.when(F.col("x") >= 315, 1).otherwise(0).alias("col"), F.col("str").alias("text"), F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"), "y", "size", F.lit(792.0).alias("height"))


def _re2(pattern: str) -> str:
    return R.quoted(pattern.replace(r"\z", "$"))


_LINES_SQL = "lines AS (SELECT doc_id, page, seq AS line_seq, CASE WHEN x >= 315 THEN 1 ELSE 0 END AS col, str AS text, x AS x0, x + w AS x1, y, size, 792.0::DOUBLE AS height FROM runs)"
_SIZES_SQL = "sizes AS (SELECT doc_id, arg_max(v, {'n': n, 'o': -o}) AS body_size FROM (SELECT doc_id, floor(size * 2 + 0.5) / 2 AS v, sum(length(trim(str)))::BIGINT AS n, min(page::BIGINT * 10000000 + seq) AS o FROM runs WHERE length(trim(str)) > 0 GROUP BY 1, 2) GROUP BY doc_id)"
_KEPT = "regexp_replace(trim(regexp_replace(t, {n}, '')), '\\s*[.:]$', '')"
_BLOCKS_SQL = rf"""
e AS (SELECT doc_id, lang, {I.PAPER} AS t FROM documents),
s AS (SELECT doc_id, lang, regexp_split_to_array(replace(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(9), '    '), '\n\s*\n') AS l FROM e),
u AS (SELECT doc_id, lang, unnest(range(len(l))) AS i, unnest(l) AS raw FROM s),
q AS (SELECT doc_id, lang, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), ' *\n *', chr(10), 'g'), '([A-Za-z])-\n([a-z])', '\1\2', 'g'), '\s+', ' ', 'g')) AS t FROM u),
p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, t FROM q WHERE t <> ''),
f AS (SELECT *, regexp_matches(t, {_re2(T.CAPTION)}) AS cap, trim(regexp_extract(t, {_re2(T.NUMBER)}, 1)) AS number,
      {_KEPT.format(n=_re2(T.NUMBER))} AS rest FROM p),
g AS (SELECT *, regexp_matches(rest, {_re2(T.REFERENCES)}) AS known, regexp_split_to_array(rest, '\s+') AS w FROM f),
h AS (SELECT *, length(t) <= 80 AND NOT regexp_matches(t, '[.!?,;:]$') AND regexp_matches(t, '^[A-Z0-9]')
      AND (number <> '' OR known OR (2 * len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= len(w) AND len(w) <= 8)) AS heads FROM g),
a AS (SELECT *, coalesce(n = 1 AND bool_or(n = 0 AND heads AND NOT known AND NOT cap) OVER d AND NOT cap AND length(t) < 160 AND NOT regexp_matches(t, '[.!?]$'), false) AS authors
      FROM h WINDOW d AS (PARTITION BY doc_id)),
r AS (SELECT *, coalesce(n > min(CASE WHEN heads AND known AND NOT cap AND NOT authors THEN n END) OVER (PARTITION BY doc_id), false) AS after FROM a),
k AS (SELECT doc_id, lang, n, number, CASE WHEN cap THEN 'caption' WHEN after THEN 'reference' WHEN authors THEN 'authors' WHEN heads AND known THEN 'reference' WHEN heads THEN 'heading' ELSE 'body' END AS kind,
      NOT cap AND NOT after AND NOT authors AND heads AS headed, known,
      CASE WHEN cap THEN [t] WHEN after THEN string_split(regexp_replace(t, '\s+(\[[0-9]+\]\s)', chr(1) || '\1', 'g'), chr(1)) WHEN NOT authors AND heads THEN [rest] ELSE [t] END AS texts FROM r),
x AS (SELECT doc_id, lang, n, kind, headed, known, number, unnest(range(len(texts))) AS j, trim(unnest(texts)) AS text FROM k),
blocks AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY doc_id ORDER BY n, j) - 1)::INT AS block_id, 1 AS page, kind, text, 10.0::DOUBLE AS size,
      CASE WHEN headed AND number <> '' THEN number END AS number, headed AND known AS heading FROM x WHERE text <> '')"""


# --- text, blocks, speech -------------------------------------------------------


@query(f"WITH {_BLOCKS_SQL} SELECT doc_id, block_id, page, kind, text, size, number, heading FROM blocks")
def text_blocks_of_papers(spark, sf_dir):
    return text_blocks(_papers(spark, sf_dir))


@query(f"WITH {_BLOCKS_SQL} SELECT kind, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars FROM blocks GROUP BY kind")
def block_kind_counts(spark, sf_dir):
    return text_blocks(_papers(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""WITH {_BLOCKS_SQL}, c AS (SELECT lang, count(*) AS n_blocks, count_if(kind NOT IN ('reference', 'caption')) AS n_read,
 sum(CASE WHEN kind NOT IN ('reference', 'caption') THEN length(text) ELSE 0 END)::BIGINT AS n_chars FROM blocks GROUP BY lang)
SELECT lang, n_blocks, n_read, n_chars, floor(n_chars / 14.0 / 60 + 0.5)::BIGINT AS minutes FROM c""")
def reading_minutes_by_lang(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to blocks to what is read of them, by language."""
    papers = _papers(spark, sf_dir)
    # the language rides in the key, so that no join is needed to get it back
    keyed = papers.select(F.struct("doc_id", "lang").alias("doc_id"), "text")
    blocks = text_blocks(keyed).withColumn("read", speech.default_included(F.col("kind")))
    counts = blocks.groupBy(F.col("doc_id.lang").alias("lang")).agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if("read").alias("n_read"), F.sum(F.when(F.col("read"), F.length("text")).otherwise(0)).alias("n_chars"))
    return counts.withColumn("minutes", F.floor(F.col("n_chars") / 14 / 60 + F.lit(0.5)))


@query(f"SELECT doc_id, {R.sql_citations('t')} AS text FROM (SELECT doc_id, {I.SPOKEN} AS t FROM documents)")
def strip_citations(spark, sf_dir):
    return _spoken(spark, sf_dir).select("doc_id", R.strip_citations(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {R.sql_rules('t', R.SPEECH)} AS text FROM (SELECT doc_id, {I.SPOKEN} AS t FROM documents)")
def speech_rules(spark, sf_dir):
    return _spoken(spark, sf_dir).select("doc_id", R.speech_rules(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {R.sql_rules(R.sql_rules(R.sql_citations('t'), R.SPEECH), R.CLEANUP)} AS text FROM (SELECT doc_id, {I.SPOKEN} AS t FROM documents)")
def speech_cleanup(spark, sf_dir):
    return _spoken(spark, sf_dir).select("doc_id", R.clean_for_speech(F.col("text")).alias("text"))


_STOP = "CASE WHEN regexp_matches({t}, '[.!?…:]$') THEN {t} ELSE {t} || '.' END"
_SAID = f"""CASE WHEN kind IN ('title', 'heading', 'caption', 'authors', 'table') OR (kind = 'reference' AND heading) THEN {_STOP.format(t='text')}
 WHEN kind = 'reference' THEN regexp_replace(text, '^\\[[0-9]+\\]\\s*', '') WHEN kind = 'footnote' THEN regexp_replace(text, '^[0-9∗*†‡§¶]+\\s*', '') ELSE text END"""


@query(f"WITH {_BLOCKS_SQL} SELECT doc_id, block_id, kind, {_SAID} AS said FROM blocks")
def speech_by_kind(spark, sf_dir):
    return text_blocks(_papers(spark, sf_dir)).select("doc_id", "block_id", "kind", speech.spoken(F.col("kind"), F.col("text"), F.col("heading")).alias("said"))


@query("""SELECT kind, kind NOT IN ('header', 'footer', 'pageNumber', 'figure', 'meta', 'reference', 'table', 'code', 'caption', 'footnote', 'equation') AS by_default,
 kind NOT IN ('header', 'footer', 'pageNumber', 'figure', 'meta', 'table', 'code', 'footnote', 'equation') AS with_references, true AS without_paper_mode
FROM (VALUES ('title'), ('authors'), ('heading'), ('body'), ('caption'), ('table'), ('code'), ('figure'), ('equation'), ('footnote'), ('header'), ('footer'), ('pageNumber'), ('reference'), ('meta')) AS t(kind)""")
def default_inclusion(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in speech.LABELS], "kind string")
    chosen = speech.Options(skip_references=False, skip_captions=False)
    of = lambda o: speech.default_included(F.col("kind"), o)
    return kinds.select("kind", of(speech.Options()).alias("by_default"), of(chosen).alias("with_references"), of(speech.Options(paper_mode=False)).alias("without_paper_mode"))


_AUTO = "kind NOT IN ('reference', 'caption')"


@query(f"""WITH {_BLOCKS_SQL}, o AS (SELECT doc_id, block_id, arg_max(included, seq) AS picked FROM ({I.CHANGES}) GROUP BY 1, 2)
SELECT b.doc_id, b.block_id, kind, {_AUTO} AS auto, coalesce(picked, {_AUTO}) AS included FROM blocks b LEFT JOIN o ON b.doc_id = o.doc_id AND b.block_id = o.block_id""")
def apply_overrides(spark, sf_dir):
    changes = speech.latest_overrides(I.sql(spark, sf_dir, I.CHANGES, "events"))
    return speech.apply_options(text_blocks(_papers(spark, sf_dir)), overrides=changes).select("doc_id", "block_id", "kind", "auto", "included")


_CLEANED = R.sql_rules(R.sql_rules(R.sql_citations(f"({_SAID})"), R.SPEECH), R.CLEANUP)


@query(rf"""WITH RECURSIVE {_BLOCKS_SQL}, spoken AS (SELECT {{'d': doc_id, 'b': block_id}} AS k, {_CLEANED} AS t FROM blocks WHERE kind NOT IN ('reference', 'caption')), {parts_sql('spoken')},
 numbered AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY i, j) - 1)::INT AS ordinal, count(*) OVER (PARTITION BY k) AS n, trim(regexp_replace(part, '\s+', ' ', 'g')) AS part FROM parts),
 rows AS (SELECT doc_id, block_id, ordinal, page, kind, part, n, number, CASE WHEN part LIKE '%.' AND NOT regexp_matches(text, '[.!?…:]$') THEN left(part, length(part) - 1) ELSE part END AS bare
  FROM numbered JOIN blocks ON k.d = doc_id AND k.b = block_id WHERE regexp_matches(part, '[\p{{L}}\p{{N}}]')),
 shown AS (SELECT *, CASE WHEN number IS NOT NULL AND kind IN ('heading', 'reference') THEN number || ' ' || bare ELSE bare END AS long FROM rows)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block_id, ordinal) - 1)::INT AS sentence_id, block_id, ordinal, page, kind, part AS text, CASE WHEN n = 1 AND long <> part THEN long END AS display FROM shown""")
def sentence_rows(spark, sf_dir):
    return text_sentences(_papers(spark, sf_dir))


@query(f"""WITH RECURSIVE spoken AS (SELECT doc_id AS k, {I.SPOKEN} AS t FROM documents), {parts_sql('spoken')}
SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY i, j) - 1)::INT AS ordinal, part FROM parts""")
def sentence_chunks(spark, sf_dir):
    return _spoken(spark, sf_dir).select("doc_id", F.posexplode(sentence_parts("text")).alias("ordinal", "part"))


# --- views ------------------------------------------------------------------------


@query(f"""WITH s AS ({I.SENTENCES}), m AS (SELECT doc_id, max(page) AS m FROM s GROUP BY 1), r AS (SELECT doc_id, least(2, m) AS lo, least(3, m) AS hi FROM m)
SELECT doc_id, min(sentence_id) AS first, max(sentence_id) AS last FROM s JOIN r USING (doc_id) WHERE page >= lo AND page <= hi GROUP BY doc_id""")
def page_bounds(spark, sf_dir):
    return views.page_bounds(_sentences(spark, sf_dir), 2, 3)


@query(f"SELECT doc_id, 2 - min(sentence_id) + 1 AS position, max(sentence_id) - min(sentence_id) + 1 AS in_range FROM ({I.SENTENCES}) GROUP BY doc_id")
def range_positions(spark, sf_dir):
    bounds = views.page_bounds(_sentences(spark, sf_dir), 1).withColumn("index", F.lit(2))
    return views.positions(bounds)


@query(f"""WITH s AS ({I.SENTENCES}), c AS (SELECT doc_id, b AS block_id, 1 AS ordinal FROM (SELECT DISTINCT doc_id FROM s), (VALUES (0), (2), (9)) AS t(b)),
r AS (SELECT c.doc_id, c.block_id, c.ordinal, sentence_id, CASE WHEN s.block_id = c.block_id AND s.ordinal = c.ordinal THEN 1 WHEN s.block_id = c.block_id THEN 2 WHEN s.block_id > c.block_id THEN 3 ELSE 4 END AS tier
 FROM c JOIN s ON s.doc_id = c.doc_id)
SELECT doc_id, block_id, ordinal, CASE WHEN min(tier) < 4 THEN arg_min(sentence_id, tier * 100000 + sentence_id) ELSE max(sentence_id) END AS index FROM r GROUP BY 1, 2, 3""")
def cursor_relocate(spark, sf_dir):
    s = _sentences(spark, sf_dir)
    cursors = s.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(9))).alias("block_id"), F.lit(1).alias("ordinal"))
    return views.relocate_cursors(cursors, s)


@query(f"SELECT doc_id, sentence_id, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY sentence_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS remaining_chars FROM ({I.SENTENCES})")
def remaining_chars(spark, sf_dir):
    s = _sentences(spark, sf_dir)
    return views.remaining_chars(s, views.page_bounds(s, 1))


@query("""WITH m AS (SELECT doc_id, floor(n_chars * 40 / 14.0 / 1.5 / 60 + 0.5)::BIGINT AS m FROM documents)
SELECT doc_id, CASE WHEN m < 1 THEN 'under a minute' WHEN m < 60 THEN m || ' min' ELSE (m // 60) || ' h ' || (m % 60) || ' min' END AS label FROM m""")
def duration_labels(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", views.reading_time(F.col("n_chars") * 40, 1.5).alias("label"))


@query(f"""WITH a AS ({I.APPLIED}), s AS ({I.SENTENCES}), n AS (SELECT doc_id, count(*) AS n_sentences FROM s GROUP BY 1)
SELECT a.doc_id, count(*) AS n_blocks, count_if(included) AS n_read, any_value(n_sentences) AS n_sentences FROM a JOIN n USING (doc_id) GROUP BY 1""")
def read_counts(spark, sf_dir):
    return views.read_counts(_applied(spark, sf_dir), _sentences(spark, sf_dir))


@query(f"SELECT doc_id, block_id, list(text ORDER BY ordinal) AS texts, min(sentence_id) AS first_sentence FROM ({I.SENTENCES}) GROUP BY 1, 2")
def sentences_by_block(spark, sf_dir):
    return views.sentences_of_blocks(_sentences(spark, sf_dir))


_LABEL = "CASE kind WHEN 'body' THEN 'Text' WHEN 'reference' THEN 'Reference' WHEN 'table' THEN 'Table' WHEN 'caption' THEN 'Caption' ELSE 'Heading' END"


@query(f"""WITH a AS ({I.APPLIED}), s AS (SELECT doc_id, block_id, count(*) AS ns FROM ({I.SENTENCES}) GROUP BY 1, 2),
j AS (SELECT a.*, ns FROM a LEFT JOIN s USING (doc_id, block_id) WHERE NOT included OR ns > 0),
c AS (SELECT *, CASE WHEN lag(included) OVER w IS DISTINCT FROM included THEN 1 ELSE 0 END AS changed FROM j WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_id)),
i AS (SELECT *, sum(changed) OVER (PARTITION BY doc_id, page ORDER BY block_id) AS island FROM c),
g AS (SELECT doc_id, page, island, CASE WHEN included THEN block_id ELSE -1 END AS part, min(block_id) AS first_block, count(*) AS n_blocks, any_value(included) AS included, count(DISTINCT kind) AS kinds, arg_min(kind, block_id) AS kind,
 sum(coalesce(ns, 0))::BIGINT AS n_sentences, left(string_agg(text, ' ' ORDER BY block_id), 140) AS preview FROM i GROUP BY 1, 2, 3, 4)
SELECT doc_id, page, first_block, n_blocks, included, n_sentences, CASE WHEN NOT included THEN
 CASE WHEN n_blocks = 1 THEN {_LABEL} WHEN kinds = 1 AND kind = 'reference' THEN 'References (' || n_blocks || ')' WHEN kinds = 1 THEN {_LABEL} || ' (' || n_blocks || ')' ELSE {_LABEL} || ' and more (' || n_blocks || ')' END END AS label,
 CASE WHEN NOT included THEN preview END AS preview FROM g""")
def skipped_runs(spark, sf_dir):
    return views.page_items(_applied(spark, sf_dir), _sentences(spark, sf_dir))


@query(f"""SELECT CASE language WHEN 'en-us' THEN 'American English' ELSE 'British English' END AS label, id, name, grade, (row_number() OVER (PARTITION BY language ORDER BY lower(grade), lower(name)))::INT AS place
FROM ({I.VOICES}) WHERE language IN ('en-us', 'en-gb')""")
def voice_menu(spark, sf_dir):
    return views.voice_menu(spark.sql(I.VOICES))


@query(f"""WITH l AS (SELECT job, file, arg_max(loaded, seq) AS loaded, arg_max(total, seq) AS total FROM ({I.PROGRESS}) GROUP BY 1, 2)
SELECT job, sum(loaded)::BIGINT AS loaded, sum(total)::BIGINT AS total, count(*) AS n_files FROM l GROUP BY job""")
def load_progress(spark, sf_dir):
    return views.load_progress(I.sql(spark, sf_dir, I.PROGRESS, "events"))


@query(f"SELECT doc_id, block_id, arg_max(included, seq) AS included FROM ({I.CHANGES}) GROUP BY 1, 2")
def latest_overrides(spark, sf_dir):
    return speech.latest_overrides(I.sql(spark, sf_dir, I.CHANGES, "events"))


@query(f"""WITH c AS ({I.CHANGES}), z AS (SELECT doc_id, max(seq) AS z FROM c WHERE seq % 37 = 0 GROUP BY 1), k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = c.doc_id AND z.z >= c.seq))
SELECT doc_id, block_id, included FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, block_id ORDER BY seq DESC) = 1""")
def overrides_after_resets(spark, sf_dir):
    changes = I.sql(spark, sf_dir, I.CHANGES, "events")
    return speech.latest_overrides(changes, changes.where("seq % 37 = 0").select("doc_id", "seq"))


@query(f"SELECT doc_id, unnest(range(1, least(1 + 3, max(sentence_id)) + 1))::INT AS sentence_id FROM ({I.SENTENCES}) GROUP BY doc_id")
def lookahead(spark, sf_dir):
    bounds = views.page_bounds(_sentences(spark, sf_dir), 1, 1000).withColumn("index", F.lit(1))
    return views.lookahead(bounds)


@query(f"""WITH r AS ({I.REQUESTS}), l AS (SELECT *, max(session) OVER (PARTITION BY doc_id) AS latest FROM r)
SELECT doc_id, session, text, voice, speed, min(sentence_id) AS sentence_id, count(*) AS n_requests FROM l WHERE session = latest GROUP BY 1, 2, 3, 4, 5""")
def tts_dedupe(spark, sf_dir):
    return views.distinct_jobs(I.sql(spark, sf_dir, I.REQUESTS, "conversations"))


@query()
def tts_wav(spark, sf_dir):
    return audio.spoken_files(_sentences(spark, sf_dir), audio.silent_voice())


# --- sources and scalar functions ---------------------------------------------------


@query(f"""SELECT title, name, mime, CASE WHEN length(trim(title)) > 3 AND NOT regexp_matches(trim(title), {_re2(T.UNTITLED)}) THEN trim(title) ELSE regexp_replace(name, '(?i)\\.pdf$', '') END AS resolved,
 CASE WHEN regexp_matches(name, '(?i)\\.pdf$') OR mime = 'application/pdf' THEN 'pdf' WHEN regexp_matches(name, '(?i)\\.(txt|md|markdown|text)$') OR regexp_matches(mime, '^text/') THEN 'text' ELSE 'rejected' END AS kind,
 CASE WHEN trim(regexp_replace(title, '[^A-Za-z0-9_\\- ]+', '', 'g')) = '' THEN 'audio' ELSE trim(regexp_replace(title, '[^A-Za-z0-9_\\- ]+', '', 'g')) END || '.wav' AS download FROM ({I.NAMES})""")
def titles_and_files(spark, sf_dir):
    c = F.col
    return spark.sql(I.NAMES).select("title", "name", "mime", T.resolve_title(c("title"), c("name")).alias("resolved"), T.file_kind(c("name"), c("mime")).alias("kind"), T.download_name(c("title")).alias("download"))


@query(rf"SELECT doc_id, regexp_matches(text, {_re2(T.MARKDOWN)}) AS is_markdown FROM documents")
def markdown_detect(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.looks_like_markdown(F.col("text")).alias("is_markdown"))


def _inline_sql(expr: str) -> str:
    for pattern, out in markdown.INLINE:
        out = out.replace("$1", r"\1").replace("$2", r"\2")
        if r"\1" in pattern:  # one rule for each delimiter
            for mark in (r"\*\*", "__"):
                expr = f"regexp_replace({expr}, {R.quoted(mark + '(.+?)' + mark)}, '\\1', 'g')"
        elif "(?=" in pattern:  # what follows is written back, twice over, as it may begin the next match
            moved = pattern.replace("(?=", "(").replace(r"\Z", "$")
            for _ in range(2):
                expr = f"regexp_replace({expr}, {R.quoted(moved)}, {R.quoted(out + chr(92) + '3')}, 'g')"
        else:
            expr = f"regexp_replace({expr}, {R.quoted(pattern)}, {R.quoted(out)}, 'g')"
    for name in sorted(markdown.ENTITIES, key=lambda n: n == "amp"):
        expr = f"replace({expr}, {R.quoted('&' + name + ';')}, {R.quoted(markdown.ENTITIES[name])})"
    codes = f"list_distinct(list_filter(regexp_extract_all({expr}, '&#([0-9]+);', 1), lambda c: c::BIGINT < 1114112))"
    return f"list_reduce(list_prepend({expr}, {codes}), lambda t, c: replace(t, '&#' || c || ';', chr(c::INT)))"


_MARKED = "concat('**Bold** and _soft_ [link](http://x) `code` ~~old~~ $a+b$ \\\\*kept\\\\* &amp; &#233;&#65;&#128512; &#99999999; &amp;#66; ', html)"


@query(f"SELECT page_id, {_inline_sql(_MARKED.replace(chr(92) * 2, chr(92)))} AS text FROM pages")
def inline_markdown(spark, sf_dir):
    pages = I.sql(spark, sf_dir, f"SELECT page_id, {_MARKED} AS t FROM pages", "pages")
    return pages.select("page_id", markdown.inline_column(F.col("t")).alias("text"))


_MARKDOWN_SQL = blocks_sql(f"(SELECT doc_id, {I.MARKED_PAPER} AS t FROM documents)", _inline_sql, lambda e: f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))", _re2(T.CAPTION), _re2(T.NUMBER), _re2(T.REFERENCES))


@query(f"WITH {_MARKDOWN_SQL} SELECT doc_id, block_id, 1 AS page, kind, text, 10.0::DOUBLE AS size, number, heading, CASE WHEN rows IS NOT NULL THEN to_json(rows)::VARCHAR END AS rows FROM mblocks")
def markdown_blocks(spark, sf_dir):
    papers = I.sql(spark, sf_dir, f"SELECT doc_id, {I.MARKED_PAPER} AS text FROM documents", "documents")
    return markdown.markdown_blocks(papers).withColumn("rows", F.to_json("rows"))


@query(rf"""WITH t AS (SELECT doc_id, {I.UNCOMPOSED} AS t FROM documents),
 a AS (SELECT doc_id, replace(replace(replace(replace(replace(regexp_replace(t, '[\x{{00AD}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}\x{{FFFD}}]', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '²', '2'), '½', '1⁄2'), 'Ａ', 'A') AS t FROM t),
 c AS (SELECT doc_id, replace(replace(replace(replace(t, '´e', 'é'), '´ e', 'é'), '¨o', 'ö'), '¸ c', 'ç') AS t FROM a)
SELECT doc_id, trim(regexp_replace(nfc_normalize(t), '[\s\x{{00A0}}\x{{2009}}]+', ' ', 'g')) AS text FROM c""")
def normalize_text(spark, sf_dir):
    return I.sql(spark, sf_dir, f"SELECT doc_id, {I.UNCOMPOSED} AS text FROM documents", "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, 6 + doc_id % 8 AS size, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT doc_id, size, unnest(regexp_extract_all(line, '[^ ]+')) AS text FROM l),
 n AS (SELECT *, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS signs FROM p)
SELECT doc_id, count(*) AS n_blocks, count_if(size < 8 AND signs <= 2) AS n_specks, sum(CASE WHEN size >= 8 OR signs > 2 THEN signs ELSE 0 END)::BIGINT AS n_signs FROM n GROUP BY doc_id""")
def speck_filter(spark, sf_dir):
    """Every word of every whole text as a block of its own: small ones with two signs or fewer are specks."""
    words = I.table(spark, sf_dir, "documents").select("doc_id", (6 + F.col("doc_id") % 8).alias("size"), F.explode(F.regexp_extract_all("text", F.lit("[^ \n]+"), 0)).alias("text"))
    signs = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    speck = layout_rules.speck(F.col("text"), F.col("size"), F.lit(10.0))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(speck).alias("n_specks"), F.sum(F.when(~speck, signs).otherwise(0)).alias("n_signs"))


@query(f"SELECT id, floor(x * 2 + 0.5) / 2 AS half, floor(n / 1048576.0 + 0.5)::BIGINT || ' MB' AS size FROM ({I.NUMBERS})")
def rounding(spark, sf_dir):
    return I.sql(spark, sf_dir, I.NUMBERS, "orders").select("id", T.half_round(F.col("x")).alias("half"), T.megabytes(F.col("n")).alias("size"))


# --- layout statistics ----------------------------------------------------------------


@query(f"""SELECT doc_id, page, seq, str, x - view_x0 AS x, y - view_y0 AS y, coalesce(width, 0) AS w, sqrt(a * a + b * b) AS size, font FROM ({I.ITEMS}) WHERE trim(str) <> '' AND a > 0 AND abs(b) <= a * 0.3::DOUBLE""")
def run_filter(spark, sf_dir):
    return layout_stats.filter_runs(I.sql(spark, sf_dir, I.ITEMS, "lineitem"))


_STYLE = r"[-,_ ]?(?:bold|italic|oblique|regular|regu|medium|medi|ital|roman|book|light|semibold|demibold|black|heavy|mt|ps|std|pro)+.*$"


@query(f"""SELECT name, {', '.join(f"regexp_matches(name, {R.quoted(p.replace('-medi(?!um)', '-medi($|[^u]|u$|u[^m])'))}) AS {k}" for k, p in T.FONT_MARKS.items())},
 regexp_replace(regexp_replace(lower(regexp_replace(name, '^[A-Z]{{6}}\\+', '')), '{_STYLE}', ''), '[0-9]+$', '') AS family FROM ({I.FONTS})""")
def font_facts(spark, sf_dir):
    return spark.sql(I.FONTS).select("name", *layout_stats.font_facts(F.col("name")), T.font_family(F.col("name")).alias("family"))


@query(f"WITH {I.RUNS_DUCK}, {_SIZES_SQL} SELECT * FROM sizes")
def body_size(spark, sf_dir):
    return layout_stats.body_size(_runs(spark, sf_dir))


@query(f"""WITH {I.RUNS_DUCK}, m AS (SELECT doc_id, arg_max(font, {{'n': n, 'o': -o}}) AS font FROM (SELECT doc_id, font, sum(length(trim(str)))::BIGINT AS n, min(page::BIGINT * 10000000 + seq) AS o FROM runs WHERE length(trim(str)) > 0 GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, font, regexp_replace(regexp_replace(lower(regexp_replace(font, '^[A-Z]{{6}}\\+', '')), '{_STYLE}', ''), '[0-9]+$', '') AS family, false AS cm_body FROM m""")
def body_font(spark, sf_dir):
    return layout_stats.body_font(_runs(spark, sf_dir))


@query(f"""WITH {I.RUNS_DUCK}, {_SIZES_SQL}, {_LINES_SQL}, l AS (SELECT doc_id, body_size, size, col, lag(y) OVER w - y AS gap, lag(size) OVER w AS ps, lag(col) OVER w AS pc FROM lines JOIN sizes USING (doc_id) WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_seq)),
g AS (SELECT doc_id, body_size, CASE WHEN pc = col AND abs(size - body_size) <= 0.6 AND abs(ps - body_size) <= 0.6 AND gap > 0.8 * body_size AND gap < 2.5 * body_size THEN gap END AS gap FROM l)
SELECT doc_id, CASE WHEN count(gap) >= 5 THEN list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1] ELSE any_value(body_size) * 1.2::DOUBLE END AS pitch, count(gap) AS n_gaps FROM g GROUP BY doc_id""")
def line_pitch(spark, sf_dir):
    return layout_stats.line_pitch(_lines(spark, sf_dir), layout_stats.body_size(_runs(spark, sf_dir)))


_KEY = "trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH {I.RUNS_DUCK}, {_LINES_SQL}, k AS (SELECT DISTINCT doc_id, page, {_KEY} AS key FROM lines WHERE y > height * 0.86::DOUBLE OR y < height * 0.14::DOUBLE),
n AS (SELECT doc_id, greatest(2, ceil(count(DISTINCT page) * 0.3::DOUBLE)) AS need FROM lines GROUP BY 1)
SELECT doc_id, key, count(*) AS n_pages FROM k JOIN n USING (doc_id) WHERE length(key) > 0 GROUP BY doc_id, key, need HAVING count(*) >= need""")
def running_headers(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return layout_stats.running_keys(lines.drop("height"), lines.select("doc_id", "page", "height").distinct())


@query(f"""WITH {I.RUNS_DUCK}, {_SIZES_SQL}, {_LINES_SQL}, b AS (SELECT *, size >= 0.8 * body_size AS big FROM lines JOIN sizes USING (doc_id)),
u AS (SELECT * FROM (SELECT *, bool_or(big) OVER (PARTITION BY doc_id, page, col) AS any_big FROM b) WHERE big OR NOT any_big),
m AS (SELECT doc_id, page, col, floor(x0 + 0.5) AS v, count(*) AS n, min(line_seq) AS o FROM u GROUP BY 1, 2, 3, 4),
l AS (SELECT doc_id, page, col, arg_max(v, {{'n': n, 'o': -o}})::BIGINT AS "left" FROM m GROUP BY 1, 2, 3)
SELECT doc_id, page, col, any_value("left") AS "left", list_sort(list(x1))[least(count(*) - 1, floor(count(*) * 0.95::DOUBLE)::BIGINT) + 1] AS "right" FROM u JOIN l USING (doc_id, page, col) GROUP BY 1, 2, 3""")
def column_bounds(spark, sf_dir):
    return layout_stats.column_bounds(_lines(spark, sf_dir), layout_stats.body_size(_runs(spark, sf_dir)))


@query("SELECT o_custkey AS k, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median FROM orders GROUP BY 1")
def upper_median(spark, sf_dir):
    return I.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(layout_stats.upper_median(F.col("o_totalprice")).alias("median"))


@query("SELECT DISTINCT p_partkey % 3000 AS doc_id FROM part EXCEPT SELECT user_id FROM events WHERE event_type <> 'view'")
def scanned_documents(spark, sf_dir):
    pages = I.table(spark, sf_dir, "part").select((F.col("p_partkey") % 3000).alias("doc_id"))
    return layout_stats.scanned_documents(pages, I.table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").alias("doc_id")))


_CELLS = "string_split(joined, '|')"


@query(rf"""WITH l AS (SELECT *, {_CELLS} AS cells, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS tokens, greatest(length(regexp_replace(text, '\s', '', 'g')), 1) AS plain FROM ({I.LINES})),
s AS (SELECT *, (math_chars + len(regexp_extract_all(text, {_re2(layout_stats.MATH_CHARS)})) + len(regexp_extract_all(regexp_replace(text, '\s', '  ', 'g'), '(?:^|[\s(])[b-zB-HJ-Z](?:$|[\s,.;:)])')))::DOUBLE / plain AS math_score,
 len(cells) >= 2 AND regexp_matches(text, '\([0-9]+[a-z]?\)$') AS eq_number, len(list_filter(cells, lambda c: regexp_matches(c, {_re2(layout_stats.NUMERIC_CELL)}))) AS numeric,
 len(list_filter(tokens, lambda t: regexp_matches(t, '^(?:[0-9.]*[0-9][0-9.]*%?|[-–])$'))) AS bare FROM l)
SELECT doc_id, line_seq, math_score, eq_number, NOT eq_number AND ((len(cells) >= 3 AND (numeric / len(cells) >= 0.3::DOUBLE OR length(replace(joined, '|', '')) / len(cells) <= 12)) OR len(cells) >= 4) AS tabular,
 NOT eq_number AND bare >= 3 AND bare >= 0.4::DOUBLE * len(tokens) AND NOT regexp_matches(text, '[.!?]$') AS numeric_row, math_score >= 0.45::DOUBLE OR (eq_number AND math_score >= 0.15::DOUBLE) AS is_math FROM s""")
def line_flags(spark, sf_dir):
    lines = I.sql(spark, sf_dir, I.LINES, "lineitem").withColumn("cells", F.split("joined", r"\|"))
    return layout_stats.line_flags(lines).select("doc_id", "line_seq", "math_score", "eq_number", "tabular", "numeric_row", "is_math")


# --- layout fold -----------------------------------------------------------------------


@query()
def layout_lines(spark, sf_dir):
    return layout_fold.layout_lines(_runs(spark, sf_dir))


@query()
def layout_blocks(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    pages = runs.select("doc_id", "page").distinct().withColumn("height", F.lit(792.0))
    return layout_fold.layout_blocks(runs, pages).withColumn("rows", F.to_json("rows"))


@query()
def layout_sentences(spark, sf_dir):
    """Runs to what is spoken, sentence by sentence."""
    runs = _runs(spark, sf_dir)
    pages = runs.select("doc_id", "page").distinct().withColumn("height", F.lit(792.0))
    return sentences(speech.apply_options(layout_fold.layout_blocks(runs, pages)))
