import struct

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audio, layout_fold, layout_rules, layout_stats, markdown, speech, views
from lectern.operators.sentences import sentences, text_sentences
from lectern.operators.text_blocks import text_blocks
from lectern.sources import readers
from lectern.streaming.documents import stream_documents, write_blocks


def test_read_texts(spark, tmp_path):
    (tmp_path / "notes.v2.md").write_text("# Head\n\nBody.")
    (tmp_path / "plain.txt").write_text("One\r\ntwo")
    (tmp_path / "marked.txt").write_text("a | b |\n- item")
    got = {r.title: (r.text, r.markdown) for r in readers.read_texts(spark, f"file://{tmp_path}").collect()}
    assert got == {"notes.v2": ("# Head\n\nBody.", True), "plain": ("One\r\ntwo", False), "marked": ("a | b |\n- item", True)}


def test_paste_and_dispatch(spark):
    assert [tuple(r) for r in readers.pasted(spark, "x").collect()] == [(0, "Pasted text", "x")]
    files = spark.createDataFrame([("a.PDF", ""), ("b", "application/pdf"), ("c.markdown", ""), ("d", "text/csv"), ("e.png", "image/png")], "name string, mime string")
    assert [(r.kind, r.error) for r in readers.dispatch(files).collect()] == [("pdf", None), ("pdf", None), ("text", None), ("text", None), ("rejected", readers.REJECTED)]


def test_read_pdfs_through_a_parser(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"two words")
    (tmp_path / "empty.pdf").write_bytes(b"")

    def parse(content):
        for k, word in enumerate(content.decode().split()):
            yield 1, k, word, 10.0, 0.0, 50.0 + 40 * k, 700.0, 30.0, 10.0, 0.0, 0.0, "F1"

    runs = layout_stats.filter_runs(readers.read_pdfs(spark, f"file://{tmp_path}/*.pdf", parse).withColumnRenamed("path", "doc_id"))
    assert [(r.str, r.x, r["size"]) for r in runs.orderBy("seq").collect()] == [("two", 50.0, 10.0), ("words", 90.0, 10.0)]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Head {i}\n\nSome text, and more of it.\n\nReferences\n\n[1] A.") for i in range(30)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = stream_documents(spark, f"{tmp_path}/in", docs.schema, files_per_trigger=1)
    write_blocks(stream, text_blocks, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    columns = text_blocks(docs).columns
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(columns).collect()), key=repr) == sorted(map(tuple, text_blocks(docs).collect()), key=repr)


def test_synthesis_says_each_text_once(spark, tmp_path):
    def load():
        def voice(text):
            (tmp_path / f"{hash(text) & 0xFFFF}-{np.random.default_rng().integers(1 << 40)}").touch()
            return np.full(len(text), 0.5, dtype=np.float32)

        return voice

    said = spark.createDataFrame([(1, 0, "abc"), (1, 1, "de"), (2, 0, "abc")], "doc_id long, sentence_id int, text string")
    clips = audio.synthesize(said, load).persist()
    assert {(r.doc_id, r.sentence_id): len(r.samples) for r in clips.collect()} == {(1, 0): 6, (1, 1): 4, (2, 0): 6}
    assert len(list(tmp_path.iterdir())) == 2
    wav = bytes(audio.wav_files(clips, rate=8).where("doc_id = 1").first().wav)
    assert struct.unpack_from("<I", wav, 40)[0] == 2 * (3 + 2 + 2 + 2)


def test_overrides_and_resets(spark):
    changes = spark.createDataFrame([(1, 0, 1, True), (1, 0, 5, False), (1, 2, 2, True), (2, 0, 3, True)], "doc_id long, block_id int, seq long, included boolean")
    resets = spark.createDataFrame([(1, 3)], "doc_id long, seq long")
    assert {(r.doc_id, r.block_id): r.included for r in speech.latest_overrides(changes, resets).collect()} == {(1, 0): False, (2, 0): True}


def test_page_ranges_are_clamped(spark):
    s = spark.createDataFrame([(1, k, k // 2 + 1) for k in range(8)] + [(2, 0, 1)], "doc_id long, sentence_id int, page int")
    of = lambda a, b: {r.doc_id: (r.first, r.last) for r in views.page_bounds(s, a, b).collect()}
    assert of(2, 3) == {1: (2, 5), 2: (0, 0)} and of(-4, 99) == {1: (0, 7), 2: (0, 0)} and of(9, 12) == {1: (6, 7), 2: (0, 0)}


def test_spoken_tables_and_authors(spark):
    rows = spark.createDataFrame([("table", "x", [["a", "b"], ["1", "2"]]), ("authors", "y", [["Ann Lee"], ["Bo Li"]]), ("table", "z.", None), ("footnote", "† note", None)], "kind string, text string, rows array<array<string>>")
    got = [r[0] for r in rows.select(speech.spoken(F.col("kind"), F.col("text"), F.lit(False), F.col("rows"))).collect()]
    assert got == ["a, b. 1, 2.", "Ann Lee. Bo Li.", "z.", "note"]


def test_sentences_in_the_row_equal_the_window(spark):
    docs = spark.createDataFrame([(i, f"Paper {i}\n\nAnn Lee\n\n1. Setup\n\nWe saw 3.{i} things (Li, 2020). É! " + "long words, " * 60 + f"\n\n—\n\nReferences\n\n[1] X.") for i in range(6)] + [(9, ""), (10, None)], "doc_id long, text string")
    one, two = (sorted(map(tuple, f.collect())) for f in (text_sentences(docs), sentences(speech.apply_options(text_blocks(docs)))))
    assert one == two and len(one) > 30


def test_inline_column_equals_inline(spark):
    texts = ["**b** _i_ [l](u) ![p](q) ~~s~~ `c` &amp; &#65;&#233; &#128512; &#1114112; \\*", "&amp;#65; &lt;p&gt; <b>x</b> $a$", "&#99999999999; plain", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", markdown.inline_column(F.col("t")).alias("s")).collect()
    assert all(r.s == markdown.inline(r.t) for r in rows)


WORDS = "non- self- end-to- state-of-the- inter- national word 3- fold A a".split()


def test_line_joins_equal_the_fold(spark):
    rng = np.random.default_rng(2)
    listed = [[" ".join(rng.choice(WORDS, rng.integers(0, 4))) for _ in range(4)] for _ in range(400)]
    got = spark.createDataFrame([(x,) for x in listed], "x array<string>").select(layout_rules.join_lines(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == [layout_fold.join_lines([layout_fold.Line([], text=t) for t in x]) for x in listed]


def test_gutters_equal_the_fold(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for page in range(40):
        prose, two = [], page % 3
        for k in range(int(rng.integers(6, 20))):
            runs = [layout_fold.Run("x" * int(rng.integers(5, 40)), float(x + rng.integers(0, 20)), 700.0 - 12 * k, float(rng.integers(80, 230)), float(rng.choice([10, 10, 10, 7])), "F") for x in ([54, 315] if two else [54])]
            line = layout_fold.Line(runs, x0=min(r.x for r in runs), x1=max(r.end for r in runs))
            prose.append(line)
            rows += [(1, page, k, r.x, r.w, r.n, r.size, 10.0) for r in runs]
        want[page] = layout_fold.find_gutter(prose, 10.0)
    frame = spark.createDataFrame(rows, "doc_id long, page int, line_seq int, x double, w double, n int, size double, body_size double")
    got = {r.page: (r.gutter, r.two) for r in layout_rules.gutters(frame).collect()}
    assert {p: (round(g, 6), bool(t)) for p, (g, t) in want.items()} == {p: (round(g, 6), t) for p, (g, t) in got.items()} and any(t for _, t in got.values())


def test_heading_equals_the_fold(spark):
    texts = ["Results", "2.1 Data and methods", "INTRODUCTION", "A. Proofs and things", "lower case", "Is it? Nobody has said so in all these years", "Acknowledgements.", "Twelve words or more are too many for a bold heading, it seems", "X", "IV. Related Work", "Ends with a comma,"]
    rows = [(t, n, ratio, bold, strict) for t in texts for n in (1, 4) for ratio in (0.9, 1.0, 1.1, 1.2) for bold in (True, False) for strict in (True, False)]
    frame = spark.createDataFrame([r[:4] for r in rows if not r[4]], "t string, n int, ratio double, bold boolean")
    cols = [layout_rules.heading(F.col("t"), F.col("n"), F.lit(True), F.col("ratio"), F.col("bold"), s).alias(f"s{int(s)}") for s in (False, True)]
    stats = layout_fold.Stats(10.0, "f", False, 12.0)
    for r in frame.select("*", *cols).collect():
        lines = [layout_fold.Line([], text=r.t, bold=r.bold, bold_end=r.bold) for _ in range(r.n)]
        block = layout_fold.Block(1, 0, 0.0, 100.0, lines, text=r.t, size=10.0 * r.ratio)
        for strict, got in ((False, r.s0), (True, r.s1)):
            assert (None if got is None else tuple(got)) == layout_fold.as_heading(block, stats, strict), (r, strict)


def test_normalised_text_of_the_query():
    assert T.normalize("ﬁne´ etude ´e") == "fineétude é"
